"""cuelattice: a PySpark-native engine for timed text."""
