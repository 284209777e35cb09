"""Quality rules with thresholds adapted to each language and source.

Counts of every text are made by array expressions within its row. Mergeable quantile sketches of four ratios are
kept per language and source and merged into one per language and one over all. Limits follow from a group's quantiles
instead of fixed cutoffs, drawn towards those of the next larger group by what few texts tell, and are joined back to the rows.
Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, cut

#: Ratio -> (least spread, whether low values fail too). A limit lies REACH spreads from the median; the spread is the
#: distance from the median to a quartile, but at least the one given here. Where nearly all texts of a group have the same
#: ratio, as none has symbols, that least spread decides.
RATIOS: dict[str, tuple[float, bool]] = {
    "word_length": (0.25, True),
    "symbol_ratio": (0.005, False),
    "dup_line_ratio": (0.1, False),
    "repeat_ratio": (0.06, False),
}
REACH = 6.0
#: As many texts' worth the limits of the next larger group have in those of a group.
DRAWN = 100
#: Size parameter of the sketches.
SKETCH_K = 400


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words within three-word windows that occur twice or more: sort windows, compare neighbours, join their places."""
    zero = F.lit(0).cast("long")

    def places(windows: Column) -> Column:
        last = F.size(windows) - 1
        same = lambda j, k: F.get(windows, j)["w"] == F.get(windows, k)["w"]
        again = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j, j - 1)) | ((j < last) & same(j, j + 1)))
        return F.sort_array(F.transform(again, lambda j: F.get(windows, j)["i"]))

    def covered(at: Column) -> Column:
        steps = F.when(F.size(at) > 1, F.sequence(F.lit(0), F.size(at) - 2)).otherwise(F.array().cast("array<int>"))
        sum_ = F.aggregate(steps, zero, lambda acc, k: acc + F.least(F.lit(3), F.get(at, k + 1) - F.get(at, k)).cast("long"))
        return F.when(F.size(at) == 0, zero).otherwise(sum_ + 3)

    def sorted_windows(windows: Column) -> Column:
        return F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def counted(windows: Column) -> Column:
        none = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(none, zero).otherwise(let(sorted_windows(windows), lambda s: let(places(s), covered)))

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(starts, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, zero).otherwise(let(windows, counted))


def measured(docs: DataFrame) -> DataFrame:
    """Add the counts n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, WORD_SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    row = docs.select("*", counts.alias("__c"), symbols.alias("n_symbols"), by_line.alias("__l"))
    return row.select("*", "__c.*", "__l.*").drop("__c", "__l")


def with_ratios(counts: DataFrame) -> DataFrame:
    """Add the ratios; those of a text without words are null."""
    n = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    return counts.withColumns(
        {
            "word_length": F.col("word_chars") / n,
            "symbol_ratio": F.col("n_symbols") / F.when(F.col("word_chars") > 0, F.col("word_chars").cast("double")),
            "dup_line_ratio": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines").cast("double")),
            "repeat_ratio": F.col("n_repeat_words") / n,
        }
    )


def adaptive_limits(rows: DataFrame) -> DataFrame:
    """(lang, source, low_*, high_*) per language and source, from sketches merged upwards where a group is small."""
    sketches = [F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATIOS]
    merged = [F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATIOS]
    n = F.count("word_length").alias("n")
    # Partial sketches of each task meet per group; the rows of a hot group are never together.
    own = cut(rows.filter("n_words > 0").groupBy("lang", "source").agg(n, *sketches))
    lang = own.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    all_ = own.agg(F.sum("n").alias("n"), *merged).filter("n > 0")  # a sketch of nothing has no quantiles

    def limits(frame: DataFrame, name: str) -> DataFrame:
        out = []
        for r, (floor, low) in RATIOS.items():
            q = lambda p, r=r: F.kll_sketch_get_quantile_double(r, F.lit(p))
            out.append((q(0.5) + REACH * F.greatest(q(0.75) - q(0.5), F.lit(floor))).alias(f"high_{r}"))
            if low:
                out.append((q(0.5) - REACH * F.greatest(q(0.5) - q(0.25), F.lit(floor))).alias(f"low_{r}"))
        return frame.select(*[F.col(c).alias(f"{c}_{name}") for c in ("lang", "source") if c in frame.columns], F.col("n").alias(f"n_{name}"), F.struct(*out).alias(name))

    bounds = [f"high_{r}" for r in RATIOS] + [f"low_{r}" for r, (_, low) in RATIOS.items() if low]
    drawn = lambda own, n, towards: (own * n + DRAWN * towards) / (n + DRAWN)
    every = limits(all_, "all").withColumn("one", F.lit(1))
    both = limits(own, "own").join(limits(lang, "of"), F.col("lang_own").eqNullSafe(F.col("lang_of")), "left").withColumn("one", F.lit(1))
    chosen = both.join(F.broadcast(every), "one")  # a single row
    found = F.struct(*[drawn(F.col(f"own.{b}"), F.col("n_own"), drawn(F.col(f"of.{b}"), F.col("n_of"), F.col(f"all.{b}"))).alias(b) for b in bounds])
    return chosen.select(F.col("lang_own").alias("__lang"), F.col("source_own").alias("__source"), found.alias("__limits"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one per input row.

    docs has doc_id, text, lang and source; other columns are ignored. A null text has no words and fails. Null
    languages and sources are groups like others. Repeated rows are judged each. An empty table gives no rows.
    """
    rows = cut(with_ratios(measured(docs.select("doc_id", "text", "lang", "source"))).drop("text"))
    limits = cut(adaptive_limits(rows))
    joined = rows.join(limits, rows["lang"].eqNullSafe(limits["__lang"]) & rows["source"].eqNullSafe(limits["__source"]), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fails = F.lit(False)
    for r, (_, low) in RATIOS.items():
        fails = fails | F.coalesce(F.col(r) > F.col(f"__limits.high_{r}"), F.lit(False))
        if low:
            fails = fails | F.coalesce(F.col(r) < F.col(f"__limits.low_{r}"), F.lit(False))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return joined.select("doc_id", *counts, base.alias("base_failed"), (~base & ~fails).alias("kept"))
