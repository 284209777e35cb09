"""What the operators of this subpackage share: input columns, lineage cuts, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
WORD_SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores ahead of it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local master, as in tests, gets one made if none is set."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder for checkpoints; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of the files of shuffles (and of checkpoints, where Spark is set to clean them) that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which long loops of small jobs seldom make it do.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_KEPT: dict[str, Callable[[], None]] = {}


def sole_cache(name: str, clear: Callable[[], None]) -> None:
    """In a worker, which serves many stages: what other operators keep there is let go before this one fills its own."""
    others = [x for x in _KEPT if x != name]
    for other in others:
        _KEPT.pop(other)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    _KEPT[name] = clear


def partitions_for(rows: int, each: int) -> int:
    """How many partitions hold `rows` at about `each` rows a partition."""
    return max(1, -(-rows // each))


class Membership:
    """A map of bits that tells which rows certainly aren't among some. It is broadcast; MOST_BITS bounds it (32 MB).

    `rows` are the rows that are, told apart by `columns`. Spark sums up the map in rows of 4 KB. A row that isn't among
    them has its bit set by chance at times, in about 1 of 32 cases while the map isn't bounded; then only time is lost.
    """

    MOST_BITS = 28

    def __init__(self, rows: DataFrame, columns: list[str]):
        self.columns, self.bits = columns, 1 << min(self.MOST_BITS, max(20, (32 * rows.count()).bit_length()))
        at = self.place() + 1
        parts = rows.groupBy(F.bitmap_bucket_number(at).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
        found = np.zeros(self.bits // 8, np.uint8)
        for x in parts:
            first = (x["row"] - 1) * 4096
            found[first : first + 4096] = np.frombuffer(x["bits"], np.uint8)
        self.shared = rows.sparkSession.sparkContext.broadcast(found)

    def place(self) -> Column:
        return F.pmod(F.xxhash64(*self.columns), F.lit(self.bits))

    def marked(self, df: DataFrame) -> DataFrame:
        """df with the column that `chosen` needs."""
        return df.withColumn("__at", self.place())

    def chosen(self, batches: Iterator[pa.RecordBatch], among: bool) -> Iterator[pa.RecordBatch]:
        """In a task, of the batches of marked rows those that may be among them, or those that are not."""
        bits = self.shared.value
        for batch in batches:
            at = batch.column("__at").to_numpy()
            is_set = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            yield batch.filter(pa.array(is_set == among)).drop_columns(["__at"])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "t", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
