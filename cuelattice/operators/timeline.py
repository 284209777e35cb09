"""Relations between cues and transcript segments on the time line of a medium.

segments: media_id, seg_idx, start_s, end_s, text. cues: media_id, cue_idx, start_s, end_s, text. Every join has
media_id and a time bucket as its equality key, and the exact time conditions as residuals; the nearest segment is
found by one sorted pass in either direction. So a medium of many segments never meets all its cues, and passes that go
through a medium in order spread it over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_space, finite, language_code, lines, overlap, srt_time
from .scans import PART, Scan, carried, in_order, numbered, schema_of

#: Seconds of the shortest cells of the overlap join.
OVERLAP_BUCKET = 16.0


def _center(start: Column, end: Column) -> Column:
    return (start + end) / 2


def normalized_segments(transcripts: DataFrame, clean=None) -> DataFrame:
    """Segments of transcripts (media_id, segments): repaired times, cleaned text, numbered after empty ones are dropped."""
    clean = clean or collapse_space
    s = transcripts.select("media_id", F.posexplode("segments").alias("pos", "x"))
    zero = F.lit(0.0)
    start = finite(F.coalesce("x.start", zero), zero)
    s = s.select("media_id", "pos", start.alias("start_s"), F.coalesce("x.end", zero).alias("end_s"), clean(F.col("x.text")).alias("text"))
    s = _repaired(s).filter((F.col("text") != "") | (F.col("end_s") > F.col("start_s")))
    return numbered(s, ["media_id"], ["pos"], "nth").select("media_id", (F.col("nth") - 1).cast("int").alias("seg_idx"), "start_s", "end_s", "text")


def _repaired(rows: DataFrame) -> DataFrame:
    """Ends that aren't finite become starts; ends ahead of starts come a millisecond behind them."""
    return rows.withColumn("end_s", finite(F.col("end_s"), F.col("start_s"))).withColumn("end_s", F.when(F.col("end_s") < F.col("start_s"), F.col("start_s") + 1e-3).otherwise(F.col("end_s")))


def normalized_cues(loose: DataFrame, clean=None) -> DataFrame:
    """Cues of any of three time conventions: seconds, then milliseconds, then plain start and end, by which pair is there."""
    clean = clean or collapse_space

    def time(which: str) -> Column:
        has = lambda u: F.col(f"start_{u}").isNotNull() & F.col(f"end_{u}").isNotNull()
        return F.when(has("s"), F.col(f"{which}_s")).when(has("ms"), F.col(f"{which}_ms") / 1000).otherwise(F.coalesce(F.col(which), F.lit(0.0)))

    start = finite(time("start"), F.lit(0.0))
    return _repaired(loose.select("media_id", "cue_idx", start.alias("start_s"), time("end").alias("end_s"), clean(F.col("text")).alias("text"), language_code(F.col("language")).alias("language")))


def band_candidates(cues: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """Pairs (media_id, cue_idx, seg_idx, distance) of centers at most `width` apart."""
    bucket = lambda c: F.floor(c / width).cast("long")
    center = _center(F.col("start_s"), F.col("end_s"))
    c = cues.select("media_id", "cue_idx", center.alias("c"), F.explode(F.array(*[bucket(center) + k for k in (-1, 0, 1)])).alias("bucket"))
    s = segments.select("media_id", "seg_idx", center.alias("s"), bucket(center).alias("bucket"))
    gap = F.abs(F.col("s") - F.col("c"))
    return c.join(s, ["media_id", "bucket"]).filter(gap <= width).select("media_id", "cue_idx", "seg_idx", gap.alias("distance"))


def spans(segments: DataFrame, longest: int) -> DataFrame:
    """Spans [i, j) of up to `longest` segments: text, start of the first, end of the last."""
    w = Window.partitionBy("media_id").orderBy("seg_idx").rowsBetween(0, longest - 1)
    ahead = F.collect_list(F.struct("text", "end_s")).over(w)
    rows = segments.select("media_id", F.col("seg_idx").alias("i"), "start_s", _center(F.col("start_s"), F.col("end_s")).alias("center"), ahead.alias("ahead"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("n"))
    part = F.slice("ahead", F.lit(1), F.col("n"))
    text = F.trim(F.array_join(F.transform(part, lambda x: F.coalesce(x["text"], F.lit(""))), " "))
    return rows.select("media_id", "i", (F.col("i") + F.col("n")).alias("j"), "n", text.alias("text"), "start_s", F.get(F.col("ahead"), F.col("n") - 1)["end_s"].alias("end_s"), "center")


class LastSeen(Scan):
    """Adds the center and number (seen_c, seen_idx) of the last segment up to each row, or nulls."""

    def zero(self) -> tuple | None:
        return None

    def add(self, summary: tuple | None, batch: pa.RecordBatch) -> tuple | None:
        there = np.flatnonzero(batch.column("seg_idx").is_valid())
        return (batch.column("c")[there[-1]].as_py(), batch.column("seg_idx")[there[-1]].as_py()) if len(there) else summary

    def join(self, left: tuple | None, right: tuple | None) -> tuple | None:
        return left if right is None else right

    def run(self, carried: tuple | None, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[tuple | None, pa.RecordBatch]:
        n = batch.num_rows
        first = np.full(n, -1)
        first[starts] = starts
        first = np.maximum.accumulate(first)
        seen = np.maximum.accumulate(np.where(np.asarray(batch.column("seg_idx").is_valid()), np.arange(n), -1))
        inside = pa.array(seen, pa.int64(), mask=seen < np.maximum(first, 0))
        found = [batch.column(c).take(inside) for c in ("c", "seg_idx")]
        ahead = (first < 0) & (seen < 0)
        if carried is not None and ahead.any():
            found = [pc.if_else(pa.array(ahead), pa.scalar(x, f.type), f) for x, f in zip(carried, found, strict=True)]
        last = tuple(f[n - 1].as_py() for f in found)
        kept = batch.drop_columns([PART])
        return None if last[1] is None else last, pa.RecordBatch.from_arrays([*kept.columns, *found], names=[*kept.schema.names, "seen_c", "seen_idx"])


def nearest_segment(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """(media_id, cue_idx, seg_idx, distance): the segment whose center is nearest; of equals, the first.

    Cues and the centers of segments are sorted together, once in either direction; the last segment seen is carried along.
    """
    kind = segments.schema["seg_idx"].dataType
    center = _center(F.col("start_s"), F.col("end_s")).cast("double")
    c = cues.select("media_id", center.alias("c"), "cue_idx", F.lit(None).cast(kind).alias("seg_idx"))
    s = segments.groupBy("media_id", center.alias("c")).agg(F.min("seg_idx").alias("seg_idx"))
    both = c.unionByName(s.select("media_id", "c", F.lit(None).cast(cues.schema["cue_idx"].dataType).alias("cue_idx"), "seg_idx")).withColumn("asks", F.col("seg_idx").isNull())

    def seen(by: str | Column) -> DataFrame:
        # segments ahead of cues of the same center, in either direction
        rows = in_order(both, ["media_id", by, "asks", "cue_idx"])
        found = carried(rows, ["media_id"], LastSeen(), schema_of(rows, f"seen_c double, seen_idx {kind.simpleString()}"), ["c", "seg_idx"])
        found = found.filter("cue_idx is not null and seen_idx is not null")
        return found.select("media_id", "cue_idx", F.struct(F.abs(F.col("seen_c") - F.col("c")).alias("distance"), F.col("seen_idx").alias("seg_idx")).alias("n"))

    found = seen("c").unionByName(seen(F.desc("c"))).groupBy("media_id", "cue_idx").agg(F.min("n").alias("n"))
    return found.select("media_id", "cue_idx", "n.seg_idx", "n.distance")


def _overlapping(cues: DataFrame, segments: DataFrame, unit: float) -> DataFrame:
    """Pairs of cues and segments (s0, s1) that share time.

    An interval has a level: cells of unit * 2^level seconds are at least as long as it, so it lies in two of them at most.
    The shorter of a pair looks up the cells of the longer one's level; a pair meets in the first cell that both have. So
    no interval, however long, is held against all of its medium, and a row becomes two for each level that is there at most.
    """

    def leveled(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
        length = F.greatest((F.col(b) - F.col(a)) / unit, F.lit(1.0))
        return rows.filter(F.col(b) > F.col(a)).withColumn(name, F.ceil(F.log2(length)).cast("int"))

    c, s = leveled(cues, "start_s", "end_s", "c_level"), leveled(segments, "s0", "s1", "s_level")
    levels = {k: sorted(x[0] for x in rows.select(k).distinct().collect()) for k, rows in (("c_level", c), ("s_level", s))}  # a few numbers

    def cells(a: str, b: str, level: Column) -> Column:
        cell = lambda t: F.floor(F.col(t) / (unit * F.pow(F.lit(2.0), level))).cast("long")
        return F.sequence(cell(a), cell(b))

    def dealt(rows: DataFrame, a: str, b: str, own: str, wanted: Column) -> DataFrame:
        """Rows by the cells of each wanted level, with the first of theirs."""
        spread = rows.withColumn("level", F.explode(wanted)).withColumn("cells", cells(a, b, F.col("level")))
        return spread.withColumn(f"{own}_first", F.get("cells", F.lit(0))).withColumn("cell", F.explode("cells")).drop("cells")

    def upward(own: str, other: str, equal: bool) -> Column:
        least = F.col(own) if equal else F.col(own) + 1
        return F.filter(F.array(*[F.lit(x) for x in levels[other]]).cast("array<int>"), lambda x: x >= least)

    key = ["media_id", "level", "cell"]
    short_cues = dealt(c, "start_s", "end_s", "c", upward("c_level", "s_level", True)).join(dealt(s, "s0", "s1", "s", F.array("s_level")), key)
    short_segments = dealt(c, "start_s", "end_s", "c", F.array("c_level")).join(dealt(s, "s0", "s1", "s", upward("s_level", "c_level", False)), key)
    met = short_cues.unionByName(short_segments).filter(F.col("cell") == F.greatest("c_first", "s_first"))
    shared = overlap(F.col("s0"), F.col("s1"), F.col("start_s"), F.col("end_s")) > 0
    return met.filter(shared).drop("c_first", "s_first", "c_level", "s_level", "level", "cell")


def overlapping_text(cues: DataFrame, segments: DataFrame, unit: float = OVERLAP_BUCKET) -> DataFrame:
    """(media_id, cue_idx, ref_text, n_segments): texts of the segments that share time with a cue, in order; none is empty."""
    s = segments.select("media_id", "seg_idx", F.col("start_s").alias("s0"), F.col("end_s").alias("s1"), F.col("text").alias("t"))
    pairs = _overlapping(cues.select("media_id", "cue_idx", "start_s", "end_s"), s, unit)
    texts = F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("seg_idx", "t"))))
    found = pairs.groupBy("media_id", "cue_idx").agg(F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("ref_text"), F.count(F.lit(1)).alias("n_segments"))
    return cues.select("media_id", "cue_idx").join(found, ["media_id", "cue_idx"], "left").select("media_id", "cue_idx", F.coalesce("ref_text", F.lit("")).alias("ref_text"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"))


def locate_spans(cues: DataFrame, segments: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(media_id, cue_idx, i, j) of cues that start with a segment and end with that or a later one; first ones win."""
    unit = max(1e-3, 2 * tolerance)
    bucket = lambda t: F.floor(t / unit).cast("long")

    def near(left: DataFrame, time: str, other: str) -> DataFrame:
        """Rows of left with the segments whose time `other` is that of `time`."""
        s = segments.select("media_id", "seg_idx", F.col(other).alias("at"), bucket(F.col(other)).alias("bucket"))
        c = left.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col(time) - tolerance), bucket(F.col(time) + tolerance)))))
        return c.join(s, ["media_id", "bucket"]).filter(F.abs(F.col("at") - F.col(time)) <= tolerance).drop("bucket", "at")

    own = cues.select("media_id", "cue_idx", "start_s", "end_s")
    first = near(own, "start_s", "start_s").groupBy("media_id", "cue_idx").agg(F.min("seg_idx").alias("i"), F.first("end_s").alias("end_s"))
    last = near(first, "end_s", "end_s").filter("seg_idx >= i")
    return last.groupBy("media_id", "cue_idx", "i").agg((F.min("seg_idx") + 1).alias("j")).select("media_id", "cue_idx", "i", "j")


def uncovered_runs(segments: DataFrame, used: DataFrame) -> DataFrame:
    """(media_id, i, j, start_s, end_s, text): the longest runs of segments that no used span (media_id, i, j) holds."""
    taken = used.filter("j > i").select("media_id", F.explode(F.sequence(F.col("i"), F.col("j") - 1)).alias("seg_idx")).distinct()
    free = segments.join(taken, ["media_id", "seg_idx"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("seg_idx", "text")))), lambda x: x["text"]), " ")
    free = numbered(free.select("media_id", "seg_idx", "start_s", "end_s", "text"), ["media_id"], ["seg_idx"], "nth")
    runs = free.withColumn("island", F.col("seg_idx") - F.col("nth")).groupBy("media_id", "island")
    return runs.agg(F.min("seg_idx").alias("i"), (F.max("seg_idx") + 1).alias("j"), F.min_by("start_s", "seg_idx").alias("start_s"), F.max_by("end_s", "seg_idx").alias("end_s"), text.alias("text")).drop("island")


def media_end(segments: DataFrame) -> DataFrame:
    return segments.groupBy("media_id").agg(F.max("end_s").alias("media_end"))


def keep_first(cues: DataFrame) -> DataFrame:
    """Of cues that agree to the millisecond and in text, the first by pos."""
    ms = lambda c: F.rint(F.col(c) * 1000)
    w = Window.partitionBy("media_id", ms("start_s"), ms("end_s"), "text").orderBy("pos")
    return cues.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def renumbered(cues: DataFrame) -> DataFrame:
    """Add index: 1, 2, ... in the order of start, end and pos."""
    return numbered(cues, ["media_id"], ["start_s", "end_s", "pos"], "index").withColumn("index", F.col("index").cast("int"))


#: A monotone function of times from 0 on, in pieces (from, slope 0 or 1, constant).
Pieces = list[tuple[float, int, float]]


def value(f: Pieces, x: float) -> float:
    _, slope, c = next(p for p in reversed(f) if p[0] <= x or p is f[0])
    return x + c if slope else c


def compose(first: Pieces, then: Pieces) -> Pieces:
    """x -> then(first(x))."""
    out: Pieces = []

    def put(at: float, slope: int, c: float) -> None:
        if not out or out[-1][1:] != (slope, c):
            out.append((at, slope, c))

    for k, (at, slope, c) in enumerate(first):
        if not slope:
            put(at, 0, value(then, c))
            continue
        end = first[k + 1][0] if k + 1 < len(first) else float("inf")
        for m, (low, inner, d) in enumerate(then):
            high = then[m + 1][0] if m + 1 < len(then) else float("inf")
            begin = max(at, low - c) if m else at
            if begin < min(end, high - c):
                put(begin, inner, c + d if inner else d)
    return out


class Constraints(Scan):
    """Carries the end of the cue put out before. What a cue makes of it is a function in a few pieces, and so is what many make."""

    def __init__(self, least: float, most: float):
        self.least, self.most = least, most

    def zero(self) -> Pieces:
        return [(0.0, 1, 0.0)]

    def _of(self, start: float, stop: float, is_locked: bool, end: float | None) -> Pieces:
        if is_locked:
            return [(0.0, 0, stop if end is None else min(stop, end))]
        least, ahead = max(self.least, 1e-3), max(start, 0.0)
        stretched: Pieces = [(float("-inf"), 1, self.most), (stop - self.most, 0, stop), (stop - least, 1, least)]
        begun: Pieces = [(0.0, 0, ahead), (ahead, 1, 0.0)] if ahead > 0 else [(0.0, 1, 0.0)]
        f = compose(begun, stretched)
        return f if end is None else compose(f, [(float("-inf"), 1, 0.0), (end, 0, end)])

    def add(self, summary: Pieces, batch: pa.RecordBatch) -> Pieces:
        for row in zip(*(batch.column(x).to_pylist() for x in ("start_s", "end_s", "locked", "media_end")), strict=True):
            summary = compose(summary, self._of(*row))
        return summary

    def join(self, left: Pieces, right: Pieces) -> Pieces:
        return compose(left, right)

    def enter(self, summary: Pieces) -> float:
        return value(summary, 0.0)

    def run(self, carried: float | None, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[float, pa.RecordBatch]:
        new = np.zeros(batch.num_rows, bool)
        new[starts] = True
        prev, kept, begins, stops = carried, [], [], []
        columns = (batch.column(x).to_pylist() for x in ("start_s", "end_s", "locked", "media_end"))
        for k, (first, start, stop, is_locked, end) in enumerate(zip(new.tolist(), *columns, strict=True)):
            if first:
                prev = 0.0
            if not is_locked:
                start = max(prev, 0.0, start)
                stop = max(start + 1e-3, stop)
                stop = start + self.least if stop - start < self.least else start + self.most if stop - start > self.most else stop
            clamped = end is not None and stop > end
            final = end if clamped else stop
            late = end is not None and start >= end
            prev = end if late else final
            if not late and not (clamped and (final <= start if is_locked else final - start < 0.001)):
                kept.append(k)
                begins.append(start)
                stops.append(final)
        some = batch.take(pa.array(kept, pa.int64()))
        return prev, pa.RecordBatch.from_arrays([some.column("media_id"), pa.array(begins, pa.float64()), pa.array(stops, pa.float64()), *(some.column(x) for x in ("text", "pos", "locked"))], names=["media_id", "start_s", "end_s", "text", "pos", "locked"])


def enforce_constraints(cues: DataFrame, least: float = 0.8, most: float = 8.0, ends: DataFrame | None = None, respect_locks: bool = False) -> DataFrame:
    """Durations between least and most seconds and no overlaps, by one pass over the cues of a medium in time order.

    cues: media_id, start_s, end_s, text, pos and, for respect_locks, locked. Locked cues keep their times. `ends`
    (media_id, media_end) clamps; what starts at an end or lasts no time after the clamp goes. The pass depends on the end
    of the cue put out before, so a medium's parts are told theirs by the functions of the parts ahead, and then all run.
    """
    locked = F.coalesce("locked", F.lit(False)) if respect_locks else F.lit(False)
    rows = cues.select("media_id", "start_s", "end_s", "text", F.col("pos").cast("long").alias("pos"), locked.alias("locked"))
    rows = rows.join(ends.select("media_id", "media_end"), "media_id", "left") if ends is not None else rows.withColumn("media_end", F.lit(None).cast("double"))
    kind = cues.schema["media_id"].dataType.simpleString()
    times = in_order(rows.withColumns({x: F.col(x).cast("double") for x in ("start_s", "end_s", "media_end")}), ["media_id", "start_s", "end_s", "pos"])
    return carried(times, ["media_id"], Constraints(least, most), f"media_id {kind}, start_s double, end_s double, text string, pos long, locked boolean", ["start_s", "end_s", "locked", "media_end"])


def srt_text(cues: DataFrame) -> DataFrame:
    """(media_id, content): one SRT text per medium."""
    line = F.concat_ws("\n", F.col("index").cast("string"), F.concat(srt_time(F.col("start_s")), F.lit(" --> "), srt_time(F.col("end_s"))), F.array_join(lines(F.coalesce("text", F.lit(""))), "\n"))
    one = F.concat(F.regexp_replace(line, "\n$", ""), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", one.alias("x")))), lambda v: v["x"]), "\n")
    return renumbered(cues).groupBy("media_id").agg(F.concat(F.regexp_replace(joined, r"\s+\z", ""), F.lit("\n")).alias("content"))
