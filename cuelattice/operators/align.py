"""The best window of segments for each cue: time bands that widen, text scores, and a phrase search for what stays weak."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import core_counts
from ..functions.text import let
from ..functions.windows import Block, phrase_search
from ..lineage import cut, spread
from .timeline import nearest_segment

#: (seconds between centers, longest span) of the first pass and the later ones.
FIRST_PASS, LATER_PASSES = (8.0, 3), [(12.0, 4), (18.0, 5), (30.0, 6)]
WEAK, VERY_WEAK, CLOSE, PHRASE = 0.35, 0.25, 2.0, 0.4

#: Segments of a block, and cues that meet it in one group.
BLOCK, CUES = 64, 512


def _blocks(segments: DataFrame) -> DataFrame:
    """Segments by block: BLOCK consecutive ones of a medium and those behind them that spans of the block reach into."""
    block, at = F.floor(F.col("seg_idx") / BLOCK).cast("long"), F.pmod("seg_idx", F.lit(BLOCK))
    also = F.array_compact(F.array(block, F.when(at < LATER_PASSES[-1][1] - 1, block - 1)))
    return segments.select("media_id", F.explode(also).alias("block"), F.col("seg_idx").cast("int").alias("seg_idx"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), "text")


def _searched(cues: DataFrame, segments: DataFrame, passes: list[tuple[float, int]]) -> DataFrame:
    """Rows (media_id, cue_idx, p0, p1, ...): for each pass the best span of all whose first segment lies in its band, or null.

    Cues (start_s, end_s, text, nearest, floor) meet blocks of segments, not spans: those that have a segment in the widest
    band, by buckets of time; a cue that has none in the narrowest meets all blocks of its medium, once each, as the rules
    let any span be its. What doesn't beat the floor, if there is one, isn't returned. A group is a block and cues of
    CUES consecutive numbers. Rows are sorted so that each group's segments come ahead of its cues, and a task goes through
    its rows with one block in memory; most groups are so small that handing them over one by one would cost time as well.
    """
    width, narrow = max(w for w, _ in passes), min(w for w, _ in passes)
    bucket = lambda c: F.floor(c / width).cast("long")
    middle = (F.col("start_s") + F.col("end_s")) / 2
    block = F.floor(F.col("seg_idx") / BLOCK).cast("long")
    met = segments.select("media_id", block.alias("block"), bucket(middle).alias("bucket")).distinct()
    c = cues.withColumn("chunk", F.floor(F.col("cue_idx") / CUES).cast("long"))
    near = c.filter(F.col("nearest") <= narrow).withColumn("bucket", F.explode(F.array(*[bucket(middle) + k for k in (-1, 0, 1)])))
    near = near.join(met, ["media_id", "bucket"]).drop("bucket").dropDuplicates(["media_id", "cue_idx", "block"])
    far = c.filter(F.col("nearest") > narrow).join(met.select("media_id", "block").distinct(), "media_id")
    asked = near.unionByName(far)
    key = ["media_id", "block", "chunk"]
    held = _blocks(segments).join(asked.select(*key).distinct(), ["media_id", "block"])
    held = held.select(*[F.col(c).alias(c) for c in held.columns])  # names of its own, as both sides descend from the same tables

    kind = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("token_start", pa.int32()), ("token_end", pa.int32()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found, base = None, 0
        for batch in batches:
            best: list[list] = [[] for _ in passes]
            for block, n, start, end, text, nearest, floor in zip(*(batch.column(c).to_pylist() for c in ("block", "seg_idx", "start_s", "end_s", "text", "nearest", "floor")), strict=True):
                if n is not None:  # a segment, and behind a cue the first one of a group
                    if found is not None:
                        held, found = [], None
                    held.append((n, start, end, text or ""))
                    continue
                if found is None:
                    numbers, starts, ends, texts = zip(*held, strict=True)
                    base = numbers[0]
                    own = sum(x < (block + 1) * BLOCK for x in numbers)
                    found = Block(list(texts), np.array(starts, np.float64), np.array(ends, np.float64), own, max(k for _, k in passes))
                gap = np.abs(found.center - (start + end) / 2)
                masks = [((gap <= w) | (nearest > w)) & (found.n <= k) for w, k in passes]
                for out, x in zip(best, found.search(text or "", start, end, masks, floor), strict=True):
                    out.append(x and {"i": base + x[0], "j": base + x[1], "token_start": x[2], "token_end": x[3], "score": x[4]})
            asking = batch.filter(batch.column("seg_idx").is_null())
            if asking.num_rows:
                yield pa.RecordBatch.from_arrays([asking.column("media_id"), asking.column("cue_idx"), *(pa.array(x, kind) for x in best)], names=["media_id", "cue_idx", *(f"p{p}" for p in range(len(passes)))])

    kinds = {c: cues.schema[c].dataType.simpleString() for c in ("media_id", "cue_idx")}
    schema = f"media_id {kinds['media_id']}, cue_idx {kinds['cue_idx']}, " + ", ".join(f"p{p} struct<i:int,j:int,token_start:int,token_end:int,score:double>" for p in range(len(passes)))
    both = asked.select(*key, "cue_idx", "start_s", "end_s", "text", "nearest", "floor").unionByName(held.select(*key, "seg_idx", "start_s", "end_s", "text"), allowMissingColumns=True)
    found = spread(both, *key).sortWithinPartitions(*key, F.col("seg_idx").asc_nulls_last()).mapInArrow(search, schema)
    order = lambda p: F.struct(-F.col(f"p{p}.score"), F.col(f"p{p}.i"), F.col(f"p{p}.j"))
    return found.groupBy("media_id", "cue_idx").agg(*[F.min_by(f"p{p}", F.when(F.col(f"p{p}").isNotNull(), order(p))).alias(f"p{p}") for p in range(len(passes))])


def best_windows(cues: DataFrame, segments: DataFrame, materialised: bool = False) -> DataFrame:
    """All columns of cues and match struct<i, j, token_start, token_end, score, method>; media without segments drop out.

    Segments are numbered without gaps. The ratio is only worked out for spans whose bound beats the best one so far.
    `materialised` tells that the lineage of segments is cut already.
    """
    key = ["media_id", "cue_idx"]
    segments = segments if materialised else cut(segments.select("media_id", "seg_idx", "start_s", "end_s", "text"))
    near = nearest_segment(cues, segments).select(*key, F.col("seg_idx").alias("nearest_idx"), F.col("distance").alias("nearest"))
    time = lambda c: F.col(c).cast("double").alias(c)
    rows = cut(cues.select(*key, time("start_s"), time("end_s"), "text").join(near, key))  # cues and segments are read again and again below
    match = lambda c, method: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{x}").alias(x) for x in ("i", "j", "token_start", "token_end", "score")], F.lit(method).alias("method")))
    first = cut(_searched(rows.withColumn("floor", F.lit(None).cast("double")), segments, [FIRST_PASS]).select(*key, match("p0", "basic").alias("match")))
    weak = rows.join(first.filter(F.col("match.score") < WEAK), key).withColumn("floor", F.col("match.score"))
    # The later passes are searched at once and then gone through in order; only what beats the first one's score matters.
    later = _searched(weak.drop("match"), segments, LATER_PASSES).join(first, key)
    best = F.col("match")
    for p in range(len(LATER_PASSES)):
        more = match(f"p{p}", "expanded")
        best = F.when((best["score"] < WEAK) & (F.coalesce(more["score"], F.lit(-1.0)) > best["score"]), more).otherwise(best)
    later = later.select(*key, best.alias("better"))
    found = cut(rows.join(first, key).join(later, key, "left").withColumn("match", F.coalesce("better", "match")))
    # Phrase search in the segments around the nearest one, for cues that are still weak though close in time.
    lost = found.filter((F.col("match.score") < VERY_WEAK) & (F.col("nearest") <= CLOSE))
    around = lost.select(*key, "text", F.explode(F.sequence(F.col("nearest_idx") - 5, F.col("nearest_idx") + 5)).alias("seg_idx"))
    around = around.join(segments.select("media_id", "seg_idx", F.col("text").alias("t")), ["media_id", "seg_idx"])
    around = around.groupBy(*key, "text").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "t"))).alias("xs"))
    phrase = around.select(*key, F.get("xs", F.lit(0))["seg_idx"].alias("base"), phrase_search("text", F.transform("xs", lambda v: v["t"])).alias("f")).filter(F.col("f.score") >= PHRASE)
    none = F.lit(None).cast("int")
    phrase = phrase.select(*key, F.struct((F.col("base") + F.col("f.first")).cast("int").alias("i"), (F.col("base") + F.col("f.last") + 1).cast("int").alias("j"), none.alias("token_start"), none.alias("token_end"), F.col("f.score").alias("score"), F.lit("fuzzy").alias("method")).alias("phrase"))
    matched = found.join(phrase, key, "left").select(*key, F.coalesce("phrase", "match").alias("match"))
    return cues.join(matched, key)


def refined_times(parts: Column, token_start: Column, token_end: Column, second: float = 1.0) -> Column:
    """struct<start_s, end_s> of the tokens [token_start, token_end) of a span, each segment's time spread over its words.

    parts: array<struct<start_s, end_s, n>> of the span's segments, n words each. Without tokens, the span's own times.
    Times are in the unit of which `second` make a second.
    """
    span_start, span_end = F.get(parts, F.lit(0))["start_s"], F.element_at(parts, -1)["end_s"]
    words = lambda p: F.greatest(F.coalesce(p["n"], F.lit(0)), F.lit(0)).cast("int")
    size = F.aggregate(parts, F.lit(0), lambda seen, p: seen + words(p))

    def token(nth: Column) -> Column:
        """struct<seen, s, e, n, k> of the segment of a token, which is its k-th of n."""
        of = lambda seen, s, e, n, k: F.struct(seen.alias("seen"), s.cast("double").alias("s"), e.cast("double").alias("e"), n.cast("int").alias("n"), k.cast("int").alias("k"))
        none = F.lit(None)
        inside = lambda acc, p: (nth >= acc["seen"]) & (nth < acc["seen"] + words(p))
        step = lambda acc, p: F.when(inside(acc, p), of(acc["seen"] + words(p), p["start_s"], p["end_s"], words(p), nth - acc["seen"])).otherwise(of(acc["seen"] + words(p), acc["s"], acc["e"], acc["n"], acc["k"]))
        return F.aggregate(parts, of(F.lit(0), none, none, none, none), step)

    at = lambda w, k: w["s"] + (k / w["n"]) * F.greatest(F.lit(1e-6 * second), w["e"] - w["s"])

    def timed(a: Column, b: Column) -> Column:
        begin = F.least(F.greatest(at(a, a["k"]), span_start), span_end)
        return let(begin, lambda start: F.struct(start.alias("start_s"), F.least(F.greatest(at(b, b["k"] + 1), start + 1e-3 * second), span_end).alias("end_s")))

    def found(n: Column) -> Column:
        first = F.greatest(F.lit(0), F.least(n - 1, token_start))
        last = F.least(n - 1, F.greatest(first + 1, F.least(n, token_end)) - 1)
        inner = let(token(first), lambda a: let(token(last), lambda b: timed(a, b)))
        return F.when(token_start.isNull() | (n == 0), F.struct(span_start.cast("double").alias("start_s"), span_end.cast("double").alias("end_s"))).otherwise(inner)

    return let(size, found)


def span_parts(matched: DataFrame, segments: DataFrame) -> DataFrame:
    """Add span_text (texts that aren't empty) and parts of match.i to match.j."""
    s = segments.withColumn("n", core_counts("text")).select("media_id", "seg_idx", F.struct("seg_idx", F.col("start_s"), F.col("end_s"), F.col("n"), "text").alias("part"))
    key = ["media_id", "cue_idx"]
    inside = matched.select(*key, F.explode(F.sequence(F.col("match.i"), F.col("match.j") - 1)).alias("seg_idx")).join(s, ["media_id", "seg_idx"])
    parts = inside.groupBy(*key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["text"] != ""), lambda p: p["text"]), " ")
    return matched.join(parts, key).withColumn("span_text", text)
