"""Exact deduplication with static binary-fuse filters over immutable snapshots.

A snapshot keeps one row per digest. Its digests are dealt into buckets and every bucket gets a static
binary-fuse filter (three probes, 8-bit fingerprints). Digests of an incoming batch are first grouped among
themselves, then screened by the filter of their bucket; only positives join the snapshot's exact buckets.
Texts of all rows that share a digest are compared byte for byte with their group's row of reference.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions_for, text_bytes

#: Digests a filter is built over; bounds the memory of one task.
BUCKET_DIGESTS = 50_000

FILTER_SCHEMA = "bucket int, seed long, segment int, segments int, cells binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _probes(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three cells in three adjacent segments, and the fingerprint, of each key."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    mask = np.uint64(segment - 1)
    again = _mix(h, 0x9E3779B97F4A7C15)
    inside = [again & mask, (again >> np.uint64(20)) & mask, (again >> np.uint64(40)) & mask]
    cells = np.stack([(first + i) * segment + x.astype(np.int64) for i, x in enumerate(inside)])
    return cells, (h & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, start segments, cells) of a binary-fuse filter over distinct 64-bit keys.

    Cells of degree one are peeled in rounds; keys peeled in one round never share a cell that another key of
    the round owns, so a whole round is assigned at once, last round first. A seed that does not peel is replaced.
    """
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return 0, 1, 1, b""
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    space = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 32
    segments = max(1, -(-space // segment) - 2)
    for seed in range(1, 200):
        cells, prints = _probes(keys, seed * 0x632BE59BD9B4E019 & (2**64 - 1), segment, segments)
        size = (segments + 2) * segment
        degree = np.bincount(cells.ravel(), minlength=size)
        owners = np.zeros(size, np.int64)  # xor of the keys' indexes in each cell
        index = np.arange(n)
        for row in cells:
            np.bitwise_xor.at(owners, row, index)
        alive, rounds, left = np.ones(n, bool), [], n
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            who, at = np.unique(owners[ready], return_index=True)
            cell = ready[at]
            ok = alive[who]
            who, cell = who[ok], cell[ok]
            if not len(who):
                break
            rounds.append((who, cell))
            alive[who] = False
            left -= len(who)
            touched = cells[:, who]
            np.subtract.at(degree, touched.ravel(), 1)
            np.bitwise_xor.at(owners, touched.ravel(), np.tile(who, 3))
            touched = np.unique(touched)
            ready = touched[degree[touched] == 1]
        if not left:
            out = np.zeros(size, np.uint8)
            for who, cell in reversed(rounds):
                others = out[cells[0, who]] ^ out[cells[1, who]] ^ out[cells[2, who]] ^ out[cell]
                out[cell] = prints[who] ^ others
            return seed, segment, segments, out.tobytes()
        if seed % 10 == 0:
            segments += max(1, segments // 10)
    raise RuntimeError("no seed peels this filter")


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    if not cells:
        return np.zeros(len(keys), bool)
    at, prints = _probes(keys, seed * 0x632BE59BD9B4E019 & (2**64 - 1), segment, segments)
    table = np.frombuffer(cells, np.uint8)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    """The 64-bit filter keys of digests: their first eight bytes."""
    return np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in digests), "<u8")


def bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    """One filter per bucket of an immutable snapshot (bucket, digest)."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, cells = build_filter(_keys(part["digest"]))
        return pd.DataFrame({"bucket": [part["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "segments": [segments], "cells": [cells]})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInPandas(build, FILTER_SCHEMA)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Add `positive` to distinct incoming digests (bucket, digest): false means certainly not in the snapshot."""

    def probe(new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known):
            return new.assign(positive=False)
        f = known.iloc[0]
        return new.assign(positive=may_contain(_keys(new["digest"]), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["cells"]))

    return incoming.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "bucket int, digest binary, positive boolean")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, is_new: Column | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per input row.

    docs has doc_id and text; other columns are ignored. Null texts count as empty. Of equal texts the largest
    doc_id stays; rows with a null doc_id rank below all others (a group of nothing else keeps one of its rows and
    has a null keep_id). Of rows that repeat one doc_id and text, one is kept. An empty table gives no rows.

    is_new tells rows of the incoming batch from those of the snapshot; unless given, about half of them are the
    batch, by a hash of doc_id, which may be of any type with an order. The result doesn't depend on the split. A long text
    is held by the task that hashes or compares it. `digest` exists for tests: texts are
    compared byte for byte, so a digest with collisions gives the same result.
    """
    texts = docs.select("doc_id", text_bytes().alias("t")).select("doc_id", "t", digest(F.col("t")).alias("digest"))
    side = F.lit(None).cast("boolean") if is_new is None else is_new
    hashed = cut(docs.select("doc_id", side.alias("new"), text_bytes().alias("t")).select("doc_id", "new", digest(F.col("t")).alias("digest"), sha256(F.col("t")).alias("sha")))
    count = hashed.count()
    new = F.coalesce("new", F.xxhash64("doc_id") > 0)

    # A row per digest and side. Partial sums meet first, so a hot digest is a few rows by the time it moves.
    sides = hashed.groupBy("digest", new.alias("new")).agg(F.max("doc_id").alias("ref"), F.count(F.lit(1)).alias("n"))
    sides = cut(bucketed(sides, partitions_for(count, BUCKET_DIGESTS)))
    snapshot, batch = sides.filter("not new"), sides.filter("new")
    positive = screen(batch, snapshot_filters(snapshot)).filter("positive").select("digest")
    # Exact buckets are joined for positives only; the rest of either side is grouped by itself.
    exact = positive.join(snapshot.select("digest", "ref", "n"), "digest")
    old = snapshot.filter("n > 1").select("digest", "ref", "n").join(positive, "digest", "left_anti")
    groups = batch.select("digest", "ref", "n").unionByName(exact).unionByName(old)
    groups = cut(groups.groupBy("digest").agg(F.max("ref").alias("ref"), F.sum("n").alias("n")).filter("n > 1").select("digest", "ref"))

    checked = cut(_byte_checked(texts, hashed, groups))
    sizes = checked.groupBy("digest", "part").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    first = F.row_number().over(Window.partitionBy("doc_id", "digest", "part").orderBy("sha")) == 1
    copies = checked.join(sizes, ["digest", "part"]).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"), "sha")
    alone = hashed.join(groups, "digest", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(copies).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _byte_checked(texts: DataFrame, hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (doc_id, digest, part, sha) of all groups: part is empty if the bytes equal those of the group's row of reference."""
    flagged = hashed.join(groups, "digest").select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "ref").distinct()
    members = texts.join(flagged, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))).select("doc_id", "digest", "ref", "t")
    refs = members.filter(F.col("doc_id").eqNullSafe(F.col("ref"))).groupBy("digest").agg(F.max("t").alias("ref_t"))
    part = F.when(F.col("t") == F.col("ref_t"), F.lit("").cast("binary")).otherwise(F.concat(F.lit("=").cast("binary"), F.col("t")))
    return members.join(refs, "digest").select("doc_id", "digest", part.alias("part"), sha256(F.col("t")).alias("sha"))
