"""Best-fit packing of documents into token sequences, certified by dual-feasible lower bounds.

Every document becomes token ids and an end id; only documents longer than a sequence are cut. Pieces are dealt
into partitions of bounded size and packed there best-fit decreasing. Dual-feasible functions bound the bins that a
partition needs from below. A partition whose bins meet its bound keeps them, but for its emptiest one; a partition
with a gap gives up all its bins that aren't full. What was given up is dealt anew, so partitions exchange
documents, and is packed again, until it fits one partition or hardly shrinks any more. `certificate` then tells how far
from the least possible the whole may be.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_for, pieces, sole_cache, text_bytes

#: Items that one task packs; bounds its memory.
PART_ITEMS = 50_000
#: Rounds go on while each leaves at most this share of what it was given.
SHRINKS = 0.9
#: Words whose ids a worker keeps.
CACHE_WORDS = 1_200_000
#: What packs so few ids as little-endian unsigned 32-bit integers, by their number.
PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]


class WordTokens:
    """Ids of texts by a tokenizer that drops white space, so words between ASCII white space are encoded apart."""

    def __init__(self, description: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        # The tokenizer lower-cases all but its special tokens, so words that differ in case are one entry.
        split = [(x if b"<|" in x else x.lower()).split() for x in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = list(set().union(*split).difference(known))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            for word, found in zip(some, self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), strict=True):
                ids = found.ids
                known[word] = PACKS[len(ids)](*ids) if len(ids) < len(PACKS) else struct.pack(f"<{len(ids)}I", *ids)
        return [b"".join(map(known.__getitem__, words)) for words in split]


_COMPILED: dict[int, WordTokens] = {}


def compiled(description: str) -> WordTokens:
    sole_cache("packing", _COMPILED.clear)
    key = hash(description)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = WordTokens(description)
    return _COMPILED[key]


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, deal[, ids]): the pieces of every document in order."""
    with open(vocabulary, encoding="utf-8") as f:
        description = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = compiled(description.value), 0
        for batch in pieces(batches):
            which, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, ids in enumerate(tokens.encode(batch.column("t").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    which.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int32))
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(which, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "deal": pa.array(range(seen, seen + len(which)), pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array(parts, pa.list_(pa.int32()))
            seen += len(which)
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, deal long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. Open bins lie by what they have left; a bit set finds the tightest that fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, count = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = some >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                some ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        rest = room - n
        if rest:
            if not left[rest]:
                some |= 1 << rest
            left[rest].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound by the dual-feasible functions that round up large items, and those that round to k-ths; sizes[n] items have length n."""
    x = np.arange(capacity + 1, dtype=np.int64)
    total = int((sizes * x).sum())
    best = -(-total // capacity)
    many, mass = np.cumsum(sizes), np.cumsum(sizes * x)
    for e in range(1, capacity // 2 + 1):  # under e: nothing; over capacity - e: a whole bin
        whole = many[-1] - many[capacity - e]
        best = max(best, int(whole + -(-(mass[capacity - e] - mass[e - 1]) // capacity)))
    for k in range(1, 21):
        u = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, int(-(-int((sizes * u).sum()) // (k * capacity))))
    return best


def pack(items: DataFrame, capacity: int, part_items: int = PART_ITEMS) -> DataFrame:
    """Add sequence_id and offset to rows with length (1 to capacity) and deal (any number that deals them out).

    An empty table stays empty. Rows that repeat are packed each by itself.
    """
    columns = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long, released boolean"

    def packed(part_column: str, turn: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            lengths = part["length"].to_numpy(np.int64)
            bins, offsets = best_fit_decreasing(lengths, capacity)
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
            gap = len(fill) - lower_bound(lengths, capacity)
            given = fill < capacity if gap > 0 else np.arange(len(fill)) == np.argmin(fill)
            given &= fill < capacity
            base = (turn << 56) + (int(part[part_column].iloc[0]) << 28)
            return part.drop(columns=part_column).assign(sequence_id=base + bins, offset=offsets, released=given[bins])

        return run

    done, left, turn, before = None, items, 0, None
    while True:
        count = left.count()
        parts = partitions_for(count, part_items)
        dealt = left.withColumn("__part", F.pmod(F.xxhash64(F.lit(turn), "deal", "length", "start", "piece"), F.lit(parts)).cast("long"))
        now = cut(dealt.groupBy("__part").applyInPandas(packed("__part", turn), schema))
        last = parts == 1 or (before is not None and count > SHRINKS * before)
        kept = (now if last else now.filter("not released")).select(*columns, "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        left, turn, before = now.filter("released").select(*columns), turn + 1, count


def certificate(packed: DataFrame, capacity: int) -> DataFrame:
    """One row (n_sequences, least_possible) of a packing (length, sequence_id): what it takes, and what any packing takes at least.

    The bound is that of all pieces, from how many there are of each length; nothing else is gathered.
    """
    sizes = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        sizes[r["length"]] = r["count"]
    least = bound_of(sizes, capacity) if sizes.any() else 0
    return packed.agg(F.count_distinct("sequence_id").alias("n_sequences")).withColumn("least_possible", F.lit(least).cast("long"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    docs has doc_id and text; other columns are ignored. A null or empty text is its end id alone. Null doc_ids and
    repeated rows are packed like any other. A document longer than `capacity` is cut into pieces of that length,
    the last of which may be shorter. An empty table gives no rows. `vocabulary` is a path on the driver.
    """
    items = cut(tokenized_pieces(docs, vocabulary, capacity, end_id))
    return pack(items, capacity).drop("deal")
