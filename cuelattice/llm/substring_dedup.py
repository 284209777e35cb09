"""Removal of long passages that repeat across documents, by recompression.

Each round of recompression names maximal runs of one symbol, then pairs of a symbol of the left class and one of the
right class; the class is a bit of the name, and a name is a hash of its parts, so all tasks give equal strings equal
names without asking each other. Whether a symbol comes out depends on a bounded stretch of words only, which is kept
with it. A symbol whose stretch lies within a window is found in every occurrence of that window, at the same place.
So each window names one of its symbols (the one of least hash) as its anchor. Spark gathers the anchors' names of all
documents, one for each stretch of consecutive windows that share it, and those that one document has alone are done with.

Names only reveal what may repeat. It is verified on the words: stretches of one anchor are equal if a 128-bit
cryptographic digest of their words is, which doesn't depend on names. Stretches of equal words are settled by the
least document that has them. Where the words of one anchor differ, one document of each text is looked at window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, release, sole_cache, text_bytes

WINDOW = 50
#: Rounds of recompression; symbols then hold two to three words on average.
ROUNDS = 3
#: Distinct words whose names a worker keeps.
CACHE_WORDS = 600_000

FAR = np.int64(1) << 40
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word) or 1
        return name


_NAMES = _Names()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            some = np.full(n, base, np.uint64)
            some[0] = 1
            _powers[k] = np.multiply.accumulate(some)
    return _powers


class Hashes:
    """Hashes of any stretch of a sequence of names, to tell anchors apart."""

    def __init__(self, names: np.ndarray):
        up, self.down = _power(len(names) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * up[: len(names)], dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def digests(texts: list[list[bytes]], of: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a digest of the words first:stop of text `of`, for each of many such stretches, in the order of texts."""
    out = []
    for i, a, b in zip(*_runs(of), strict=True):
        sizes = np.fromiter(map(len, texts[i]), np.int64, len(texts[i])) + 1
        ends = np.cumsum(sizes)
        whole = memoryview(b" ".join(texts[i]))
        from_, to = (ends - sizes)[first[a:b]].tolist(), (ends - 1)[stop[a:b] - 1].tolist()
        out += [blake2b(whole[x:y], digest_size=16).digest() for x, y in zip(from_, to, strict=True)]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _runs(of: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The runs of equal numbers: number, first and end."""
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)][: len(first)]


def symbols(names: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, low, high) after some rounds; [low, high) are the words that a symbol depends on.

    Names of zero are walls: they merge with nothing, and what touches one depends on words beyond any bound.
    """
    name, at = names, np.arange(len(names), dtype=np.int64)
    low, high = np.where(name == 0, -FAR, at), np.where(name == 0, FAR, at + 1)
    for turn in range(rounds):
        # Runs. That a run is maximal depends on the symbols on either side.
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (name[1:] == 0)]))
        size = np.diff(np.concatenate([first, [len(name)]]))
        last = first + size - 1
        run = mix(name[first] ^ mix(size.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)))
        new_low = np.minimum(low[first], low[np.maximum(first - 1, 0)])
        new_high = np.maximum(high[last], high[np.minimum(last + 1, len(name) - 1)])
        name = np.where((size > 1) & (name[first] != 0), run, name[first])
        low, high, at = new_low, new_high, at[first]
        # Pairs. A left symbol alone depends on the one behind it, a right symbol on the one ahead of it.
        bit = mix(name ^ np.uint64(0x5851F42D4C957F2D * (turn + 1) & (2**64 - 1))) >> np.uint64(63)
        left, right = (bit == 0) & (name != 0), (bit == 1) & (name != 0)
        opens = np.concatenate([left[:-1] & right[1:], [False]])
        keep = np.flatnonzero(~np.concatenate([[False], opens[:-1]]))
        after, before = np.minimum(keep + 1, len(name) - 1), np.maximum(keep - 1, 0)
        pair = mix(name[keep] * np.uint64(0x9FB21C651E98DF25) + mix(name[after]))
        new_low = np.where(right[keep], np.minimum(low[keep], low[before]), low[keep])
        new_high = np.where(left[keep], np.maximum(high[keep], high[after]), high[keep])
        name = np.where(opens[keep], pair, name[keep])
        low, high, at = new_low, new_high, at[keep]
    return name, at, low, high


def _least(order: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The place of the least of order[first:stop] (the leftmost of equals), by a table of powers of two."""
    size = stop - first
    level = np.frexp(size.astype(np.float64))[1] - 1
    table, out = np.arange(len(order)), np.empty(len(first), np.int64)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            a, b = table[:-half], table[half:]
            table = np.where(order[b] < order[a], b, a)
        here = np.flatnonzero(level == k)
        a, b = table[first[here]], table[stop[here] - (1 << k)]
        out[here] = np.where(order[b] < order[a], b, a)
    return out


def sequence(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words with a wall ahead of, between and behind the texts, and the place of each text's first word."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths
    names = np.zeros(int(lengths.sum()) + len(texts) + 1, np.uint64)
    for words, start in zip(texts, starts.tolist(), strict=True):
        names[start : start + len(words)] = np.fromiter(map(_NAMES.__getitem__, words), np.uint64, len(words))
    return names, starts


def anchors(texts: list[list[bytes]], window: int = WINDOW, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Stretches of windows of one anchor: text (its number), key, first and last window, place (of the anchor in the stretch)."""
    sole_cache("substring", _NAMES.clear)
    names, starts = sequence(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(0, lengths - window + 1)
    text = np.repeat(np.arange(len(texts)), counts)
    p = starts[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(p):
        none = np.zeros(0, np.int64)
        return {"text": none, "key": none, "first": none, "last": none, "place": none}
    name, at, low, high = symbols(names, rounds)
    ok = (name != 0) & (low >= 0) & (high < FAR) & (high - low <= window)
    name, at, low, high = name[ok], at[ok], low[ok], high[ok]
    begin, end = np.searchsorted(low, p, "left"), np.searchsorted(high, p + window, "right")
    some = np.flatnonzero(end > begin)
    anchor = -1 - np.arange(len(p))  # no symbol lies within: each window is its own anchor
    anchor[some] = _least(mix(name ^ np.uint64(0x8CB92BA72F3D8DD7)), begin[some], end[some])
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    p1, p2, of, anchor = p[first], p[last], text[first], anchor[first]
    own = anchor < 0
    at_ = np.where(own, 0, anchor)
    if len(name):
        lo, hi, place = np.where(own, p1, low[at_]), np.where(own, p1 + window, high[at_]), np.where(own, p1, at[at_])
    else:
        lo, hi, place = p1, p1 + window, p1
    key = mix(Hashes(names).of(lo, hi) ^ mix((place - lo).astype(np.uint64) + own.astype(np.uint64) * np.uint64(1 << 32)))
    return {"text": of, "key": key.view(np.int64), "first": p1 - starts[of], "last": p2 - starts[of], "place": place - p1}


def _key_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, limit=2 << 20):
        found = anchors([x.split() for x in batch.column("t").to_pylist()], window)
        yield pa.RecordBatch.from_arrays([pa.array(found["key"]), batch.column("doc_id").take(pa.array(found["text"]))], names=["key", "doc_id"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The stretches with the digest of their words (a, b), into which the anchor's place goes."""
    for batch in pieces(batches, limit=2 << 20):
        texts = [x.split() for x in batch.column("t").to_pylist()]
        found = anchors(texts, window)
        rows = pa.array(found["text"])
        words = digests(texts, found["text"], found["first"], found["last"] + window) ^ mix(found["place"].astype(np.uint64) + np.uint64(0x1000003)).view(np.int64)[:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found["key"]), *(pa.array(np.ascontiguousarray(words[:, k])) for k in (0, 1)), batch.column("doc_id").take(rows), batch.column("th").take(rows), *(pa.array(found[x].astype(np.int32)) for x in ("first", "last"))],
            names=["key", "a", "b", "doc_id", "th", "first", "last"],
        )


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The digest of the words of each window of the stretches asked for."""
    for batch in pieces(batches, limit=2 << 20):
        texts = [x.split() for x in batch.column("t").to_pylist()]
        at = [np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in xs])) for xs in batch.column("spans").to_pylist()]
        of, first = np.repeat(np.arange(len(texts)), [len(x) for x in at]), np.concatenate(at)
        words = digests(texts, of, first, first + window)
        rows = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(np.ascontiguousarray(words[:, k])) for k in (0, 1)), batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(first.astype(np.int32))],
            names=["wa", "wb", "doc_id", "th", "first"],
        )


def _kept_rows(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        n_words, n_removed, digest, kept = [], [], [], []
        for text, spans in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            if spans:
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [x["first"] for x in spans], 1)
                np.add.at(change, [x["last"] + window for x in spans], -1)
                words = [w for w, c in zip(words, np.cumsum(change[:-1]).tolist(), strict=True) if not c]
            joined = b" ".join(words)
            n_removed.append(n_words[-1] - len(words))
            digest.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept.append(joined.decode())
        out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256[, kept]), one per input row.

    docs has doc_id and text; other columns are ignored. A word goes if a window of `window` words covers it whose
    word sequence also starts in a document with a smaller doc_id. Null and empty texts have no words. A row with a
    null doc_id has no order: it loses nothing and takes nothing from others. Rows that repeat a doc_id take nothing
    from each other. Texts of fewer words than a window stay. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    every = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), text_bytes().alias("t"))
    base = every.filter(F.col("doc_id").isNotNull())
    # Worked out twice rather than kept: the anchors are cheaper to find again than to write.
    keys = base.select("doc_id", "t").mapInArrow(lambda it: _key_rows(it, window), f"key long, doc_id {kind}")
    each = base.mapInArrow(lambda it: _anchor_rows(it, window), f"key long, a long, b long, doc_id {kind}, th long, first int, last int")
    # Kept apart, so that both sides of the join are plain shuffles and a key of many rows is split.
    shared = cut(keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("key"))
    common = cut(each.join(shared, "key"))
    classes = cut(common.groupBy("key", "a", "b").agg(F.min("doc_id").alias("owner")))
    release(docs.sparkSession)
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    owned = common.join(classes, ["key", "a", "b"]).select("key", "doc_id", "th", "first", "last", "owner")
    spans = F.collect_set(F.struct("first", "last")).alias("spans")
    whole = owned.filter("doc_id > owner").select("doc_id", "th", "first", "last")
    unclear = owned.filter("doc_id = owner").join(several, "key").groupBy("doc_id", "th").agg(spans)
    # From here on it is one plan: both joins with the texts read the same shuffle.
    single = base.join(unclear, ["doc_id", "th"]).select("doc_id", "th", "t", "spans").mapInArrow(lambda it: _window_rows(it, window), f"wa long, wb long, doc_id {kind}, th long, first int")
    owner = single.groupBy("wa", "wb").agg(F.min("doc_id").alias("owner"))
    by_window = single.join(owner, ["wa", "wb"]).filter("doc_id > owner").select("doc_id", "th", "first", F.col("first").alias("last"))
    gone = whole.unionByName(by_window).groupBy("doc_id", "th").agg(spans)
    marked = base.join(gone, ["doc_id", "th"], "left").select("doc_id", "t", "spans")
    marked = marked.unionByName(every.filter(F.col("doc_id").isNull()).select("doc_id", "t", F.lit(None).cast(marked.schema["spans"].dataType).alias("spans")))
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return marked.mapInArrow(lambda it: _kept_rows(it, window, with_text), schema)
