"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than half the allowed distance would leave untouched, so that of two
fingerprints within the distance some segment differs by at most one bit. Each segment is indexed once for each of
its bits, with that bit taken out; equal keys are joined and pairs verified. Only distinct fingerprints take part,
so copies cost nothing. A key of many fingerprints is cut into blocks and its pairs of blocks are dealt over tasks;
of each the task returns a spanning forest of its links, never all pairs. Groups by Jaccard similarity, of which no
distance of fingerprints is certain, are completed by a join on prefixes of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Membership, cut, partitions_for, pieces, release, sole_cache, text_bytes
from .graph import connected_components

BITS = 64
#: Fingerprints of one key that one task compares at a time.
BLOCK = 2_000
#: Hot keys that are broadcast at most (24 bytes each); more are joined by a shuffle.
HOT_BROADCAST = 50_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text: A-Z lower-cased, `width`-word shingles with repeats, XXH64 of each, majority of bits."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: max(1, len(words) - width + 1)].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(first)
    for i in range(0, n, 1 << 16):
        part = np.array([digest(joined[a:b], seed) for a, b in zip(first[i : i + (1 << 16)], last[i : i + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """Rows (doc_id, fp long), one per input row. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(x, width) for x in batch.column("t").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes().alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


#: (first bit, bits)
Segment = tuple[int, int]


def segments(count: int) -> list[Segment]:
    """`count` segments of a fingerprint. With distance // 2 + 1 of them, were each to differ by two bits, more than `distance` would."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(bits: int) -> int:
    return (1 << bits) - 1


def _segment(first: int, bits: int) -> Column:
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit(_mask(bits)).cast("long"))


def _variants(value: Column, first: int, bits: int) -> list[Column]:
    """Keys of a segment's value with one bit taken out, for each of its bits."""
    return [value.bitwiseAND(F.lit(_mask(bits) & ~(1 << i)).cast("long")) + F.lit((first + i) << 40).cast("long") for i in range(bits)]


def _hot_keys(distinct: DataFrame, layout: list[Segment], block: int) -> DataFrame:
    """(key, blocks) of keys of more than `block` fingerprints, or nearly so; a key's two values are counted for it."""
    values = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("s"), _segment(*x).alias("value")) for i, x in enumerate(layout)])).alias("x"))
    counts = values.groupBy("x.s", "x.value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block // 2)
    keys = F.array()
    for i, x in reversed(list(enumerate(layout))):
        keys = F.when(F.col("s") == i, F.array(*_variants(F.col("value"), *x))).otherwise(keys)
    return counts.select(F.explode(keys).alias("key"), "n").groupBy("key").agg(F.ceil((F.sum("n") + block // 2) / block).cast("int").alias("blocks"))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints."""
    return np.bitwise_count(a ^ b).astype(np.int64)


def _verified(a: np.ndarray, b: np.ndarray, bit: np.ndarray, layout: list[Segment], distance: int) -> np.ndarray:
    """Pairs within the distance, each under the first of the keys that it shares only."""
    canonical = np.full(len(a), -1, np.int64)
    for first, bits in layout:
        part = ((a ^ b) >> np.uint64(first)) & np.uint64(_mask(bits))
        here = (canonical < 0) & (np.bitwise_count(part) <= 1)
        where = np.where(part == 0, 0, np.bitwise_count(part - np.uint64(1)))  # of a single bit: its place
        canonical = np.where(here, first + where, canonical)
    return (_apart(a, b) <= distance) & (canonical == bit)


def _near_pairs(fps: np.ndarray, bit: int, layout: list[Segment], distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the verified pairs within one block, comparing some rows with all later ones at a time."""
    n = len(fps)
    step = max(1, (1 << 19) // n)
    for i in range(0, n, step):
        a, b = np.nonzero(_apart(fps[i : i + step, None], fps[None, i:]) <= distance)
        a, b = a[a < b] + i, b[a < b] + i
        good = _verified(fps[a], fps[b], np.full(len(a), bit), layout, distance)
        yield a[good], b[good]


def _forest(fps: np.ndarray, bit: int, layout: list[Segment], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one block, as places in it."""
    root = np.arange(len(fps))
    for a, b in _near_pairs(fps, bit, layout, distance):
        while True:
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while not np.array_equal(root[root], root):
                root = root[root]
    child = np.flatnonzero(root != np.arange(len(fps)))
    return root[child], child


def _keyed(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first `keys` of them, so that no key is cut; the last key of a batch waits for the next one."""
    rest: list[np.ndarray] = []
    for batch in batches:
        now = [batch.column(x).to_numpy(zero_copy_only=False) for x in columns]
        rest.append(np.stack(now))
        change = np.flatnonzero((rest[-1][:keys, 1:] != rest[-1][:keys, :-1]).any(axis=0)) + 1
        other = len(rest) > 1 and rest[-1].shape[1] > 0 and (rest[-1][:keys, 0] != rest[-2][:keys, -1]).any()
        if len(change) or other:
            rows = np.concatenate(rest, axis=1)
            tail = (int(change[-1]) if len(change) else 0) + rows.shape[1] - rest[-1].shape[1]
            rest = [rows[:, tail:]]
            yield list(rows[:, :tail])
        elif not rest[-1].shape[1]:
            rest.pop()
    if rest:
        yield list(np.concatenate(rest, axis=1))


def _sizes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of sorted keys its place within its key, and the rows of the key."""
    change = np.zeros(len(keys[0]), bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change)])
    sizes = np.diff(np.append(starts, len(keys[0])))
    return np.arange(len(keys[0])) - np.repeat(starts, sizes), np.repeat(sizes, sizes)


def links(distinct: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Rows (a, b): links of distinct fingerprints (fp long) whose components are those of all pairs within the distance."""
    layout = segments(distance // 2 + 1)
    hot = cut(_hot_keys(distinct, layout, block))
    n_hot = hot.count()
    keys = distinct.select(F.explode(F.array(*[k for x in layout for k in _variants(_segment(*x), *x)])).alias("key"), "fp")
    if n_hot:
        keys = keys.join(F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.coalesce("blocks", F.lit(1)) > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0))))
        keys = keys.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
        keys = keys.select("key", (F.least("own", "other").cast("long") * (1 << 31) + F.greatest("own", "other")).alias("blocks"), "fp")
    else:
        keys = keys.select("key", F.lit(0).cast("long").alias("blocks"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, fingerprints too, so that a task run again gives the same links."""
        for key, blocks, fp in _keyed(batches, ["key", "blocks", "fp"], 2):
            if len(key):
                yield found(key >> 40, fp.view(np.uint64), *_sizes(key, blocks))

    def found(bit: np.ndarray, fps: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        few = np.where(size <= 16, size, 0)
        pairs = [(fps[:0], fps[:0])]
        for s in range(1, int(few.max(initial=0))):
            i = np.flatnonzero(at + s < few)
            i = i[_verified(fps[i], fps[i + s], bit[i], layout, distance)]
            pairs.append((fps[i], fps[i + s]))
        for a in np.flatnonzero((at == 0) & (size > 16)).tolist():
            own = fps[a : a + size[a]]
            x, y = _forest(own, int(bit[a]), layout, distance)
            pairs.append((own[x], own[y]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in pairs]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return keys.repartition("key", "blocks").sortWithinPartitions("key", "blocks", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per input row.

    docs has doc_id and text; other columns are ignored. Null texts count as empty; texts of no word have the
    fingerprint zero and are linked like any other. component_id is the smallest doc_id of those reachable over
    links of at most `distance` differing bits; null doc_ids count only where there is no other (then it is null).
    Repeated rows are given each. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(connected_components(links(distinct.select("fp"), distance, block)))
    of = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Least ids are kept apart: both sides of the joins are plain shuffles then, and a root or fingerprint of many rows is split.
    least = cut(of.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(of.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by similarity. The links of fingerprints come first; a join on prefixes of shingles then finds whatever they miss.


def _majority(digests: bytes) -> int:
    """The bits that more than half of the 64-bit digests have."""
    ones, n = np.zeros(BITS, np.int64), len(digests) // 8
    for i in range(0, len(digests), 1 << 19):
        part = np.frombuffer(digests[i : i + (1 << 19)], np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _text_name(words: list[bytes]) -> int:
    """A signed 64-bit name of a word sequence."""
    name = xxhash.xxh3_64_intdigest(b" ".join(words))
    return name - (name >> 63 << 64)


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles; of fewer words, of the whole sequence."""
    if not words:
        return np.zeros(0, np.int64)
    whole = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, whole), np.uint64, len(whole))).view(np.int64)


#: Bytes of text that are taken apart at a time.
PIECE = 1 << 20
#: Texts from which the frequencies of shingles are estimated, and the frequent shingles whose rank is broadcast (16 bytes
#: each). They set the order of shingles only; any order gives the same links.
SAMPLE_TEXTS = 20_000
RANKED = 200_000
#: Places by which two texts of one key lie apart in the first round, and how this grows in the next ones.
REACH = 2
GROWTH = 8
#: Texts asked for whose ids are broadcast at most (24 bytes each); more are joined by a shuffle.
ASKED_BROADCAST = 50_000
#: What a step moves at a time: so much of the bytes of all shingles (8 each), or MOVED_LEAST if that is more. A step that would
#: move more goes in parts, one after another.
MOVED_SHARE = 0.5
MOVED_LEAST = 256 << 20
#: Bytes of a row of prefixes and of a row of pairs' keys as they are moved.
PREFIX_BYTES = 32
KEY_BYTES = 100

#: Bits of the sketch of a text, as two columns.
SKETCH_BITS = 128


def _sketch(s: np.ndarray) -> tuple[int, int]:
    """For each of SKETCH_BITS bins, whether an odd number of a text's shingles fall into it.

    A bin that two texts differ in has a shingle that only one of them has, so the number of such bins is at most that of
    the shingles that they don't share.
    """
    odd = np.bincount(s & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    first, second = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
    return first, second


def _whole_sketch(s: np.ndarray) -> bytes:
    """A sketch of as many bins as a text's shingles need, so that texts of any length that share few of them differ in more bins than similar ones may.

    The bins are a power of two, at least two for each three shingles. Halves of a sketch laid upon each other are the sketch of half the bins.
    """
    bins = 1 << max(7, (-(-2 * len(s) // 3) - 1).bit_length())
    return np.packbits((np.bincount(s & (bins - 1), minlength=bins) & 1).astype(np.uint8)).tobytes()


def _differing_bins(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The bins that two sketches differ in, the longer one folded to the shorter one's length."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([[len(x) for x in a], [len(x) for x in b]], np.int64)
    for kind in np.unique(sizes, axis=1).T:
        at, least = np.flatnonzero((sizes == kind[:, None]).all(axis=0)), int(kind.min())
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1, least // 8), axis=1) for side in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def likely_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b, n) of the pairs (a, b) whose sketches (of texts: th, n, sketch) leave room for the similarity; n is the number of shingles of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            differ = _differing_bins(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())
            near = differ <= (1 - similarity) / (1 + similarity) * batch.column("n").to_numpy() + 1e-9
            yield batch.select(["a", "b", "n"]).filter(pa.array(near))

    side = lambda x: texts.select(F.col("th").alias(x), F.col("n").cast("long").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, n long")


def _shingle_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = [shingles(x.lower().split(), width) for x in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(found))})


def text_rows(base: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows (doc_id, text_hash, th, fp, s1, s2, sketch, n, keys), one per row of base (doc_id, text_hash, t).

    th names the word sequence, fp is the SimHash of its n shingles, s1 and s2 are their short sketch, sketch is the whole one. keys is its prefix: the shingles of a text are put
    in an order that is the same for all, frequent ones last, and two texts at the similarity share one of their first
    n - ceil(similarity * n) + 1.
    """
    part = max(1, base.count() // SAMPLE_TEXTS)
    sample = base.filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0).select("t").mapInArrow(lambda it: _shingle_rows(it, width), "key long")
    often = sample.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 2").orderBy(F.desc("c"), "key").limit(RANKED).toArrow()
    frequent, c = (often.column(x).to_numpy() for x in ("key", "c"))
    by_key = np.argsort(frequent)
    rank = np.empty(len(c), np.int64)
    rank[np.lexsort((frequent, c))] = np.arange(1, len(c) + 1)
    ranked = base.sparkSession.sparkContext.broadcast((frequent[by_key], rank[by_key]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("simhash", lambda: None)
        known, ranks = ranked.value
        for batch in pieces(batches, limit=PIECE):
            ths, fps, sketches, whole, ns, keys = [], [], [], [], [], []
            for text in batch.column("t").to_pylist():
                words = text.lower().split()
                s = shingles(words, width)
                ths.append(_text_name(words))
                fps.append(_majority(s.tobytes()))
                sketches.append(_sketch(s))
                whole.append(_whole_sketch(s))
                ns.append(len(s))
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, ranks[at], 0), kind="stable")]
                keys.append(s[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(ths, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), *(pa.array(x, pa.int64()) for x in zip(*sketches, strict=True)), pa.array(whole, pa.binary()), pa.array(ns, pa.int32()), pa.ListArray.from_arrays(ends, np.concatenate(keys))],
                names=["doc_id", "text_hash", "th", "fp", "s1", "s2", "sketch", "n", "keys"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, text_hash long, th long, fp long, s1 long, s2 long, sketch binary, n int, keys array<long>")


def _among(part: int, parts: int, *columns: str) -> Column:
    """Whether a row is of one of `parts`, by a hash of its columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)) == part


def shared_prefixes(rows: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """Rows (key, th, n_pos, ahead, ahead2, size) of texts (th, n, keys), where a key is shared by two texts or more: keys of one of `parts`.

    n_pos holds n and the place of the key among the n shingles, 32 bits each, ahead and ahead2 are the keys one and two
    places ahead (0: none), size the number of texts that have the key in their prefix.
    """
    names = ["key", "n_pos", "th", "ahead", "ahead2"]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _keyed(batches, names):
            key, _, th, *_ = rows
            if not len(key):
                continue
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (th[1:] != th[:-1])  # equal texts
            _, size = _sizes(key[once])
            good = size > 1
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[good], pa.int64()) for x in (*(x[once] for x in rows), size)], names=[*names, "size"])

    each = rows.select("n", "th", "keys", F.posexplode("keys").alias("pos", "key")).filter(_among(part, parts, "key"))
    each = each.select("key", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("n_pos"), "th", *[F.coalesce(F.get("keys", F.col("pos") - k), F.lit(0)).alias(x) for k, x in ((1, "ahead"), (2, "ahead2"))])
    return each.repartition("key").sortWithinPartitions("key", "n_pos", "th").mapInArrow(shared, "key long, n_pos long, th long, ahead long, ahead2 long, size long")


def _key_parts(low: int, high: int, block: int) -> Column:
    """The tasks that a key of so many texts is dealt over."""
    return F.greatest(F.lit(1), F.least(F.lit(high - low), F.ceil(F.col("size") / block))).cast("long")


def prefix_pairs(shared: DataFrame, texts: DataFrame, roots: DataFrame, low: int, high: int, similarity: float, block: int) -> DataFrame:
    """Rows (a, b): texts of one key from `low` to less than `high` places apart that may be similar and have not the same root.

    Texts of a key lie in the order of their numbers of shingles. A key of many texts is dealt over tasks, each of which
    takes some of the distances. Two texts that have one of the two keys ahead in common too meet there, if in another round.
    Two whose sketches (of texts: th, s1, s2) differ in more bins than similar ones have shingles apart aren't put out.
    """
    of = texts.select("th", "s1", "s2").join(roots.select(F.col("node").alias("th"), "root"), "th", "left")
    parts = _key_parts(low, high, block)
    rows = shared.filter(F.col("size") > low).join(of, "th").select("key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "n_pos", "th", "ahead", "ahead2", F.coalesce("root", "th").alias("root"), parts.alias("parts"), "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, n_pos, th, ahead, ahead2, root, parts, s1, s2 in _keyed(batches, ["key", "part", "n_pos", "th", "ahead", "ahead2", "root", "parts", "s1", "s2"], 2):
            if not len(key):
                continue
            s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
            at, size = _sizes(key, part)
            n, pos = n_pos >> 32, n_pos & _mask(32)
            a, b, held = [], [], 0
            live = np.arange(len(key))
            for s in range(low, min(high, int(size.max()))):
                live = live[at[live] + s < size[live]]
                live = live[n[live] >= similarity * n[live + s] - 1e-9]  # later ones are longer still
                if not len(live):
                    break
                i = live[s % parts[live] == part[live]]
                i = i[root[i] != root[i + s]]
                j = i + s
                before = np.zeros(len(i), bool)
                for x in (ahead, ahead2):
                    before |= (x[i] != 0) & ((x[i] == ahead[j]) | (x[i] == ahead2[j]))
                i, j = i[~before], j[~before]
                enough = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9
                i, j = i[enough], j[enough]
                differ = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
                enough = differ <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-9
                a.append(np.minimum(th[i], th[j])[enough])
                b.append(np.maximum(th[i], th[j])[enough])
                held += len(a[-1])
                if held > 1 << 18:
                    yield out(a, b)
                    a, b, held = [], [], 0
            if held:
                yield out(a, b)

    def out(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.RecordBatch.from_pydict({"a": pa.array(np.ascontiguousarray(both[0])), "b": pa.array(np.ascontiguousarray(both[1]))})

    return rows.repartition("key", "part").sortWithinPartitions("key", "part", "n_pos", "th").mapInArrow(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, text_hash, component_id, stays), one per input row: groups over links of Jaccard similarity of `width`-word shingles.

    Words are as in `near_duplicates`. First come links of SimHashes of the distinct shingles, by deletion variants; all
    others are found by a join on prefixes of shingles, which misses none. The join compares the texts of a key in
    rounds of growing distance, and leaves out those that links found so far connect, until every pair of every key
    was had. Every candidate whose sketches leave room is verified on all its shingles. Texts without words are linked to each other.

    text_hash is Spark's xxhash64 of the text (null as empty), which tells rows of one doc_id apart. component_id is the
    least doc_id of the group. The row of the least (doc_id, text_hash) of a group stays, with its exact repeats. A null
    doc_id is a row of its own: it stays and its component_id is null.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), text_bytes().alias("t"))
    found = cut(text_rows(base, width, similarity))
    rows = cut(found.select("doc_id", "text_hash", "th"))
    texts = found.filter(F.col("doc_id").isNotNull()).groupBy("th").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), *[F.first(c).alias(c) for c in ("fp", "s1", "s2", "n", "sketch")])
    texts = cut(texts.select("th", "fp", "s1", "s2", "n", "sketch", "least.*"))
    n_texts, n_shingles = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts_of = lambda size: partitions_for(int(size), max(MOVED_LEAST, int(MOVED_SHARE * 8 * n_shingles)))
    once = found.join(texts.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    others = cut(rows.join(texts.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash"))
    if others.count() <= ASKED_BROADCAST:  # few repeats: prefixes stay where they are
        once = found.join(F.broadcast(others), found["doc_id"].eqNullSafe(others["doc_id"]) & (found["text_hash"] == others["text_hash"]), "left_anti")

    def in_parts(parts: int, of: Callable[[int], DataFrame]) -> DataFrame:
        """Its parts, materialised one after another, so that what one moves is gone when the next begins."""
        done = None
        for part in range(parts):
            if part:
                release(spark)
            more = cut(of(part))
            done = more if done is None else done.unionByName(more)
        return done

    release(spark)
    parts = parts_of(PREFIX_BYTES * ((1 - similarity) * n_shingles + n_texts))
    keys = in_parts(parts, lambda part: shared_prefixes(once, part, parts))
    del found, once
    release(spark)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE):
            found = [shingles(x.lower().split(), width) for x in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "s"])

    def verified(candidates: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""
        likely = cut(likely_pairs(candidates, texts, similarity))
        n = likely.agg(F.sum("n")).first()[0]
        if n is None:
            return candidates.limit(0)
        parts = parts_of(8 * n)

        def of(part: int) -> DataFrame:
            pairs = likely.filter(_among(part, parts, "b")).select("a", "b")
            asked = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct()
            asked = cut(asked.join(texts, "th").select("th", "doc_id", "text_hash"))
            # Only texts asked for are taken apart and moved, but for a few that the join then leaves out.
            some = Membership(asked, ["doc_id", "text_hash"])
            own = some.marked(base).mapInArrow(lambda it: sets(some.chosen(it, True)), f"doc_id {kind}, text_hash long, s array<long>")
            first = own.join(F.broadcast(asked) if asked.count() <= ASKED_BROADCAST else asked, ["doc_id", "text_hash"]).select("th", "s").repartition("th")
            side = lambda x: first.select(F.col("th").alias(x), F.col("s").alias(f"s{x}"))
            shared = F.size(F.array_intersect("sa", "sb"))
            similar = F.when(F.size("sa") + F.size("sb") == 0, True).otherwise(shared >= similarity * (F.size("sa") + F.size("sb") - shared))
            return pairs.join(side("a"), "a").join(side("b"), "b").filter(similar).select("a", "b")

        found = in_parts(parts, of)
        release(spark)
        return found

    # Texts of one fingerprint are linked by way of the least of them; so are fingerprints.
    heads = cut(texts.groupBy("fp").agg(F.min("th").alias("head")))
    same = texts.join(heads, "fp").filter("th <> head").select(F.col("head").alias("a"), F.col("th").alias("b"))
    head = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}"))
    across = links(heads.select("fp"), distance, block).distinct().join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    tried = cut(same.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = cut(connected_components(verified(tried)))
    release(spark)
    most, low, high = keys.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0], 1, REACH + 1
    while low < most:
        dealt = keys.filter(F.col("size") > low).agg(F.coalesce(F.sum(_key_parts(low, high, block)), F.lit(0))).first()[0]
        parts = parts_of(KEY_BYTES * dealt)
        near = lambda part, parts=parts, low=low, high=high, roots=roots, tried=tried: prefix_pairs(keys.filter(_among(part, parts, "key")), texts, roots, low, high, similarity, block).join(tried, ["a", "b"], "left_anti")
        more = in_parts(parts, near) if parts == 1 else cut(in_parts(parts, near).distinct())
        if not more.isEmpty():
            tried = tried.unionByName(more)
            found = verified(more)
            if not found.isEmpty():
                known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                roots = cut(connected_components(known.unionByName(found)))
        low, high = high, high * GROWTH
        release(spark)
    of = cut(texts.join(roots, F.col("th") == F.col("node"), "left").select("th", F.coalesce("root", "th").alias("root"), F.struct("doc_id", "text_hash").alias("least")))
    # Kept apart, so that both sides of the joins are plain shuffles and a group of many rows is split.
    first = cut(of.groupBy("root").agg(F.min("least").alias("first")))
    named = cut(of.join(first, "root").select("th", "first"))
    stays = F.col("doc_id").isNull() | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    return rows.join(named, "th", "left").select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("first.doc_id")).alias("component_id"), stays.alias("stays"))
