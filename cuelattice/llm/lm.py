"""Language-model scores: prediction by partial matching over bytes, beside an add-one unigram base.

Counts of all byte windows of the training texts are summed by Spark. A byte is coded by its context: seen bytes by
their counts less one half each, the rest by an escape (half the distinct bytes over all counts) to the next shorter
context, without the bytes already offered, and at last evenly. Of every window that occurs, in texts to be scored too,
the code length is worked out once, by joins of the counts of all orders. The most frequent windows are broadcast, the
others joined, so that every counted context is used whatever their number.

Where a bound on the contexts is asked for, those that occur most form a trie instead; as counts fall with length, it
holds with a context all its suffixes and prefixes. The trie is then an automaton, and texts are scored by stepping
many segments through it at a time.

A text is its words, lower-cased and joined by single spaces, and an end symbol.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, release, sole_cache, text_bytes

#: Bytes of the longest context.
ORDER = 5
#: Contexts of a bounded model at most; with 256 symbols and 6 bytes an entry it bounds what is broadcast to 100 MB.
CONTEXTS = 65_535
#: Windows whose code lengths are broadcast: the most frequent ones (24 to 48 bytes each).
COMMON_WINDOWS = (1 << 22) - 1
#: Words whose counts are broadcast: the most frequent ones of at most WORD_BYTES bytes (14 MB at most).
COMMON_WORDS = 262_144
WORD_BYTES = 40
#: Neither byte occurs in UTF-8: what stands ahead of a text, and its end.
PAD, END = 0xFE, 0xFF
#: Symbols that one lane steps through.
SEGMENT = 256
#: Distinct words or windows that a task gathers before it hands them on.
GATHER = 1_000_000
#: Bytes of text that are taken at a time; a byte takes some 100 bytes of memory on its way.
PIECE = 1 << 20


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def joined(words: list[bytes]) -> bytes:
    return b" ".join(words)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null doc_id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, c long) over all rows (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return batch

        for batch in pieces(batches):
            for text in batch.column("t").to_pylist():
                counts.update(tokens(text))
            if len(counts) > GATHER:
                yield out()
        if counts:
            yield out()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _codes(texts: list[bytes]) -> np.ndarray:
    """The ORDER bytes ahead of each byte of the texts and of their ends, and that byte, in the order of the texts."""
    pad = bytes([PAD]) * ORDER
    buffer = np.frombuffer(pad + (bytes([END]) + pad).join(joined(tokens(x)) for x in texts) + bytes([END]), np.uint8)
    code = np.zeros(len(buffer) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | buffer[k : len(buffer) - ORDER + k]
    return code[buffer[ORDER:] != PAD]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of the windows of the texts."""
    code = _codes(texts)
    code.sort()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.diff(np.concatenate([first, [len(code)]]))


def window_counts(texts: DataFrame) -> DataFrame:
    """(code long, c long) over all rows (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            code, c = held.pop()
            return pa.RecordBatch.from_pydict({"code": pa.array(code.view(np.int64)), "c": pa.array(c.astype(np.int64))})

        for batch in pieces(batches, limit=PIECE):
            held.append(windows(batch.column("t").to_pylist()))
            if len(held) > 1:
                held = [_summed(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))]
            if len(held[0][0]) > GATHER:
                yield out()
        if held:
            yield out()

    return texts.mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    letters: np.ndarray  # byte -> column; the last column stands for bytes never seen
    step: np.ndarray  # context x column -> context
    log10p: np.ndarray  # context x column
    root: int


def build_model(contexts: np.ndarray, of: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> Model:
    """contexts: length << 40 | bytes, each once; of, symbol, count: how often a symbol follows a context."""
    contexts = np.unique(np.append(contexts, 0))
    length, code = contexts >> 40, contexts & ((1 << 40) - 1)
    seen = np.unique(symbol)
    letters = np.full(256, len(seen) + 1, np.int64)
    letters[PAD] = len(seen)
    letters[seen] = np.arange(len(seen))
    width, n = len(seen) + 2, len(contexts)
    counts = np.zeros((n, width))
    counts[np.searchsorted(contexts, of), letters[symbol]] = count
    shorter = np.zeros(n, np.int64)
    up = np.flatnonzero(length > 0)
    shorter[up] = np.searchsorted(contexts, ((length[up] - 1) << 40) | (code[up] & ((np.int64(1) << (8 * (length[up] - 1))) - 1)))
    prefix = ((length - 1) << 40) | (code >> 8)
    at = np.minimum(np.searchsorted(contexts, prefix), n - 1)
    step = np.zeros((n, width), np.uint16)
    for size in range(int(length.max()) + 1):
        here = np.flatnonzero(length == size)
        if size:
            step[here] = step[shorter[here]]
        longer = np.flatnonzero((length == size + 1) & (contexts[at] == prefix))
        step[at[longer], letters[code[longer] & 255]] = longer
    step[:, -1] = 0
    log10p = np.empty((n, width), np.float32)
    for i in range(0, n, 4096):
        rows = np.arange(i, min(n, i + 4096))
        p, escape = np.zeros((len(rows), width)), np.ones(len(rows))
        offered = np.zeros((len(rows), width), bool)
        level, live = rows.copy(), np.ones(len(rows), bool)
        while live.any():
            c = np.where(offered | ~live[:, None], 0, counts[level])
            total, distinct = c.sum(axis=1), (c > 0).sum(axis=1)
            some = total > 0
            share = np.where(some, escape / np.where(some, 2 * total, 1), 0)
            p += share[:, None] * np.maximum(2 * c - 1, 0)
            escape = np.where(some, share * distinct, escape)
            offered |= c > 0
            live &= level > 0
            level = shorter[level]
        # bytes that no context offered: evenly. PAD never follows; the last column is any one byte never seen.
        left = 255 - offered.sum(axis=1)
        p = np.where(offered, p, (escape / np.maximum(left, 1))[:, None])
        log10p[rows] = np.log10(p)
    return Model(letters, step, log10p, 0)


def score_texts(model: Model, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text (joined words) and its end. Long texts are cut into lanes that warm up on what precedes."""
    pad = bytes([PAD]) * ORDER
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    buffer = model.letters[np.frombuffer(b"".join(pad + x + bytes([END]) for x in texts), np.uint8)].astype(np.uint16)
    starts = np.cumsum(lengths + ORDER) - lengths
    lanes = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(texts)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    first, size = starts[doc] + nth * SEGMENT, np.minimum(SEGMENT, lengths[doc] - nth * SEGMENT)
    order = np.argsort(-size, kind="stable")
    first, size, doc = first[order], size[order], doc[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(SEGMENT), "right")
    width, step, log10p = model.step.shape[1], model.step.ravel(), model.log10p.ravel()
    state = np.full(len(first), model.root, np.int64)
    for t in range(ORDER):
        state = step[state * width + buffer[first - ORDER + t]].astype(np.int64)
    total = np.zeros(len(first))
    for t in range(SEGMENT):
        m = active[t]
        if not m:
            break
        at = state[:m] * width + buffer[first[:m] + t]
        total[:m] += log10p[at]
        state[:m] = step[at]
    return np.bincount(doc, total, len(texts))


def code_lengths(grams: DataFrame, others: DataFrame) -> DataFrame:
    """(code long, c long, v double): the log10 probability of every window of grams (code, c) and of others (code).

    What follows a context also follows its suffixes. So what an escape leaves to the next shorter context are its
    counts without those of the bytes that follow the longer one: two sums a context.
    """
    low = lambda c, k: c.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))
    suffix = lambda k: low(F.col("code"), k + 1)
    context = lambda c: F.shiftrightunsigned(c, 8)
    small = lambda df, k: F.broadcast(df) if k <= 2 else df  # noqa: E731; at most 65,536 rows, and keys that many rows have
    new = others.join(grams, "code", "left_anti")
    #: by order: g (a context's k bytes and the next byte, count); n (context, counts, distinct bytes)
    g = {ORDER: grams.select(F.col("code").alias("g"), "c")}
    for k in range(ORDER - 1, -1, -1):
        g[k] = cut(g[k + 1].groupBy(low(F.col("g"), k + 1).alias("g")).agg(F.sum("c").alias("c")))
    n = {k: g[k].groupBy(context(F.col("g")).alias("x")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d")) for k in g}
    n[ORDER] = cut(n[ORDER])
    seen = grams.join(n[ORDER], context(F.col("code")) == F.col("x")).select("code", "c", F.log10((2 * F.col("c") - 1) / (2.0 * F.col("n"))).alias("v"))
    # total, kinds: what the context at hand offers, where a longer one came before; v: the escapes so far.
    void = F.lit(None).cast("long")
    state = new.select("code", void.alias("total"), void.alias("kinds"), F.lit(0.0).alias("v"), F.lit(False).alias("done"))
    for k in range(ORDER, -1, -1):
        at = state.filter("not done").join(small(n[k], k), context(suffix(k)) == F.col("x"), "left").drop("x").join(small(g[k], k + 1), suffix(k) == F.col("g"), "left").drop("g")
        total, kinds = F.coalesce("total", "n", F.lit(0)), F.coalesce("kinds", "d", F.lit(0))
        some = total > 0
        v = F.when(F.col("c").isNotNull(), F.col("v") + F.log10((2 * F.col("c") - 1) / (2.0 * total))).when(some, F.col("v") + F.log10(kinds / (2.0 * total))).otherwise(F.col("v"))
        at = at.select("code", v.alias("v"), F.col("c").isNotNull().alias("done"), "n", "d")
        if k:
            # of the contexts asked for only: the shorter one's counts of the bytes that follow them
            asked = at.filter("not done and n is not null").select(context(suffix(k)).alias("x")).distinct()
            mine = g[k].withColumn("x", context(F.col("g"))).join(asked, "x", "left_semi").select("x", low(F.col("g"), k).alias("g"))
            taken = mine.join(small(g[k - 1], k), "g").groupBy("x").agg(F.sum("c").alias("taken"), F.count(F.lit(1)).alias("own"))
            shorter = n[k - 1].select(F.col("x").alias("s"), F.col("n").alias("sn"), F.col("d").alias("sd"))
            rest = taken.join(small(shorter, k - 1), low(F.col("x"), k - 1) == F.col("s")).select("x", (F.col("sn") - F.col("taken")).alias("total"), (F.col("sd") - F.col("own")).alias("kinds"))
            at = at.join(small(rest, k), context(suffix(k)) == F.col("x"), "left").select("code", "total", "kinds", "v", "done")
        else:
            # bytes that no context offered: evenly
            at = at.crossJoin(F.broadcast(g[0].agg((255 - F.count(F.lit(1))).alias("left")))).select("code", void.alias("total"), void.alias("kinds"), F.when(F.col("done"), F.col("v")).otherwise(F.col("v") - F.log10(F.greatest(F.lit(1), F.col("left")))).alias("v"), "done")
        state = cut(at.unionByName(state.filter("done")))
        release(grams.sparkSession)
    return seen.unionByName(state.select("code", F.lit(0).cast("long").alias("c"), "v"))


@dataclass
class Windows:
    """The code lengths of frequent windows, in a table of open addresses (a window's own place or one soon after it)."""

    code: np.ndarray  # no window is all ones: that stands for an empty place
    v: np.ndarray

    @staticmethod
    def of(code: np.ndarray, v: np.ndarray) -> Windows:
        size = 1 << max(4, (2 * len(code)).bit_length())
        codes, values = np.full(size, EMPTY, np.uint64), np.zeros(size, np.float32)
        left, at = np.arange(len(code)), _place(code, size)
        while len(left):
            free = codes[at] == EMPTY
            slots, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            codes[slots], values[slots] = code[put], v[put]
            again = codes[at] != code[left]
            left, at = left[again], (at[again] + 1) & (size - 1)
        return Windows(codes, values)

    def find(self, code: np.ndarray) -> np.ndarray:
        """The place of each window, or -1."""
        found, left, at = np.full(len(code), -1, np.int64), np.arange(len(code)), _place(code, len(self.code))
        while len(left):
            there = self.code[at]
            here = there == code[left]
            found[left[here]] = at[here]
            more = ~here & (there != EMPTY)
            left, at = left[more], (at[more] + 1) & (len(self.code) - 1)
        return found


EMPTY = np.uint64(2**64 - 1)


def _place(code: np.ndarray, size: int) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts (c), as far as all of a class of counts fit; a histogram of the classes tells."""
    level = F.floor(4 * F.log2("c")).cast("int")
    held, least = 0, None
    for row in sorted(counts.filter("c > 0").groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return counts.filter((F.col("c") > 0) & (level >= least)) if least is not None else counts.limit(0)


def common_windows(values: DataFrame, most: int) -> Windows:
    found = most_frequent(values, most).select("code", F.col("v").cast("float").alias("v")).toArrow()
    return Windows.of(found.column("code").to_numpy().view(np.uint64), found.column("v").to_numpy())


def score_windows(common: Windows, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each text (its words are found here) the sum over its common windows, and its other windows with their counts."""
    ends = np.cumsum([len(joined(tokens(x))) + 1 for x in texts])
    code = _codes(texts)
    at = common.find(code)
    v = np.where(at >= 0, common.v[at].astype(np.float64), 0.0)
    total = np.add.reduceat(v, np.concatenate([[0], ends[:-1]]))
    other = np.flatnonzero(at < 0)
    d, w = np.searchsorted(ends, other, "right"), code[other]
    order = np.lexsort((w, d))
    d, w = d[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])])) if len(d) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(d)))
    cuts = np.searchsorted(d[first], np.arange(1, len(texts)))
    return total, np.split(w[first].view(np.int64), cuts), np.split(times, cuts)


def fit(texts: DataFrame, contexts: int = CONTEXTS) -> Model:
    """The model of at most so many contexts of the training texts (t). Only its bounded tables reach the driver."""
    grams = cut(window_counts(texts))
    ahead = F.shiftrightunsigned("code", 8)
    of = lambda k: F.lit(k << 40).cast("long") + ahead.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))
    each = grams.select(F.explode(F.array(*[of(k) for k in range(ORDER + 1)])).alias("context"), F.col("code").bitwiseAND(F.lit(255).cast("long")).alias("symbol"), "c")
    totals = cut(each.groupBy("context").agg(F.sum("c").alias("c")))
    most = totals.orderBy(F.desc("c")).limit(contexts + 1).toArrow()
    c = np.sort(most.column("c").to_numpy())[::-1]
    least = int(c[contexts]) + 1 if len(c) > contexts else 1
    kept = most.filter(pc.greater_equal(most.column("c"), least)).column("context").to_numpy() if len(c) else np.zeros(0, np.int64)
    chosen = texts.sparkSession.createDataFrame(pa.table({"context": pa.array(kept, pa.int64())}))
    rows = each.join(F.broadcast(chosen), "context").groupBy("context", "symbol").agg(F.sum("c").alias("c")).toArrow()
    return build_model(kept, *(rows.column(x).to_numpy() for x in ("context", "symbol", "c")))


def lm_scores(docs: DataFrame, contexts: int | None = None, common_words: int = COMMON_WORDS, most_windows: int = COMMON_WINDOWS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per input row.

    docs has doc_id and text; other columns are ignored. A null or empty text is its end alone. A null doc_id is
    held out; repeated rows each count and are scored each. Without training rows the base is even over one unseen
    token and the model even over bytes. An empty table gives no rows. The model has all contexts of the training rows,
    or the most frequent ones, if a number of them is given.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_bytes().alias("t"))
    train = rows.filter(~F.col("held_out")).select("t")
    counts = cut(word_counts(train))
    n_train = train.count()
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    train_tokens, kinds = total + n_train, distinct + (n_train > 0)
    if contexts is None:
        grams = cut(window_counts(train))
        values = cut(code_lengths(grams, window_counts(rows.filter("held_out").select("t")).select("code")))
        model = common_windows(values, most_windows)
    else:
        model = fit(train, contexts)
    common = most_frequent(counts.filter(F.octet_length("word") <= WORD_BYTES), common_words).toArrow()
    shared = spark.sparkContext.broadcast((dict(zip(common.column("word").to_pylist(), np.log10(common.column("c").to_numpy() + 1.0).tolist(), strict=True)), model))
    end_log, share_log = float(np.log10(n_train + 1)), float(np.log10(train_tokens + kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("lm", lambda: None)
        known, model = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, limit=PIECE):
            split = [tokens(x) for x in batch.column("t").to_pylist()]
            found, logs, rare, rare_n = [], [], [], []
            for words in split:
                n, log, unknown, times = int(n_train > 0), end_log, [], []
                for word, k in Counter(words).items():
                    value = known.get(word)
                    if value is None:
                        unknown.append(word)
                        times.append(k)
                    else:
                        n += k
                        log += k * value
                found.append(n)
                logs.append(log)
                rare.append(unknown)
                rare_n.append(times)
            if contexts is None:
                score, other, other_n = score_windows(model, batch.column("t").to_pylist())
            else:
                score, other, other_n = score_texts(model, [joined(x) for x in split]), [[]] * len(split), [[]] * len(split)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(range(row, row + len(split)), pa.int64()),
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "n_tokens": pa.array([len(x) + 1 for x in split], pa.int64()),
                    "found": pa.array(found, pa.int64()),
                    "logs": pa.array(logs, pa.float64()),
                    "score": pa.array(score),
                    "rare": pa.array(rare, pa.list_(pa.binary())),
                    "rare_n": pa.array(rare_n, pa.list_(pa.int64())),
                    "other": pa.array(other, pa.list_(pa.int64())),
                    "other_n": pa.array(other_n, pa.list_(pa.int64())),
                }
            )
            row += len(split)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = cut(rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, found long, logs double, score double, rare array<binary>, rare_n array<long>, other array<long>, other_n array<long>"))
    # What the broadcast words don't cover is joined with all counts; words never seen add nothing to either sum.
    each = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    more = each.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    both = scored.drop("rare", "rare_n", "other", "other_n").join(more, "row", "left")
    if contexts is None:
        # So are the windows that the broadcast ones don't cover, with all code lengths.
        windows_of = scored.select("row", F.explode(F.arrays_zip("other", "other_n")).alias("x")).select("row", F.col("x.other").alias("code"), F.col("x.other_n").alias("n"))
        rest = windows_of.join(values, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("v")).alias("more_score"))
        both = both.join(rest, "row", "left")
    else:
        both = both.withColumn("more_score", F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("found") + zero(F.col("more"))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + zero(F.col("more_logs")) - F.col("n_tokens") * F.lit(share_log)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
