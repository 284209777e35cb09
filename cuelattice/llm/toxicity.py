"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text (bytes, A-Z lower-cased), hashed. A feature counts as its log-count
ratio between toxic and other labelled texts, shrunk by what chance may have in it: to nothing where so uneven a spread
over the two is no rarity, little where it is. So how many features count follows from the labels, be they few or many.
Logistic regression finds the weights. The classifier is fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces, release, sole_cache, text_bytes

#: Labelled rows that the classifier is fitted on at most: those with the least hashes of their ids.
SAMPLE_ROWS = 3_000
#: Bytes of text that these have together at most (about 10 bytes of features each reach the driver); rows beyond are left out.
SAMPLE_BYTES = 16 << 20
#: Parts in which their features reach the driver.
SAMPLE_PARTS = 16
SIZES = (5, 8)
HASH_BITS = 20
#: Log-likelihood statistic (of one degree of freedom) up to which a feature's spread counts as chance.
CHANCE = 10.0
#: Toxic texts are the fewer; each weighs as much as so many others.
TOXIC_WEIGHT = 3.0
STEPS = 150
L2 = 1e-3


@dataclass
class Model:
    weights: np.ndarray  # of each hashed n-gram, its log-count ratio included
    bias: float


def features(text: bytes) -> np.ndarray:
    """The distinct hashed n-grams of a text, in order."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(b) >= n:
            code = np.zeros(len(b) - n + 1, np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | b[k : len(b) - n + 1 + k]
            out.append((((code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.uint32))
    if not out:
        return np.zeros(0, np.uint32)
    found = np.concatenate(out)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def evidence(with_it: np.ndarray, without: np.ndarray, positive: int, negative: int) -> np.ndarray:
    """The log-likelihood statistic of features that so many toxic and other texts have: how far their spread is from chance."""
    texts, both = positive + negative, with_it + without
    total = np.zeros(len(with_it))
    for seen, expected in ((with_it, both * (positive / texts)), (without, both * (negative / texts)), (positive - with_it, (texts - both) * (positive / texts)), (negative - without, (texts - both) * (negative / texts))):
        total += seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))
    return 2 * total


def fit_model(feature: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> Model:
    """Log-count ratios less what chance may have in them, then logistic regression by full-batch steps. One class alone: its rate everywhere.

    The features of text i are feature[offsets[i]:offsets[i + 1]]. Steps go through some features at a time, so that
    the memory besides these arrays doesn't grow with the sample.
    """
    size = 1 << HASH_BITS
    weights = np.zeros(size, np.float32)
    positive, texts = int(toxic.sum()), len(toxic)
    if not positive or positive == texts:
        rate = (positive + 1e-6) / (texts + 2e-6) if texts else 1e-6
        return Model(weights, float(np.log(rate / (1 - rate))))
    row = np.repeat(np.arange(texts, dtype=np.uint16 if texts < 1 << 16 else np.int32), np.diff(offsets))
    parts = [slice(i, i + (1 << 19)) for i in range(0, len(feature), 1 << 19)]
    with_it, without = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for x in parts:
        hit = toxic[row[x]] == 1
        with_it += np.bincount(feature[x][hit], minlength=size)
        without += np.bincount(feature[x][~hit], minlength=size)
    ratio = np.log((with_it + 1) / (positive + 2)) - np.log((without + 1) / (texts - positive + 2))
    strength = evidence(with_it, without, positive, texts - positive)
    used = np.flatnonzero(strength > CHANCE)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = [(row[x][place[feature[x]] >= 0], place[feature[x]][place[feature[x]] >= 0]) for x in parts]
    scale = ratio[used] * (1 - CHANCE / strength[used])
    weight = np.where(toxic == 1, TOXIC_WEIGHT, 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(len(used)), float(np.log(TOXIC_WEIGHT * positive / (texts - positive)))
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.full(texts, bias)
        own = scale * w
        for r, c in kept:
            z += np.bincount(r, own[c], texts)
        error = weight * (logistic(z) - toxic)
        gradient = np.zeros(len(used))
        for r, c in kept:
            gradient += np.bincount(c, error[r], len(used))
        gradient = np.append(scale * gradient + L2 * w, error.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient * gradient
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights[used] = w * scale
    return Model(weights, float(bias))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null doc_id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a task, the features of labelled texts (doc_id, toxic, t)."""
    sole_cache("toxicity", lambda: None)  # the worker may come from a stage that keeps a vocabulary and its words
    for batch in pieces(batches):
        found = [features(x).astype(np.int32) for x in batch.column("t").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "f": pa.array(found, pa.list_(pa.int32()))})


def joined_lists(chunks: list[pa.ListArray]) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists of integers in one array, and the offsets of the lists in it. Takes the last chunk first and lets go of each once it is copied."""
    sizes = [np.diff(np.asarray(x.offsets, np.int64)) for x in reversed(chunks)]
    offsets = np.concatenate([np.zeros(1, np.int64), *sizes]).cumsum()
    values, at = np.empty(offsets[-1], np.int32), 0
    while chunks:
        part = np.asarray(chunks.pop().flatten())
        values[at : at + len(part)] = part
        at += len(part)
        del part
        pa.default_memory_pool().release_unused()
    return values, offsets


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from a sample of the labelled rows that aren't held out, of bounded rows and bytes, in the order of the hashes of their ids.

    A label is the largest of its doc_id; nulls don't count. Of rows that repeat a doc_id one is taken, by the hash of its text.
    """
    sample = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # its size is bounded, so it is broadcast

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.struct(F.xxhash64("t").alias("h"), "t")
    found = docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(sample), "doc_id").repartition(SAMPLE_PARTS, "doc_id")
    found = cut(found.groupBy("doc_id", "toxic").agg(F.min(text)["t"].alias("t")))
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sizes of the bounded sample only
    within = found.select("doc_id", F.octet_length("t").alias("size")).withColumn("so_far", so_far).filter(F.col("so_far") <= sample_bytes).select("doc_id")
    chosen = found.join(F.broadcast(within), "doc_id", "left_semi")
    release(docs.sparkSession)  # the driver's JVM and its Python fill the same memory: here the one hands over, there the other fits
    rows = chosen.mapInArrow(sample_features, f"doc_id {kind}, toxic int, f array<int>").toArrow()
    toxic, chunks = rows.column("toxic").to_numpy().astype(np.int64), rows.column("f").chunks[::-1]
    del rows
    feature, offsets = joined_lists(chunks)
    release(docs.sparkSession)
    return fit_model(feature, offsets, toxic)


def with_score(docs: DataFrame, model: Model, name: str = "__toxicity") -> DataFrame:
    """All columns of docs and a score from 0 to 1. The score is of the text alone; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("toxicity", lambda: None)
        weights, bias = shared.value.weights, shared.value.bias
        for batch in pieces(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            z = np.array([weights[features(x or b"")].sum(dtype=np.float64) + bias for x in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logistic(z))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per input row.

    docs has doc_id and text, labels has doc_id and toxic; other columns are ignored. Null and empty texts get the
    score of no feature. Without labels all scores are near 0. Repeated rows are given each; a null doc_id is
    held out. An empty table gives no rows.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, sample_rows), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
