"""A corpus pipeline of operators from cuelattice.llm: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the columns of docs, but for the last, which returns packed pieces.
run() writes what a stage returns into the folder for checkpoints and reads it again as docs of the next; then what that one
was given goes, so that two of them are there at a time.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm import toxicity
from cuelattice.llm.common import cut, release, shared_folder, table, unused
from cuelattice.llm.exact_dedup import exact_dedup
from cuelattice.llm.packing import pack_documents
from cuelattice.llm.secrets import redacted
from cuelattice.llm.simhash import similar_groups

#: SQL has neither the classifier nor the near-duplicate groups.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (a score of 0.5 or more) go. Null texts count as empty; an empty table stays empty."""
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), unused(docs, "score")
    return toxicity.with_score(docs, model, score).filter(F.col(score) < 0.5).drop(score)


def _stay(docs: DataFrame, rows: DataFrame, name: Column) -> DataFrame:
    """The rows of docs that stay, one of those that repeat a doc_id and text. rows has id, name and stays; name is also found from docs."""
    found = cut(rows.groupBy("id", "name").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # so that no column of docs clashes with those of the joins
    named = docs.select(F.col("doc_id").alias("doc"), name.alias("text_name"), whole.alias("whole"))

    def among(keys: DataFrame, how: str, of: DataFrame) -> DataFrame:
        return of.join(keys.select("id", "name"), F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_name") == F.col("name")), how)

    left = among(found.filter("not stays"), "left_anti", named)
    repeated = found.filter("stays and n > 1")
    if not repeated.isEmpty():
        left = among(repeated, "left_anti", left).unionByName(among(repeated, "left_semi", left).dropDuplicates(["doc", "text_name"]))
    return left.select("whole.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat it, any one."""
    rows = exact_dedup(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("name"), F.col("kept").alias("stays"))
    return _stay(docs, rows, F.sha2(F.coalesce("text", F.lit("")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row of the least doc_id stays.

    Rows of one doc_id with different texts are told apart by their texts; of rows that repeat both, any one stays. Rows
    without a doc_id all stay, but for repeats. Null and empty texts are near duplicates of each other.
    """
    rows = similar_groups(docs).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("name"), "stays")
    return _stay(docs, rows, F.xxhash64(F.coalesce("text", F.lit(""))))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark, and n_chars, where there is one, follows. Null texts stay null."""
    found = redacted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as packed pieces; a null or empty text is its end id, a long one several pieces. An empty table gives no rows."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
        release(spark)
    return docs
