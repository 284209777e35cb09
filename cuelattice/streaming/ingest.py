"""Extension: captions that land in a folder are validated and cleaned as jobs, whose states and results are written as they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import upload_allowed
from ..operators.quality import corrected_content, validate
from ..sources.files import artifact_name, caption_files
from .jobs import job_changes

#: Bytes from which a file is too large to be taken.
MOST_BYTES = 100 << 20


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, modificationTime, length, content) of files with an extension that uploads may have."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    return files.filter(upload_allowed(F.col("path")))


def trouble(content: Column, length: Column, most_bytes: int) -> Column:
    """Why a file can't be worked on; null if it can."""
    return F.when(length > most_bytes, F.format_string("%d bytes are more than %d", length, F.lit(most_bytes))).when((length > 0) & (content == ""), "not text in UTF-8").when(F.contains(content, F.lit("\0")), "binary content")


def quality_jobs(raw: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(job_id, path, at, trouble, message, name, content) of files as they land: what is wrong with one, or its issues and its text once cleaned."""
    files = caption_files(raw, "modificationTime", "length").withColumn("trouble", trouble(F.col("content"), F.col("length"), most_bytes))
    done = validate(files).withColumn("clean", F.when(F.col("trouble").isNull(), corrected_content(F.col("content"))))
    return done.select(
        F.sha2(F.concat("path", F.lit("\n"), "content"), 256).alias("job_id"),
        "path",
        F.col("modificationTime").alias("at"),
        "trouble",
        F.coalesce("trouble", F.array_join("issues", "\n")).alias("message"),
        F.when(F.col("trouble").isNull(), artifact_name(F.col("clean"), "corrected")).alias("name"),
        F.col("clean").alias("content"),
    )


def job_events(jobs: DataFrame) -> DataFrame:
    """(job_id, at, status, message, result_files): that a job was queued, was begun, and how it ended."""
    none = F.array().cast("array<string>")
    event = lambda status, message, files: F.struct(status.alias("status"), message.alias("message"), files.alias("result_files"))
    begun = [event(F.lit(s), F.concat(F.lit("quality-check "), "path"), none) for s in ("QUEUED", "RUNNING")]
    ended = event(F.when(F.col("trouble").isNull(), "COMPLETED").otherwise("FAILED"), F.col("message"), F.when(F.col("name").isNotNull(), F.array("name")).otherwise(none))
    return jobs.select("job_id", "at", F.explode(F.array(*begun, ended)).alias("x")).select("job_id", "at", "x.*")


def start_quality_stream(spark: SparkSession, path: str, out: str, checkpoint: str, most_bytes: int = MOST_BYTES) -> list[StreamingQuery]:
    """Two queries over what lands: cleaned files into out/files, changes of jobs into out/jobs.

    Each batch is written under its own number, so a batch that is run again replaces itself.
    """

    def into(folder: str):
        def batch(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{out}/{folder}/batch={number}")

        return batch

    jobs = quality_jobs(landed(spark, path), most_bytes)
    cleaned = jobs.filter("name is not null").select("job_id", "path", "name", "content")
    written = [("files", cleaned), ("jobs", job_changes(job_events(jobs)))]
    return [rows.writeStream.foreachBatch(into(folder)).option("checkpointLocation", f"{checkpoint}/{folder}").trigger(availableNow=True).start() for folder, rows in written]
