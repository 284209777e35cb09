"""Caption files and transcripts in, caption files out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import guess_format, universal_newlines, upload_allowed
from ..operators.quality import cues_of_blocks
from ..schemas import TRANSCRIPTS
from .artifacts import ArtifactSource
from .captions import CaptionSource


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that aren't; no built-in drops them."""
    return pd.Series([bytes(x).decode("utf-8", "ignore") if x is not None else None for x in content])


def caption_files(raw: DataFrame, *more: str) -> DataFrame:
    """(path, media_id, fmt, content, more columns) of rows (path, content binary) with an extension that uploads may have."""
    rows = raw.filter(upload_allowed(F.col("path"))).withColumn("content", universal_newlines(_decoded("content")))
    media = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return rows.select("path", media.alias("media_id"), guess_format(F.col("path"), F.col("content")).alias("fmt"), "content", *more)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return caption_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSCRIPTS).option("multiLine", "true").json(path)


def artifact_name(content: Column, kind: str, language: Column | None = None) -> Column:
    """A name that follows from the content, so that a repeated run writes the same file."""
    parts = [F.lit("temp"), F.substring(F.sha2(content, 256), 1, 32), F.lit(kind)]
    return F.concat(F.concat_ws("_", *parts, *([language] if language is not None else [])), F.lit(".srt"))


def with_sources(spark: SparkSession) -> SparkSession:
    """The session with the data sources captions and artifacts, which take filters on names and so need Spark to push such filters to Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CaptionSource, ArtifactSource):
        spark.dataSource.register(source)
    return spark


def write_artifacts(files: DataFrame, path: str) -> None:
    """One file per row (name, content) of exactly that name. A text ends with a line feed, which is added where it has none.

    All of them take their names once all are written; files of other names stay. Two rows of one name are an error.
    """
    with_sources(files.sparkSession)
    files.select("name", "content").write.format("artifacts").mode("append").save(path)


def read_artifact(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The content of one artifact by its exact name; the name is compared, never made part of a path."""
    return with_sources(spark).read.format("artifacts").load(path).filter(F.col("name") == name).select("content")


def read_cues(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Cues (path, media_id, cue_idx, start_s, end_s, text) of a caption file or a folder of them, read in parts of about as many bytes."""
    source = with_sources(spark).read.format("captions")
    return cues_of_blocks((source.option("splitBytes", split_bytes) if split_bytes else source).load(path))
