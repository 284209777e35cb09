"""The catalog of users, videos, subtitles and jobs: empty tables, broken references, job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATALOG, FOREIGN_KEYS, job_status


def create_catalog(spark: SparkSession, database: str) -> None:
    """Create the four tables where they are missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in CATALOG.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.createDataFrame([], columns).write.saveAsTable(f"{database}.{name}")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows of child whose reference is set and leads nowhere."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def broken_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, column, parent, n) over all foreign keys of the catalog."""
    found = [
        orphans(tables[c], column, tables[p]).agg(F.lit(c).alias("child"), F.lit(column).alias("column"), F.lit(p).alias("parent"), F.count(F.lit(1)).alias("n")) for c, column, p in FOREIGN_KEYS
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def job_reply(jobs: DataFrame, job_id: Column | str) -> DataFrame:
    """The job of that id; no row if there is none."""
    return jobs.filter(F.col("job_id") == job_id).select("job_id", job_status(F.col("status")).alias("status"), "message", "result_files")


def status_rollup(jobs: DataFrame, by: str) -> DataFrame:
    """Jobs by owner and status, and when the last one was."""
    return jobs.groupBy(by, job_status(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
