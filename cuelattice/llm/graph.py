"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_for, release

#: Links that a task takes at least, so that few links don't become many empty tasks and files in every round.
TASK_LINKS = 20_000


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of links (a long, b long); root is the least node of its component.

    Each round hooks all neighbours to the least one they share, first the larger neighbours of each node, then the
    smaller ones; both take minima that combine ahead of the shuffle. It ends when a round changes nothing, after a
    number of rounds that grows with the logarithm of the longest chain. No links: no rows.
    """
    spark = links.sparkSession
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, parts = now, partitions_for(2 * now[0], TASK_LINKS)
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.coalesce(parts).distinct())
        release(spark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
