"""Passes that carry something over parts, against windows of Spark; one group has a third of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelattice.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 11).cast("string"))
    value = F.when(F.col("id") % 4 > 0, F.col("id") * 7 - 9)
    return spark.range(3000).select(g.alias("g"), F.pmod(F.hash("id"), F.lit(1000)).alias("o"), "id", value.alias("v"), (F.col("id") % 13).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("j"))


def same(got, want, *columns):
    pick = lambda df: sorted(map(str, df.select("id", *columns).collect()))
    assert pick(got) == pick(want)


@pytest.fixture(autouse=True)
def many_parts(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_running_sums_and_numbers(rows):
    w = Window.partitionBy("g").orderBy("o", "id")
    upto, ahead = F.coalesce(F.sum("v").over(w), F.lit(0)), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same(scans.running_sums(rows, ["g"], ["o", "id"], {"s": "v"}, {"t": "v"}), rows.withColumns({"s": upto, "t": ahead}), "s", "t", "k")
    same(scans.numbered(rows, ["g"], ["o", "id"], "n"), rows.withColumn("n", F.row_number().over(w)), "n")
    same(scans.running_sums(rows, [], ["id"], {"s": "v"}), rows.withColumn("s", F.coalesce(F.sum("v").over(Window.orderBy("id")), F.lit(0))), "s")


def test_ranks_go_on_over_parts(rows):
    same(scans.ranked(rows, ["k", "j"], ["id"]), rows.withColumn("rank", F.dense_rank().over(Window.orderBy("k", "j"))), "rank")


def test_sums_wrap(spark):
    big = spark.createDataFrame([(i, (1 << 63) - 1) for i in range(5)], "id long, v long")
    got = [r.s for r in scans.running_sums(big, [], ["id"], {"s": "v"}).orderBy("id").collect()]
    assert got == [((i + 1) * ((1 << 63) - 1) + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(5)]


def test_a_hot_group_lies_in_several_parts(rows):
    parts = scans.in_order(rows, ["g", "o", "id"]).filter("g = 'hot'").groupBy(scans.PART).count().collect()
    assert len(parts) > 1
    assert max(p["count"] for p in parts) < 1000


def test_no_rows(rows):
    assert scans.numbered(rows.filter("false"), ["g"], ["o"], "n").count() == 0
