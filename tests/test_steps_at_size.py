"""Steps whose cost or memory grew faster than their input: texts normalised in parts, blocks parsed once, tokens of spans found without listing all."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from cuelattice.functions import text
from cuelattice.operators import quality
from cuelattice.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nfkc_in_parts(monkeypatch):
    monkeypatch.setattr(text, "NFKC_BYTES", 20)
    texts = ["ﬁne", None, "", "é №", "x" * 50, "가가", "A"] * 3
    parts = list(text.nfkc_parts(pa.array(texts).slice(2)))
    assert len(parts) > 5
    assert [x for p in parts for x in p.to_pylist()] == [unicodedata.normalize("NFKC", x or "") for x in texts[2:]]
    assert list(text.nfkc_parts(pa.array([], pa.string()))) == []


def test_nfkc_goes_by_arrow(spark):
    assert plan_of(QUERIES["compatible_text"](spark, SF)).count("ArrowEvalPython") == 1
    assert text._nfkc.evalType == 250  # a scalar function of Arrow arrays


def test_blocks_are_split_once(spark):
    assert plan_of(QUERIES["cue_table"](spark, SF)).count("\\n\\s*\\n") == 1


def test_cues_of_odd_blocks(spark):
    blocks = ["1\n00:01.5 --> 1:00:02,025 align\na\n\nb\n", "00:00:01,000-->00:00:02,000\rx y", "1\n--> 00:01.0\nz", "a\nb\n00:00:01,000 --> 00:00:02,000", "", None, "2\n99:00:61.007   -->   00:00:00.1"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "cue_idx int, block string")
    found = {r["cue_idx"]: (round(r["start_s"], 6), round(r["end_s"], 6), r["text"]) for r in quality.cues_of_blocks(rows).collect()}
    assert found == {0: (1.005, 3602.025, "a\n\nb"), 1: (1.0, 2.0, "x\ny"), 6: (356461.007, 0.001, "")}


def test_tokens_of_spans_are_not_listed(spark):
    plan = plan_of(QUERIES["retime_spans"](spark, SF))
    assert "flatten" not in plan
    assert plan.count("RepartitionByExpression") == 2


def test_cores_are_counted(spark):
    texts = ["", None, " -- a-b, (c)  d1\x1ce. ... 日本\n№ 'tis", "　x y\x85z", "...!a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r["a"] == r["b"] for r in rows.select(text.n_cores(F.col("t")).alias("a"), F.size(text.cores(F.col("t"))).alias("b")).collect())
