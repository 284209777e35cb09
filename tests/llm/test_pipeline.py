"""The pipeline: stages in order, columns kept, decisions taken, nothing clean lost."""

import corpus_pipeline
from pyspark.sql import functions as F

from cuelattice.llm import exact_dedup, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == columns
        seen.append((docs, after))
        docs = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    scored = toxicity.score_toxicity(seen[0][0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(seen[0][1]) == ids(scored.filter("predicted = 0"))
    assert ids(seen[1][1]) == ids(exact_dedup.exact_dedup(seen[1][0]).filter("kept"))
    assert ids(seen[2][1]) == ids(simhash.similar_groups(seen[2][0]).filter("doc_id = component_id"))
    assert ids(seen[3][1]) == ids(seen[3][0])
    assert seen[3][1].filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    assert ids(seen[4][1]) == ids(seen[4][0])


def test_odd_rows(spark):
    rows = [(1, "same text", "en", "a", 9, "x"), (1, "same text", "en", "a", 9, "y"), (2, "same text", None, "a", 9, "z"), (None, "same text", "en", None, 9, "q"), (3, None, "en", "a", 0, "x"), (4, "", "en", "a", 0, "x"), (5, "password=hunter2222", "en", "a", 19, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.limit(0)):
            after = stage(spark, table, SF)
            found = after.collect()
            assert i == 4 or after.columns == docs.columns
            assert found or table is not docs
        if i == 1:
            assert sorted((r.doc_id, r.text) for r in stage(spark, docs, SF).collect()) == [(2, "same text"), (4, ""), (5, "password=hunter2222")]
        if i == 3:
            assert {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}[5] == "[REDACTED]"


def test_near_copies_under_repeated_ids(spark):
    """A doc_id may have several texts: only the near copy goes, whatever its id, and one row of a group stays."""
    words = [f"w{i}" for i in range(120)]
    a, near, other = " ".join(words), " ".join([*words[:-1], "changed"]), " ".join(f"x{i}" for i in range(90))
    rows = [(1, a), (5, near), (5, other), (7, near), (7, near + " "), (9, other), (None, a), (None, a), (3, None), (4, ""), (8, "short text")]
    docs = spark.createDataFrame([(i, t, "en", k, "own") for k, (i, t) in enumerate(rows)], "doc_id long, text string, id string, name long, whole string")
    for block in (docs, docs.repartition(5)):
        after = corpus_pipeline.drop_near_copies(spark, block, SF)
        assert after.columns == docs.columns
        got = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in after.collect()), key=str)
        assert got == sorted([(False, 1, a), (False, 5, other), (True, None, a), (False, 3, ""), (False, 8, "short text")], key=str)


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(1, "some words", 0.5, "a", 1), (2, "password=hunter2222", 0.7, "b", 2)], "doc_id long, text string, score double, `__at` string, spans int")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        got = {r.doc_id: r for r in after.collect()}
        assert {k: (r.score, r["__at"], r.spans) for k, r in got.items()} == {1: (0.5, "a", 1), 2: (0.7, "b", 2)}
        assert got[2].text == ("[REDACTED]" if i == 3 else "password=hunter2222")
