"""Steps of `correct` whose seconds grew with the rows: searches handed over group by group, words parsed again and again, few tasks."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.functions import similarity, text, windows
from cuelattice.operators import align
from cuelattice.plans import correct as plans
from cuelattice.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TOKENS = ["", "--", "Yeah,", "«ok»", "é", "É!", "İx", "ﬁne.", "①", "a-b", "(c)", "_x_", "日本。", "№", "DON'T", "́a", "ⅷ", "'tis", "½", "ß"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_read_as_before():
    for t in filter(None, [*TOKENS, *(a + b for a in TOKENS for b in TOKENS)]):
        inner = [i for i, ch in enumerate(t) if ch.isalnum()]
        parts = (t[: inner[0]], t[inner[0] : inner[-1] + 1], t[inner[-1] + 1 :]) if inner else (t, "", "")
        plain = lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).lower()
        core = plain(parts[1]) if inner else None
        if inner:
            assert similarity.token_parts(t) == parts
        assert similarity.token_words(t) == (plain(t), core, core if core is None else text.SYNONYMS.get(plain(core), plain(core)))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_runs_by_pairs_are_those_by_rows(letters):
    r = random.Random(3)
    for _ in range(300):
        cue, window = ([r.choice([*letters, "yes", "yeah", "ya"]) for _ in range(r.randrange(12))] for _ in range(2))
        sense = [similarity.meaning(w) for w in cue], [similarity.meaning(w) for w in window]
        if cue and window:
            assert similarity.longest_run(cue, window) == similarity._longest_dense(cue, window, *sense)


def test_many_alike_words_go_by_rows(monkeypatch):
    calls, real = [], similarity._longest_dense
    monkeypatch.setattr(similarity, "_longest_dense", lambda *a: calls.append(1) or real(*a))
    assert similarity.longest_run(["a"] * 60, ["b"] + ["a"] * 100) == (60, 1)
    assert similarity.longest_run(list("abcdef"), list("xxcdefx")) == (4, 2)
    assert len(calls) == 1


def test_tokens_are_parsed_once_a_block(monkeypatch):
    """Texts of segments are read when a block is made; a search reads its cue alone."""
    texts = [f"word{k} and more of it, {k}." for k in range(20)]
    starts = np.arange(20) * 2.0
    calls, real = [], windows._read
    monkeypatch.setattr(windows, "_read", lambda t: calls.append(t) or real(t))
    block = windows.Block(texts, starts, starts + 1.5, 18, 3)
    for k in range(5):
        (got,) = block.search(texts[k], k * 2.0, k * 2.0 + 1.5, [np.ones(len(block.n), bool)])
        assert got[:2] == (k, k + 1)
    assert len(calls) == 25


@pytest.mark.parametrize("rows", ["1", "7", "10000"])
def test_groups_stream_through_tasks(spark, monkeypatch, rows):
    """Groups split over Arrow batches and many in one: each cue finds the segment that has its words; no group is handed over alone."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    seen, real = [], align.cut
    monkeypatch.setattr(align, "cut", lambda df: seen.append(plan_of(df)) or real(df))
    try:
        segs = [(m, i, i * 3.0, i * 3.0 + 2, f"the {m} and word{i} of{m * 31 + i}") for m in range(12) for i in range(1 + 13 * m)]
        cues = [(m, i, s, e, t) for m, i, s, e, t in segs if (i + m) % 3 == 0]
        s, c = (spark.createDataFrame(x, f"media_id long, {n} int, start_s double, end_s double, text string") for x, n in ((segs, "seg_idx"), (cues, "cue_idx")))
        got = {(x.media_id, x.cue_idx): (x.match.i, x.match.j) for x in align.best_windows(c, s).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(m, i): (i, i + 1) for m, i, *_ in cues}
    assert not any("CoGroups" in p for p in seen)


def test_letters_are_counted_as_by_patterns(spark):
    rows = spark.createDataFrame([(x,) for x in [None, "", "a1 B-é\x00\x01~", "日本 x9", "½ ② ٣ Ⅷ", "'\"\\ \n\t{}", " ".join(TOKENS)]], "t string")
    letters = F.regexp_replace("t", r"[^\p{L}\p{Nd}]+", "")
    ascii_ = F.length(F.regexp_replace(letters, "[^A-Za-z0-9]+", ""))
    found = rows.select(text.letter_profile(F.col("t")).alias("p"), ascii_.alias("a"), (F.length(letters) - ascii_).alias("o")).collect()
    assert all((x.p.ascii, x.p.other) == (x.a, x.o) for x in found)


def test_cores_are_counted_as_the_search_numbers_them(spark):
    texts = [*TOKENS, " ".join(TOKENS), None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x[0] for x in rows.select(similarity.core_counts("t")).collect()] == [len(similarity.token_cores(t or "")) for t in texts]


def test_costly_steps_keep_their_exchange(spark, monkeypatch):
    """Spark leaves an exchange out that deals rows as the join ahead of it does, and then joins its tasks into few."""
    plans_of, real = [], plans.cut
    monkeypatch.setattr(plans, "cut", lambda df: plans_of.append(plan_of(df)) or real(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size
    try:
        final = plan_of(QUERIES["correct_with_audio"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    aligned = [p for p in plans_of if "corrected(" in p]
    assert aligned and all("REPARTITION_BY_NUM" in p for p in aligned)
    assert "REPARTITION_BY_NUM" in final and "seq_ratio" in final
    assert sum("conversations" in p for p in plans_of) <= 2  # segments once, cues once


def test_hybrid_derives_segments_once(spark, monkeypatch):
    """What the caller's segments rest on is worked out for them and for the cues, and for none of the later steps."""
    plans_of, real = [], plans.cut
    monkeypatch.setattr(plans, "cut", lambda df: plans_of.append(plan_of(df)) or real(df))
    plans_of.append(plan_of(QUERIES["hybrid"](spark, SF)))
    assert sum("conversations" in p for p in plans_of) <= 2
