"""Caption operators against hand-worked results, plain Python and DuckDB."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from cuelattice.functions import similarity, text
from cuelattice.operators import catalog, quality, reposition, timeline
from cuelattice.plans import correct as plans
from cuelattice.schemas import job_status

SEGMENTS = "media_id string, seg_idx int, start_s double, end_s double, text string"
CUES = "media_id string, cue_idx int, start_s double, end_s double, text string, language string"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def segments(spark):
    rows = [("m", 0, 1.0, 2.0, "Hello world"), ("m", 1, 2.2, 3.0, "How are you"), ("m", 2, 3.5, 5.0, "Nice to meet you")]
    return spark.createDataFrame(rows, SEGMENTS)


def cues(spark, *rows):
    return spark.createDataFrame([("m", i, a, b, t, "en") for i, (a, b, t) in enumerate(rows)], CUES)


def test_correct_refines_partial_runs_and_fills_gaps(spark, segments):
    got = plans.correct(cues(spark, (0.8, 2.3, "Hello wrld"), (2.1, 3.2, "How are u")), segments).orderBy("start_s").collect()
    assert [(r.start_s, round(r.end_s, 4), r.text, r.kind) for r in got] == [
        (1.0, 1.5, "Hello wrld", "aligned"),
        (2.2, 2.7333, "How are how", "aligned"),
        (3.5, 5.0, "Nice to meet you", "generated"),
    ]


def test_hybrid_stretches_what_is_not_locked(spark, segments):
    got = plans.hybrid(cues(spark, (0.9, 2.4, "Hello world"), (2.0, 3.4, "How r you")), segments).orderBy("index").collect()
    assert [(r["index"], r.start, round(r.end, 6), r.text) for r in got] == [(1, 1.0, 2.0, "Hello world"), (2, 2.2, 3.0, "How how you"), (3, 3.5, 5.0, "Nice to meet you")]


def test_language_guard_leaves_cues_alone(spark, segments):
    other = spark.createDataFrame([("m", "fr")], "media_id string, language string")
    got = plans.correct(cues(spark, (0.8, 2.3, "Hello wrld")), segments, other).collect()
    assert [(r.start_s, r.end_s, r.text, r.kind) for r in got] == [(0.8, 2.3, "Hello wrld", "untouched")]


def test_constraint_fold(spark):
    rows = [("m", 0.0, 0.1, "a", 0, False), ("m", 0.5, 20.0, "b", 1, False), ("m", 9.0, 9.5, "c", 2, True), ("m", 9.2, 30.0, "d", 3, False), ("m", 12.0, 13.0, "e", 4, False)]
    df = spark.createDataFrame(rows, "media_id string, start_s double, end_s double, text string, pos long, locked boolean")
    ends = spark.createDataFrame([("m", 12.0)], "media_id string, media_end double")
    got = timeline.enforce_constraints(df, ends=ends, respect_locks=True).orderBy("pos").collect()
    assert [(r.text, round(r.start_s, 3), round(r.end_s, 3)) for r in got] == [("a", 0.0, 0.8), ("b", 0.8, 8.8), ("c", 9.0, 9.5), ("d", 9.5, 12.0)]


def test_sequence_ratio_is_difflibs(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("abcd ") for _ in range(r.choice([0, 3, 20, 250]))), "".join(r.choice("abcd ") for _ in range(r.choice([0, 3, 20, 250])))) for _ in range(60)]
    flat = lambda x: " ".join(x.split())
    got = spark.createDataFrame(rows, "a string, b string").select(similarity.seq_ratio("a", "b").alias("x")).collect()
    for (a, b), x in zip(rows, got, strict=True):
        a, b = flat(a), flat(b)
        assert x["x"] == (1.0 if a == b == "" else 0.0 if not a or not b else difflib.SequenceMatcher(None, a, b).ratio())


def test_runs_and_styles():
    assert similarity.longest_run(["gonna", "be", "fine"], ["it", "going", "be", "fine"]) == (3, 1)
    assert similarity.longest_run([], ["a"]) == (0, -1)
    assert [similarity.in_style("word", s) for s in ("ABC", "abc", "Abc", "aBc")] == ["WORD", "word", "Word", "word"]
    assert similarity.token_parts('"Hello,') == ('"', "Hello", ",")
    assert similarity.token_parts("...") == ("...", "", "")


def test_validation_messages(spark):
    files = ["", "1\n00:00:01,000 --> 00:00:02,000\n", "1\n00:00 --> 00:01\na\nb\nc", "x\ny", "1\n0 --> 1\n" + "k" * 43 + "\n \n2\n0 --> 1\nok"]
    got = quality.validate(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, content string")).orderBy("i").collect()
    assert [r.issues for r in got] == [
        ["Block 1 has invalid header/timing."],
        ["Block 1 has no text."],
        ["Block 1 exceeds max lines (3 > 2)."],
        ["Block 1 has invalid header/timing."],
        ["Block 1 line exceeds max chars (43 > 42)."],
    ]


def test_text_functions(spark):
    c = F.col("v")
    assert one(spark, text.clean_lines(c), v="a \r\nb\t\r\n\r\n\r\n\r\nc") == "a\nb\n\nc"
    assert one(spark, text.two_line_cap(c), v="1\n0 --> 1\na\nb\nc\n\n2\n0 --> 1\nd\n") == "1\n0 --> 1\na\nb\n\n2\n0 --> 1\nd\n"
    assert one(spark, text.tag_translation(c, F.lit("de")), v="1\n0 --> 1\nhi\n\nyou") == "1\n0 --> 1\nhi [de]\n\nyou [de]\n"
    assert [one(spark, text.srt_time(c), v=x) for x in (0.0005, 0.0015, -3.0, 3661.5)] == ["00:00:00,000", "00:00:00,002", "00:00:00,000", "01:01:01,500"]
    assert [one(spark, text.file_size_label(c), v=x) for x in (0, 1, 1024, 1536, 10485760)] == ["0 Bytes", "1 Bytes", "1 KB", "1.5 KB", "10 MB"]
    assert [one(spark, text.guess_format(c, F.lit("1\nx")), v=x) for x in ("a.SRT", "a.ass", "a.txt", "a", ".srt")] == ["srt", "ass/ssa", "srt-txt", "unknown", "unknown"]
    assert one(spark, text.comma_list(c), v=" a, ,b ") == ["a", "b"]
    assert one(spark, text.normalize_text(c), v="ﬁne  day\n") == "fine day"
    assert one(spark, job_status(c), v="processing") == "RUNNING"


def test_reposition(spark):
    c = F.col("v")
    assert one(spark, reposition.reposition_srt(c, F.lit("top")), v="1\n0 --> 1\na\n\nb") == "1\n0 --> 1\nNOTE: position=top\na\n\nNOTE: position=top\nb\n"
    assert one(spark, reposition.reposition_vtt(c, F.lit("bottom")), v="W\n0 --> 1 line: 3\n0 --> 1 \nx\n") == "W\n0 --> 1 line:90\n0 --> 1 line:90\nx"
    assert one(spark, reposition.reposition_ass(c, F.lit("top")), v="x") == "x\n; NOTE: desired_alignment=8 (top=8,bottom=2)\n"
    found = [one(spark, reposition.caption_position(reposition.text_in_picture(c)), v=x) for x in ("a_top.mp4", "bottom", "Top_bottom", "x")]
    assert found == ["bottom", "top", "top", "top"]


def test_cue_table_and_srt_round_trip(spark):
    content = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:01:00,250 --> 00:01:02,000\nBye\n"
    table = quality.cue_table(spark.createDataFrame([("m", content)], "media_id string, content string"))
    assert timeline.srt_text(table.withColumn("pos", F.col("cue_idx"))).first()["content"] == content


def test_normalized_inputs(spark):
    loose = spark.createDataFrame([("m", 0, None, None, 1.0, 2.0, 5.0, 6.0, "a  b", "EN "), ("m", 1, 3.0, 1.0, None, None, None, None, None, None)], "media_id string, cue_idx int, start double, end double, start_s double, end_s double, start_ms double, end_ms double, text string, language string")
    got = timeline.normalized_cues(loose).orderBy("cue_idx").collect()
    assert [(r.start_s, r.end_s, r.text, r.language) for r in got] == [(1.0, 2.0, "a b", "en"), (3.0, 3.001, "", None)]


def test_catalog(spark):
    child = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, user_id long")
    parent = spark.createDataFrame([(5,)], "id long")
    assert [r.id for r in catalog.orphans(child, "user_id", parent).collect()] == [3]
    catalog.create_catalog(spark, "captions")
    assert spark.table("captions.jobs").columns[:2] == ["id", "user_id"]
