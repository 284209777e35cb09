"""Data sources: captions in parts of files, artifacts that are there as a whole or not at all."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cuelattice.operators import quality
from cuelattice.sources import captions
from cuelattice.sources.artifacts import ArtifactWriter, Staged
from cuelattice.sources.files import read_artifact, read_captions, read_cues, write_artifacts

COLUMNS = ["media_id", "cue_idx", "start_s", "end_s", "text"]


def file_of(r, n):
    blocks = []
    for k in range(n):
        head = f"{k}\n" if r.random() < 0.8 else ""
        timing = f"00:00:{k % 60:02d},000 --> 00:01:00.5" if r.random() < 0.9 else "no timing"
        blocks.append(head + timing + "\n" + "\n".join(r.choice(["  wörd ", "two words  ", "x\x0by", "日本"]) for _ in range(r.randint(0, 3))))
    between = lambda: r.choice(["\n\n", "\n \n", "\n\n\n\n", "\n\t\n\n"])
    text = r.choice(["", "\n", "﻿"]) + "".join(b + between() for b in blocks) + r.choice(["", " ", "\n \n  "])
    return text.replace("\n", "\r\n") if r.random() < 0.4 else text


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, root = random.Random(12), tmp_path_factory.mktemp("captions")
    (root / "deep").mkdir()
    for i in range(12):
        (root / ("deep" if i % 4 == 0 else ".") / f"clip{i}.{r.choice(['srt', 'VTT', 'sbv'])}").write_bytes(file_of(r, r.choice([1, 3, 40])).encode() + (b"\xff" if i % 3 == 0 else b""))
    (root / "big.srt").write_bytes(file_of(r, 3000).encode())
    (root / "empty.srt").write_bytes(b"")
    (root / "blank.srt").write_bytes(b" \n\n ")
    (root / "film.mp4").write_bytes(b"1\n0:0:0,0 --> 0:0:1,0\nno caption file")
    return str(root)


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("split_bytes", [None, 20_000, 777])
def test_parts_of_files_are_those_of_whole_files(spark, folder, split_bytes):
    want = rows(quality.cue_table(read_captions(spark, folder)))
    got = read_cues(spark, folder, split_bytes)
    assert rows(got) == want and len(want) > 2000
    if split_bytes:
        assert got.rdd.getNumPartitions() > 3


def test_names_choose_files_before_they_are_opened(spark, folder, capsys):
    one = read_cues(spark, folder).filter("media_id = 'clip1'")
    assert rows(one) == [x for x in rows(read_cues(spark, folder)) if x[0] == "clip1"]
    capsys.readouterr()
    one.explain("formatted")
    assert "PushedFilters: [IsNotNull(media_id), EqualTo(media_id,clip1)]" in capsys.readouterr().out
    assert read_cues(spark, folder).filter(F.col("path").contains("/deep/") & F.col("media_id").isin("clip4", "clip1")).select("media_id").distinct().count() == 1
    reader = captions.CaptionReader({"path": folder})
    assert list(reader.pushFilters([captions.EqualTo(("media_id",), "clip2"), captions.EqualTo(("cue_idx",), 1)])) == [captions.EqualTo(("cue_idx",), 1)]
    assert [s.path.rsplit("/", 1)[1].split(".")[0] for p in reader.partitions() for s in p.stretches] == ["clip2"]


def test_small_files_share_parts(folder):
    reader = captions.CaptionReader({"path": folder, "splitBytes": "5000"})
    parts = reader.partitions()
    assert max(sum(s.stop - s.start for s in p.stretches) for p in parts) <= 5000
    assert sum(len(p.stretches) > 1 for p in parts) > 0
    assert captions.CaptionReader({"path": f"{folder}/big.srt"}).partitions()[0].stretches[0].path.endswith("big.srt")


def test_artifacts_are_files_of_their_names(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a.srt", "one\n"), ("b c.srt", "two"), ("deep/d.vtt", None)], "name string, content string").repartition(3)
    write_artifacts(df, out)
    listed = lambda: sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs)
    assert listed() == ["a.srt", "b c.srt", "deep/d.vtt"]
    write_artifacts(spark.createDataFrame([("a.srt", "again")], "name string, content string"), out)
    assert listed() == ["a.srt", "b c.srt", "deep/d.vtt"] and os.listdir(out + "/deep") == ["d.vtt"]
    got = {n: [r.content for r in read_artifact(spark, out, n).collect()] for n in ("a.srt", "b c.srt", "deep/d.vtt", "none", "../a.srt")}
    assert got == {"a.srt": ["again\n"], "b c.srt": ["two\n"], "deep/d.vtt": ["\n"], "none": [], "../a.srt": []}


@pytest.mark.parametrize("bad", [[("a", "1"), ("a", "2")], [("ok", "1"), ("../out", "2")], [("/etc/x", "1")]])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, bad):
    out = tmp_path / "out"
    write_artifacts(spark.createDataFrame([("kept", "x")], "name string, content string"), str(out))
    with pytest.raises(Exception, match="name"):
        write_artifacts(spark.createDataFrame(bad, "name string, content string").repartition(2), str(out))
    assert os.listdir(out) == ["kept"] and (out / "kept").read_text() == "x\n"


def test_a_failing_task_and_its_second_try(spark, tmp_path):
    """A task that fails after it has written some files: the job is aborted and nothing is left. Tasks that ran twice put out one file a name."""
    out = tmp_path / "out"
    broken = spark.range(4).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") < 3, "x").otherwise(F.raise_error(F.lit("lost"))).cast("string").alias("content"))
    with pytest.raises(Exception, match="lost"):
        write_artifacts(broken.coalesce(1), str(out))
    assert not out.exists() or os.listdir(out) == []
    import pyarrow as pa

    writer, batch = ArtifactWriter(str(out)), pa.RecordBatch.from_pydict({"name": ["n"], "content": ["c"]})
    lost, won = writer.write(iter([batch])), writer.write(iter([batch]))
    assert isinstance(lost, Staged) and len(os.listdir(out / writer.staging)) == 2
    writer.commit([won, None])
    assert os.listdir(out) == ["n"]
