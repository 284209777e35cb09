"""The life of jobs: states in order, late and repeated events, failures, time-outs, restarts from the checkpoint."""

import json

from cuelattice.streaming import ingest, jobs


def finish(queries):
    for q in queries:
        q.awaitTermination()


def states(spark, out):
    rows = spark.read.parquet(f"{out}/jobs").orderBy("job_id", "nth").collect()
    found = {}
    for r in rows:
        found.setdefault(r.job_id, []).append((r.nth, r.status, r.message, r.result_files))
    return found


def test_files_that_land_are_jobs(spark, tmp_path):
    """A good file, a bad one, one that is no caption file; then a restart with a new file and one that was there before."""
    box, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    box.mkdir()
    (box / "a.srt").write_bytes(b"1\r\n0 --> 1\r\nhi \xff\r\n")
    (box / "bad.srt").write_bytes(b"\xff\xfe\xff")
    (box / "large.srt").write_bytes(b"1\n0 --> 1\n" + b"x" * 500)
    (box / "b.mp4").write_bytes(b"no captions")
    finish(ingest.start_quality_stream(spark, str(box), out, state, most_bytes=400))
    found = sorted(states(spark, out).values(), key=str)
    assert [[(n, s) for n, s, _, _ in x] for x in found] == [[(1, "QUEUED"), (2, "RUNNING"), (3, end)] for end in sorted(["COMPLETED", "FAILED", "FAILED"], key=lambda e: [x[2][1] for x in found].index(e))]
    ends = {x[2][1:3] for x in found}
    assert ends == {("COMPLETED", ""), ("FAILED", "not text in UTF-8"), ("FAILED", "510 bytes are more than 400")}
    (name,) = next(x[2][3] for x in found if x[2][1] == "COMPLETED")
    files = spark.read.parquet(f"{out}/files").collect()
    assert [(r.name, r.content) for r in files] == [(name, "1\n0 --> 1\nhi\n")]
    (box / "c.srt").write_bytes(b"1\n0 --> 1\n")
    finish(ingest.start_quality_stream(spark, str(box), out, state, most_bytes=400))
    after = states(spark, out)
    assert len(after) == 4 and sum(len(x) for x in after.values()) == 12
    assert {x[2][2] for x in after.values() if x[2][1] == "COMPLETED"} == {"", "Block 1 has no text."}


def events(path, *rows):
    path.write_text("".join(json.dumps(dict(zip(("job_id", "at", "status", "message", "result_files"), r))) + "\n" for r in rows))


def test_late_repeats_time_outs_and_restarts(spark, tmp_path):
    box, out, state = tmp_path / "events", str(tmp_path / "out"), str(tmp_path / "state")
    box.mkdir()

    def run():
        stream = spark.readStream.schema(jobs.EVENTS).json(str(box))
        changes = jobs.job_changes(stream, timeout_seconds=60, lateness="10 seconds")
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/jobs/batch={n}")
        changes.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return {k: [(s, m) for _, s, m, _ in v] for k, v in states(spark, out).items()}

    at = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}.000Z"
    # "b" starts before it is told that it was queued; "c" has statuses of other spellings and one that nobody knows.
    events(
        box / "1.json",
        ("a", at(0), "QUEUED", "q", []), ("a", at(1), "RUNNING", "r", []),
        ("b", at(2), "RUNNING", "r", []), ("b", at(3), "QUEUED", "late", []),
        ("c", at(1), "pending", "q", []), ("c", at(2), "lost", "?", []), ("c", at(4), "complete", "done", ["x.srt"]),
        ("d", at(1), "QUEUED", "q", []), (None, at(1), "QUEUED", "q", []),
    )
    first = run()
    assert first == {"a": [("QUEUED", "q"), ("RUNNING", "r")], "b": [("RUNNING", "r")], "c": [("QUEUED", "q"), ("COMPLETED", "done")], "d": [("QUEUED", "q")]}
    # After a restart: "a" ends, "c" repeats itself, and time passes for "b" and "d".
    events(box / "2.json", ("a", at(30), "FAILED", "broken", []), ("a", at(30), "COMPLETED", "done", []), ("c", at(31), "RUNNING", "again", []), ("c", at(32), "complete", "again", []), ("e", at(200), "QUEUED", "q", []))
    run()
    events(box / "3.json", ("e", at(210), "RUNNING", "r", []), ("b", at(205), "COMPLETED", "too late", []))
    last = run()
    assert last["a"] == [("QUEUED", "q"), ("RUNNING", "r"), ("FAILED", "broken")]
    assert last["c"] == first["c"]
    assert last["b"] == [("RUNNING", "r"), ("FAILED", "timed out while RUNNING")]
    assert last["d"] == [("QUEUED", "q"), ("FAILED", "timed out while QUEUED")]
    assert last["e"] == [("QUEUED", "q"), ("RUNNING", "r")]
    table = {r.job_id: (r.status, r.message, r.result_files) for r in jobs.job_table(spark.read.parquet(f"{out}/jobs")).collect()}
    assert table["c"] == ("COMPLETED", "done", ["x.srt"]) and table["a"][0] == "FAILED"
