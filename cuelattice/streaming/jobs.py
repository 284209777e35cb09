"""Extension: the life of jobs as keyed state of a stream.

Events tell what happened to a job; what is kept for each is where it stands. A job is QUEUED, then RUNNING, and ends as
COMPLETED or FAILED, each with a message. Events may come late, twice or out of order: a job never goes back, and what comes
after its end changes nothing. A job of which nothing is heard for a while fails by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import STATUSES, job_status

#: How far a job is. Failing and completing are both the end of it.
STAGE = {"QUEUED": 0, "RUNNING": 1, "FAILED": 2, "COMPLETED": 2}

EVENTS = "job_id string, at timestamp, status string, message string, result_files array<string>"
CHANGES = "job_id string, nth int, at timestamp, status string, message string, result_files array<string>"


class JobLife(StatefulProcessor):
    """Puts out a row for each change of a job's status; nth counts them."""

    def __init__(self, timeout_seconds: int):
        self.timeout_ms = timeout_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, nth int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, nth = self.job.get() if self.job.exists() else (None, 0)
        # Of one moment, the earlier stage comes first; of two ends the failure.
        events = sorted((e for batch in rows for e in batch.to_dict("records") if e["status"] in STATUSES), key=lambda e: (e["at"], STAGE[e["status"]], e["status"] != "FAILED", str(e["message"])))
        out, last = [], None
        for e in events:
            if status is None or STAGE[e["status"]] > STAGE[status]:
                status, nth, last = e["status"], nth + 1, e["at"]
                out.append(self._row(key, nth, e["at"], status, e["message"], e["result_files"]))
        if out:
            self.job.update((status, nth))
            self._set_timer(status, last)
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, nth = self.job.get()
        if STAGE[status] < STAGE["FAILED"]:
            self.job.update(("FAILED", nth + 1))
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame([self._row(key, nth + 1, at, "FAILED", f"timed out while {status}", [])])

    def _set_timer(self, status: str, at: datetime) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if STAGE[status] < STAGE["FAILED"]:
            self.handle.registerTimer(int(pd.Timestamp(at).timestamp() * 1000) + self.timeout_ms)

    @staticmethod
    def _row(key: tuple, nth: int, at: datetime, status: str, message: str | None, files) -> dict:
        return {"job_id": key[0], "nth": nth, "at": at, "status": status, "message": message, "result_files": list(files) if files is not None else []}

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, timeout_seconds: int = 1800, lateness: str = "10 minutes") -> DataFrame:
    """Rows (job_id, nth, at, status, message, result_files) of a stream of events (job_id, at, status, message, result_files).

    Any spelling of a status that `job_status` knows will do; others are left out, as are events without a job_id or time.
    The timer goes by the times of events, and lateness is how far these may lie behind each other. State is kept in RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = events.select("job_id", "at", job_status(F.col("status")).alias("status"), "message", "result_files").filter("job_id is not null and at is not null and status is not null")
    return known.withWatermark("at", lateness).groupBy("job_id").transformWithStateInPandas(JobLife(timeout_seconds), outputStructType=CHANGES, outputMode="append", timeMode="eventTime")


def job_table(changes: DataFrame) -> DataFrame:
    """Where each job stands: rows (job_id, status, message, result_files, queued_at, changed_at)."""
    last = lambda c: F.max_by(c, "nth").alias(c)
    return changes.groupBy("job_id").agg(last("status"), last("message"), last("result_files"), F.min("at").alias("queued_at"), F.max_by("at", "nth").alias("changed_at"))
