"""Schemas of the data model: transcripts, cues, files, the catalog and jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSCRIPTS = "media_id string, language string, segments array<struct<start double, end double, text string>>"
LOOSE_CUES = "media_id string, cue_idx int, start double, end double, start_s double, end_s double, start_ms double, end_ms double, text string, language string, format string"
SEGMENTS = "media_id string, seg_idx int, start_s double, end_s double, text string"
CUES = "media_id string, cue_idx int, start_s double, end_s double, text string, language string"
FILES = "path string, media_id string, fmt string, content string"
VALIDATION = "valid boolean, issues array<string>, format string"
JOB = "job_id string, description string, meta map<string,string>, status string, message string, result_files array<string>"
JOB_REPLY = "job_id string, status string, message string, result_files array<string>"

CATALOG = {
    "users": "id bigint not null, username string not null, password_hash string not null, email string, role string not null",
    "videos": "id bigint not null, user_id bigint, filename string not null, upload_time timestamp, language string, original boolean",
    "subtitles": "id bigint not null, video_id bigint, user_id bigint, filename string not null, language string, upload_time timestamp, processed boolean, job_id bigint",
    "jobs": "id bigint not null, user_id bigint, video_id bigint, subtitle_id bigint, job_type string not null, status string not null, result_url string, created_at timestamp, completed_at timestamp",
}
#: child table, its column, parent table
FOREIGN_KEYS = [("videos", "user_id", "users"), ("subtitles", "video_id", "videos"), ("subtitles", "user_id", "users"), ("subtitles", "job_id", "jobs"), ("jobs", "user_id", "users"), ("jobs", "video_id", "videos"), ("jobs", "subtitle_id", "subtitles")]

STATUSES = ("QUEUED", "RUNNING", "FAILED", "COMPLETED")


def job_status(value: Column) -> Column:
    """The engine's status of any of the spellings in use; null for anything else."""
    v = F.upper(F.trim(value))
    return (
        F.when(v.isin(*STATUSES), v)
        .when(v == "PENDING", "QUEUED")
        .when(v == "PROCESSING", "RUNNING")
        .when(v == "COMPLETE", "COMPLETED")
    )
