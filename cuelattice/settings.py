"""Settings from the environment, or any mapping, with their defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Words that switch a setting on.
YES = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    upload_dir: str = "./uploads"
    processed_dir: str = "./processed"
    work_dir: str = "./work"
    debug: bool = False
    allowed_origins: list[str] = field(default_factory=lambda: ["*"])
    llm_provider: str = ""
    stt_provider: str = ""


def _listed(value: str | None) -> list[str]:
    """The parts of a comma list that aren't blank."""
    return list(filter(None, map(str.strip, (value or "").split(","))))


def read_settings(values: Mapping[str, str] | None = None) -> Settings:
    """Folders are kept as they are given, as they may lie in any store that Spark reads."""
    v = os.environ if values is None else values
    plain = Settings()
    return Settings(
        upload_dir=v.get("UPLOAD_DIR", plain.upload_dir),
        processed_dir=v.get("PROCESSED_DIR", plain.processed_dir),
        work_dir=v.get("WORK_DIR", plain.work_dir),
        debug=v.get("DEBUG", "false").lower() in YES,
        allowed_origins=_listed(v.get("CORS_ALLOW_ORIGINS")) or plain.allowed_origins,
        llm_provider=v.get("LLM_PROVIDER", ""),
        stt_provider=v.get("STT_PROVIDER", ""),
    )
