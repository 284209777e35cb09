"""Folders in any store that Arrow's file systems know: local ones, and those with a URI."""

from __future__ import annotations

import os

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a URI or a local path, and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def inside(name: str) -> str:
    """A name of a file in a folder or in folders below it; raises if it leads out of there."""
    parts = name.split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") or p.startswith(".staging-") for p in parts):
        raise ValueError(f"not a name of a file in the folder: {name!r}")
    return name
