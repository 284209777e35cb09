"""Data source `captions`: caption files as rows of blocks, in parts of about as many bytes.

    with_sources(spark)  # of sources.files
    spark.read.format("captions").load(folder)

Small files share a part; a large one is cut, and a part of it begins behind the first blank line from its place on. Filters
on path and media_id choose the files before any is opened.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from ..functions.text import SPACE_CHARS, UPLOAD_EXTENSIONS
from .stores import opened

#: Bytes of a part, unless the option splitBytes says otherwise.
SPLIT_BYTES = 32 << 20
#: Blocks of a batch.
ROWS = 5_000

#: White space as SQL's patterns for blocks have it.
BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BETWEEN = re.compile(rf"\n{BLANK}*\n")
#: In bytes: a blank line with something behind it. Its group ends where a part may begin.
LIMIT = re.compile(rb"(\n[ \t\r\n\x0b\x0c]*\n)[ \t\r\x0b\x0c]*[^ \t\r\n\x0b\x0c]")

SCHEMA = "path string, media_id string, cue_idx long, block string"


@dataclass
class Stretch:
    """Bytes of one file, from the first limit of blocks at or behind `start` to that of `stop`."""

    path: str
    start: int
    stop: int
    size: int


@dataclass
class Part(InputPartition):
    stretches: list[Stretch]


def media_of(path: str) -> str:
    found = re.search(r"([^/]+)\.[^./]+$", path)
    return found[1] if found else ""


def allowed(path: str) -> bool:
    found = re.search(r"[^/](\.[^./]+)$", path)
    return bool(found) and found[1].lower() in UPLOAD_EXTENSIONS


def asked_by(f: Filter) -> Callable[[str, str], bool] | None:
    """What a filter asks of path and media_id; None if it asks for anything else."""
    if getattr(f, "attribute", None) not in (("path",), ("media_id",)):
        return None
    value = (lambda path, media: path) if f.attribute == ("path",) else (lambda path, media: media)
    tests = {
        IsNotNull: lambda x: True,
        EqualTo: lambda x: x == f.value,
        In: lambda x: x in f.value,
        StringStartsWith: lambda x: x.startswith(f.value),
        StringEndsWith: lambda x: x.endswith(f.value),
        StringContains: lambda x: f.value in x,
    }
    test = tests.get(type(f))
    return test and (lambda path, media: test(value(path, media)))


def limit(file: pa.NativeFile, at: int, size: int) -> int:
    """The place of the first limit of blocks at or behind `at`; the end of the file if there is none."""
    if at <= 0 or at >= size:
        return min(max(at, 0), size)
    held, step = b"", 1 << 16
    while True:
        file.seek(at + len(held))
        more = file.read(step)
        held, step = held + more, step * 2
        found = LIMIT.search(held)
        if found:
            return at + found.end(1)
        if not more:
            return size


def blocks_of(file: pa.NativeFile, start: int, stop: int, size: int) -> list[str]:
    """The blocks between two limits, as those of the whole file are."""
    file.seek(start)
    text = re.sub("\r\n?", "\n", file.read(stop - start).decode("utf-8", "ignore"))
    text = text.lstrip(SPACE_CHARS) if start == 0 else text
    if stop == size:
        text = text.rstrip(SPACE_CHARS)
    found = BETWEEN.split(text)
    if stop < size and found[-1] == "":
        found.pop()
    return found


class CaptionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.tests: list[Callable[[str, str], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = asked_by(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Part]:
        system, root = opened(self.folder)
        info = system.get_file_info(root)
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        parts, open_part, held = [], [], 0
        for x in sorted(infos, key=lambda i: i.path):
            if x.type != fs.FileType.File or not allowed(x.path) or not all(t(x.path, media_of(x.path)) for t in self.tests):
                continue
            if x.size > self.split_bytes:
                parts += [Part([Stretch(x.path, at, min(at + self.split_bytes, x.size), x.size)]) for at in range(0, x.size, self.split_bytes)]
                continue
            if open_part and held + x.size > self.split_bytes:
                parts.append(Part(open_part))
                open_part, held = [], 0
            open_part.append(Stretch(x.path, 0, x.size, x.size))
            held += x.size
        return [*parts, *([Part(open_part)] if open_part else [])] or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        rows: list[tuple] = []
        for s in partition.stretches:
            with system.open_input_file(s.path) as file:
                start, stop = limit(file, s.start, s.size), limit(file, s.stop, s.size)
                if start == stop and s.size:
                    continue
                # Numbers go on over the parts of a file, so a later part counts the blocks ahead of it.
                ahead, at = 0, 0
                while at < start:
                    to = min(start, limit(file, at + self.split_bytes, s.size))
                    ahead, at = ahead + len(blocks_of(file, at, to, s.size)), to
                for k, block in enumerate(blocks_of(file, start, stop, s.size)):
                    rows.append((s.path, media_of(s.path), ahead + k, block))
                    if len(rows) == ROWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "media_id", "cue_idx", "block"])


class CaptionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptionReader:
        return CaptionReader(self.options)
