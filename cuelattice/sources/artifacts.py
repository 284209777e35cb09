"""Data source `artifacts`: one text file for each row (name, content), there as a whole or not at all.

    with_sources(spark)  # of sources.files
    files.write.format("artifacts").mode("append").save(folder)

Tasks write into a staging folder of their job. Only when all have ended, files take their names; a job that fails, a task
that is run again and one that runs twice leave nothing behind. Files of other names stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

from .stores import inside, opened


@dataclass
class Staged(WriterCommitMessage):
    """Files of a task: (name in the staging folder, name to take)."""

    files: list[tuple[str, str]]


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = opened(self.folder)
        own, staged = uuid.uuid4().hex, []
        system.create_dir(f"{root}/{self.staging}", recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                file, content = f"{own}-{len(staged)}", content or ""
                with system.open_output_stream(f"{root}/{self.staging}/{file}") as out:
                    out.write((content if content.endswith("\n") else content + "\n").encode())
                staged.append((file, inside(name)))
        return Staged(staged)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.folder)
        files = sorted((name, file) for m in messages if m for file, name in m.files)
        twice = {a[0] for a, b in zip(files, files[1:]) if a[0] == b[0]}
        if twice:
            self.abort(messages)
            raise ValueError(f"more than one file of a name: {sorted(twice)[:5]}")
        for name, file in files:
            if "/" in name:
                system.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
            system.move(f"{root}/{self.staging}/{file}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = opened(self.folder)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


@dataclass
class Names(InputPartition):
    names: list[str]


class ArtifactReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.name = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",) and self.name is None:
                self.name = f.value
            else:
                yield f

    def partitions(self) -> list[Names]:
        system, root = opened(self.folder)
        names = sorted(x.path.removeprefix(f"{root}/") for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File)
        # A name that is asked for is compared, never made part of a path.
        names = [n for n in names if not n.startswith(".staging-") and (self.name is None or n == self.name)]
        return [Names(names[i : i + 100]) for i in range(0, len(names), 100)] or [Names([])]

    def read(self, partition: Names) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.folder)
        for name in partition.names:
            with system.open_input_stream(f"{root}/{name}") as f:
                yield pa.RecordBatch.from_pydict({"name": [name], "content": [f.read().decode("utf-8", "ignore")]})


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "name string, content string"

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"])
