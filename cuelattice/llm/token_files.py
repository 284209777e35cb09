"""Token ids as Arrow stream files of equal-length sequences and their masks.

Documents lie in order of doc_id over files, end to end, cut into sequences of one length; the last sequence of a file is
filled up. A file is an Arrow stream: its batches hold `ids` and `mask` as fixed-size lists (true where there is a token),
all batches but the last the same number of sequences. A reader maps the file into memory, finds the batches by their
headers, and hands out sequence i as a view of batch i // n: nothing is copied. Ids are as narrow as the vocabulary allows.
A second stream beside each file tells where its documents begin, and a manifest lists the files in order with what lies
ahead of them.

Tasks write under names of their own; what counts is what the manifest lists. So a task that is run again, or twice at once,
does no harm, and what it left is removed when the manifest is written.
"""

from __future__ import annotations

import bisect
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, shared_folder, text_bytes
from .packing import compiled

#: Bytes of text that a file is made of, about.
FILE_BYTES = 64 << 20
#: Sequences of a batch.
BATCH = 256

MANIFEST = "manifest.json"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a URI or a local path, and the path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))


class SequenceWriter:
    """Writes ids, given a document at a time, as sequences of one length."""

    def __init__(self, sink: pa.NativeFile, length: int, width: np.dtype, batch: int = BATCH):
        self.length, self.width, self.batch = length, np.dtype(width), batch
        self.type = pa.from_numpy_dtype(self.width)
        self.schema = pa.schema([("ids", pa.list_(self.type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.length * self.batch:
            self._put(self.batch)

    def _put(self, sequences: int) -> None:
        """Batches of `sequences` as long as there are ids for whole ones."""
        whole, size, at = np.concatenate(self.held), self.length * sequences, 0
        while len(whole) - at >= size:
            self._write(whole[at : at + size], np.ones(size, bool))
            at += size
        self.held, self.n_held = [whole[at:]], len(whole) - at

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((ids, self.type), (mask, pa.bool_()))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> int:
        """The number of sequences."""
        if self.n_held:
            left = np.concatenate(self.held)
            padded = np.zeros(-(-len(left) // self.length) * self.length, self.width)
            padded[: len(left)] = left
            self._write(padded, np.arange(len(padded)) < len(left))
        self.writer.close()
        return -(-self.n_ids // self.length)


class SequenceFile:
    """Sequences of a file by their number. From a local file they are views of its mapped memory."""

    def __init__(self, folder: str, name: str):
        system, path = opened(folder)
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(f"{path}/{name}") if local else system.open_input_stream(f"{path}/{name}")
        self.batches = list(pa.ipc.open_stream(self.source))
        self.each = self.batches[0].num_rows if self.batches else 1
        self.n = sum(b.num_rows for b in self.batches)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i: ids as a view, the mask as an Arrow array, whose bits are one too."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        ids, mask = self.batches[i // self.each].columns
        i %= self.each
        return ids[i].values.to_numpy(zero_copy_only=True), mask[i].values


class TokenFiles:
    """All sequences of a folder by their number, and the manifest."""

    def __init__(self, folder: str):
        self.folder, (system, path) = folder, opened(folder)
        with system.open_input_stream(f"{path}/{MANIFEST}") as f:
            self.manifest = json.loads(f.read())
        self.first = [x["first_sequence"] for x in self.manifest["files"]]
        self.files: dict[int, SequenceFile] = {}

    def __len__(self) -> int:
        return self.manifest["n_sequences"]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = bisect.bisect_right(self.first, i) - 1
        if at not in self.files:
            self.files[at] = SequenceFile(self.folder, self.manifest["files"][at]["ids"])
        return self.files[at][i - self.first[at]]


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, length: int = 2048, end_id: int = 1, file_bytes: int = FILE_BYTES) -> dict:
    """Write documents (doc_id, text) as token files and their manifest into a folder that all executors reach; the manifest.

    Every text is encoded whole and gets end_id; a null or empty one is that id alone. Documents are in ascending order of
    doc_id, null ones first; those of one doc_id by the hash of their texts, so that repeats can lie in several tasks.
    Other columns are ignored. An empty table makes a manifest without files. A long text is encoded by one task and runs
    through as many sequences as it takes. `vocabulary` is a path on the driver.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    description = spark.sparkContext.broadcast(text)
    n_vocabulary = max(json.loads(text)["model"]["vocab"].values()) + 1
    width = np.dtype("<u2" if max(n_vocabulary, end_id + 1) <= 1 << 16 else "<u4")
    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    rows = docs.select("doc_id", text_bytes().alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # Small inputs still get a few files for each core, large ones files of about file_bytes.
    files = max(1, -(-size // file_bytes), min(3 * spark.sparkContext.defaultParallelism, size >> 22))
    by = ["doc_id", F.xxhash64("t"), F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(int(files), *by).sortWithinPartitions("doc_id", F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, writer = compiled(description.value), None
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{part:06d}-{own}.{kind}.arrow" for kind in ("ids", "docs")]
        docs_writer, n_docs = None, 0
        for batch in pieces(batches):
            if writer is None:
                system, path = opened(folder)
                sinks = [system.open_output_stream(f"{path}/{name}") for name in names]
                writer = SequenceWriter(sinks[0], length, width)
                schema = pa.schema([batch.schema.field("doc_id"), ("start", pa.int64()), ("n_tokens", pa.int64())])
                docs_writer = pa.ipc.new_stream(sinks[1], schema)
            starts, sizes = [], []
            for ids in tokens.encode(batch.column("t").to_pylist()):
                starts.append(writer.n_ids)
                sizes.append(len(ids) // 4 + 1)
                writer.add(np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
            docs_writer.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            n_docs += batch.num_rows
        if writer is not None:
            n_sequences = writer.close()
            docs_writer.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "ids": [names[0]], "docs": [names[1]], "n_docs": [n_docs], "n_ids": [writer.n_ids], "n_sequences": [n_sequences]})

    found = sorted(dealt.mapInArrow(run, "part long, ids string, docs string, n_docs long, n_ids long, n_sequences long").collect())  # a row a file
    listed, ids_ahead, sequences_ahead = [], 0, 0
    for x in found:
        listed.append({"ids": x["ids"], "docs": x["docs"], "n_docs": x["n_docs"], "n_ids": x["n_ids"], "first_id": ids_ahead, "first_sequence": sequences_ahead})
        ids_ahead, sequences_ahead = ids_ahead + x["n_ids"], sequences_ahead + x["n_sequences"]
    manifest = {"length": length, "width": width.itemsize, "end_id": end_id, "n_ids": ids_ahead, "n_sequences": sequences_ahead, "doc_id": docs.schema["doc_id"].dataType.simpleString(), "files": listed}
    system, path = opened(folder)
    with system.open_output_stream(f"{path}/{MANIFEST}") as out:
        out.write(json.dumps(manifest).encode())
    wanted = {x[k] for x in listed for k in ("ids", "docs")}
    for info in system.get_file_info(fs.FileSelector(path)):
        if info.base_name.endswith(".arrow") and info.base_name not in wanted:
            system.delete_file(info.path)
    return manifest


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), one per document, from the files of a folder: a task reads a file a batch at a time.

    start counts the ids of all documents ahead; ids_crc32 is taken over the ids as little-endian unsigned 32-bit integers.
    """
    manifest = TokenFiles(folder).manifest
    files = manifest["files"]
    schema = f"doc_id {manifest['doc_id']}, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(x["ids"], x["docs"], x["first_id"]) for x in files], "ids string, docs string, first_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                yield from _documents(folder, x["ids"], x["docs"], x["first_id"])

    return listed.repartition(len(files)).mapInArrow(run, schema)


def _documents(folder: str, ids_name: str, docs_name: str, first_id: int) -> Iterator[pa.RecordBatch]:
    """The documents of one file, a batch of them at a time; both streams are read once, side by side."""
    system, path = opened(folder)
    source = pa.memory_map(f"{path}/{ids_name}") if isinstance(system, fs.LocalFileSystem) else system.open_input_stream(f"{path}/{ids_name}")
    sequences = iter(pa.ipc.open_stream(source))
    at, held = 0, np.empty(0, "<u4")  # the id that `held` begins with, and ids that were read
    with system.open_input_stream(f"{path}/{docs_name}") as f:
        for docs in pa.ipc.open_stream(f):
            sums = []
            for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                crc, done = 0, 0
                while done < n:
                    inside = start + done - at
                    if inside >= len(held):
                        at += len(held)
                        held = next(sequences).column("ids").flatten().to_numpy().astype("<u4")
                        continue
                    some = held[inside : inside + n - done]
                    crc, done = zlib.crc32(some, crc), done + len(some)
                sums.append(crc)
            start = pc.add(docs.column("start"), first_id)
            yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (sequence, ids array<int>, mask array<boolean>) of all files of a folder, for jobs that want rows."""
    manifest = TokenFiles(folder).manifest
    schema = "sequence long, ids array<int>, mask array<boolean>"
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(x["ids"], x["first_sequence"]) for x in manifest["files"]], "ids string, first long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (x for batch in batches for x in batch.to_pylist()):
            at = row["first"]
            for b in SequenceFile(folder, row["ids"]).batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), b.column("ids").cast(pa.list_(pa.int32())), b.column("mask").cast(pa.list_(pa.bool_()))], names=["sequence", "ids", "mask"])
                at += b.num_rows

    return listed.repartition(len(manifest["files"])).mapInArrow(run, schema)


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32): documents written as token files into a folder, or a new one in the folder for checkpoints, and read back."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, vocabulary, folder)
    return read_documents(docs.sparkSession, folder)
