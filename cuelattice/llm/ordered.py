"""Texts of a group joined in order, or the SHA-256 of that, without a group in one row on the way."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import PART

#: Characters of a stretch of joined texts that becomes a row.
STRETCH = 1 << 20


class _Hashed:
    def __init__(self) -> None:
        self.digest = hashlib.sha256()

    def add(self, text: str) -> None:
        self.digest.update(text.encode())

    def done(self) -> str:
        return self.digest.hexdigest()


class _Joined(list):
    add = list.append

    def done(self) -> str:
        return "".join(self)


def joined(rows: DataFrame, keys: list[str], text: str, separator: str, name: str, digest: bool = True) -> DataFrame:
    """Rows (keys, name): the texts of each group in order, joined by a separator, or the lowercase hex SHA-256 of that.

    rows are those of `in_order` by keys and more. A part finishes the groups that it holds whole; of a group that may go
    on in another part it puts out stretches of joined texts, which then stream through one task in their order, as the
    hash is sequential. Null texts are left out; a group of nothing else isn't returned.
    """
    kinds = [rows.schema[k].dataType for k in keys]
    declared = ", ".join(f"`{k}` {t.simpleString()}" for k, t in zip(keys, kinds, strict=True))
    finish = _Hashed if digest else _Joined

    def finished(value: str) -> str:
        one = finish()
        one.add(value)
        return one.done()

    def batch_of(found: list[tuple], types: list[pa.DataType | None], names: list[str], like: pa.Schema) -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t or like.field(n).type) for c, t, n in zip(columns, types, names, strict=True)], names=names)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [*[None] * len(keys), pa.int32(), pa.int32(), pa.string(), pa.bool_()], [*keys, "part", "nth", "value", "edge"]
        key, held, size, part, nth, first, like = None, [], 0, None, 0, True, None
        out: list[tuple] = []

        def put(edge: bool) -> None:
            nonlocal held, size, nth
            if held:
                value, edge = separator.join(held), edge or nth > 0
                out.append((*key, part, nth, value if edge else finished(value), edge))
                held, size, nth = [], 0, nth + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            like, part = batch.schema, batch.column(PART)[0].as_py()
            groups = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for own, value in zip(groups, batch.column(text).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        put(first)
                        first = False
                    key, nth = own, 0
                if value is not None:
                    held.append(value)
                    size += len(value) + 1
                    if size > STRETCH:
                        put(True)
            if out:
                yield batch_of(out, types, names, like)
                out.clear()
        if key is not None:
            put(True)
        if out:
            yield batch_of(out, types, names, like)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one, like = None, None, None
        types, names = [*[None] * len(keys), pa.string()], [*keys, name]
        for batch in batches:
            like, done = batch.schema, []
            groups = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for own, value in zip(groups, batch.column("value").to_pylist(), strict=True):
                if own != key:
                    if one is not None:
                        done.append((*key, one.done()))
                    key, one = own, finish()
                else:
                    one.add(separator)
                one.add(value)
            if done:
                yield batch_of(done, types, names, like)
        if one is not None:
            yield batch_of([(*key, one.done())], types, names, like)

    found = rows.select(*keys, text, PART).mapInArrow(stretches, f"{declared}, part int, nth int, value string, edge boolean")
    whole = found.filter("not edge").select(*keys, F.col("value").alias(name))
    edges = found.filter("edge").repartition(*keys).sortWithinPartitions(*keys, "part", "nth").select(*keys, "value")
    return whole.unionByName(edges.mapInArrow(streamed, f"{declared}, `{name}` string"))
