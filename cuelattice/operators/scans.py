"""Passes over sorted rows that carry something along, spread over tasks even where one group has most of the rows.

Rows are dealt by ranges of their order, so a large group becomes consecutive parts. What a part does to the value that is
carried has a summary, and summaries join: of each part the one of its last group goes to the driver (one small row a
part), which tells every part what is carried into it. Then all parts run at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

#: Which part a row of `in_order` lies in.
PART = "__part"


class Scan:
    """What is carried, and what it does to rows. Batches hold rows of at most one group where `add` gets them."""

    def zero(self) -> Any:
        """The summary of no rows."""
        raise NotImplementedError

    def add(self, summary: Any, batch: pa.RecordBatch) -> Any:
        """The summary with the next rows of the same group. It may change the one it gets."""
        raise NotImplementedError

    def join(self, left: Any, right: Any) -> Any:
        raise NotImplementedError

    def enter(self, summary: Any) -> Any:
        """What `run` is to carry after rows that have this summary; the summary itself unless a scan needs less."""
        return summary

    def run(self, carried: Any, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[Any, pa.RecordBatch]:
        """Rows of one or more groups. carried is None if the first row starts a group; starts tells all places where groups start.

        Returns what is carried on after the last row, and the rows put out.
        """
        raise NotImplementedError


def in_order(rows: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows sorted over consecutive parts, materialised, with the column PART. Rows that agree in all of `order` share a part."""
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))


def _changes(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> np.ndarray:
    """Places in a batch at which another group starts; last is the group of the row ahead of it."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for key in keys:
        x = batch.column(key)
        if n > 1:
            differs = pc.fill_null(pc.not_equal(x[1:], x[:-1]), False)
            one_null = pc.xor(pc.is_null(x[1:]), pc.is_null(x[:-1]))
            new[1:] |= pc.or_(differs, one_null).to_numpy(zero_copy_only=False)
    new[0] = _key(batch, keys, 0) != last
    return np.flatnonzero(new)


def _key(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def carried(rows: DataFrame, keys: list[str], scan: Scan, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Run a scan over rows of `in_order`, group by group of keys; columns are those that its summary needs."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        alone, summary, part = True, scan.zero(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _changes(batch, keys, last)
            if last is None:
                first, part = _key(batch, keys, 0), batch.column(PART)[0].as_py()
                starts = starts[starts > 0]
            if len(starts):
                alone, summary, batch = False, scan.zero(), batch.slice(int(starts[-1]))
            summary, last = scan.add(summary, batch), _key(batch, keys, batch.num_rows - 1)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "found": pa.array([pickle.dumps((first, last, alone, summary))], pa.binary())})

    parts = rows.select(PART, *dict.fromkeys([*keys, *(columns or [c for c in rows.columns if c != PART])])).mapInArrow(summarise, "part int, found binary").collect()
    into: dict[int, Any] = {}
    key, summary = None, None
    for part, found in sorted((x["part"], x["found"]) for x in parts):
        first, last, alone, own = pickle.loads(found)
        if first == key:
            into[part] = scan.enter(summary)
        key, summary = last, scan.join(summary, own) if alone and first == key else own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _changes(batch, keys, last)
            if last is None:
                state = into.get(batch.column(PART)[0].as_py())
                if state is not None:
                    starts = starts[starts > 0]
            last = _key(batch, keys, batch.num_rows - 1)
            state, out = scan.run(state, batch, starts)
            if out.num_rows:
                yield out

    return rows.mapInArrow(run, schema)


def schema_of(rows: DataFrame, more: str = "") -> str:
    """The columns of rows but for PART, and more ones, as mapInArrow wants them."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != PART)
    return f"{own}, {more}" if more else own


class RunningSums(Scan):
    """Adds to each row the sums of columns over its group, {name: column}: up to this row, or up to the one ahead. Whole numbers are added modulo 2^64."""

    def __init__(self, sums: dict[str, str], ahead: dict[str, str]):
        self.names, self.columns, self.upto = [*sums, *ahead], [*sums.values(), *ahead.values()], len(sums)

    def zero(self) -> list:
        return [0] * len(self.columns)

    def add(self, summary: list, batch: pa.RecordBatch) -> list:
        return [_wrapped(a + int(self._values(batch, c).sum())) for a, c in zip(summary, self.columns, strict=True)]

    def join(self, left: list, right: list) -> list:
        return [_wrapped(a + b) for a, b in zip(left, right, strict=True)]

    def run(self, carried: list | None, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[list, pa.RecordBatch]:
        group = np.zeros(batch.num_rows, np.int64)
        group[starts] = 1
        group = np.cumsum(group)
        after, found = [], []
        for k, c in enumerate(self.columns):
            x = self._values(batch, c)
            total = np.cumsum(x)
            others = total[starts] - x[starts]  # what lies in the batch ahead of each group
            base = np.concatenate([np.array([_wrapped(carried[k]) if carried else 0], np.int64), -others])
            sums = total + base[group]
            after.append(int(sums[-1]))
            found.append(sums if k < self.upto else sums - x)
        kept = batch.drop_columns([PART])
        names = [*kept.schema.names, *self.names]
        return after, pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x, pa.int64()) for x in found)], names=names)

    @staticmethod
    def _values(batch: pa.RecordBatch, column: str) -> np.ndarray:
        return np.asarray(pc.fill_null(batch.column(column), 0)).astype(np.int64)


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def running_sums(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str], ahead: dict[str, str] | None = None) -> DataFrame:
    """All columns of rows and running sums {name: column of whole numbers} of each group in order: `sums` with the row itself, `ahead` without."""
    scan = RunningSums(sums, ahead or {})
    return carried(in_order(rows, [*keys, *order]), keys, scan, schema_of(rows, ", ".join(f"`{n}` long" for n in scan.names)), scan.columns)


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """All columns of rows and their number in order, from 1, in each group; like row_number, but no group is one task's."""
    return running_sums(rows.withColumn("__one", F.lit(1)), keys, order, {name: "__one"}).drop("__one")


class Ranks(Scan):
    """Numbers distinct values of sorted columns from 1, over all rows; rows that agree share a number."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def zero(self) -> tuple:
        return None, None, 0

    def add(self, summary: tuple, batch: pa.RecordBatch) -> tuple:
        first, last, n = summary
        n += len(_changes(batch, self.columns, last))
        return first if last is not None else _key(batch, self.columns, 0), _key(batch, self.columns, batch.num_rows - 1), n

    def join(self, left: tuple, right: tuple) -> tuple:
        if left[1] is None or right[1] is None:
            return right if left[1] is None else left
        return left[0], right[1], left[2] + right[2] - (left[1] == right[0])

    def run(self, carried: tuple | None, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[tuple, pa.RecordBatch]:
        first, last, n = carried or self.zero()
        new = np.zeros(batch.num_rows, np.int64)
        new[_changes(batch, self.columns, last)] = 1
        ranks = n + np.cumsum(new)
        kept = batch.drop_columns([PART])
        out = pa.RecordBatch.from_arrays([*kept.columns, pa.array(ranks, pa.int64())], names=[*kept.schema.names, "rank"])
        return (first, _key(batch, self.columns, batch.num_rows - 1), int(ranks[-1])), out


def ranked(rows: DataFrame, columns: list[str], ties: list[str]) -> DataFrame:
    """All columns of rows and `rank`: 1, 2, ... for the distinct values of columns in order. Rows of one rank may lie in several tasks, told apart by ties."""
    return carried(in_order(rows, [*columns, *ties]), [], Ranks(columns), schema_of(rows, "rank long"), columns)
