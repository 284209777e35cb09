"""Repair of the structure of conversations at least cost, by a weighted automaton that is made deterministic as it is used.

What may be done to a row (keep it, give it another role, delete it, insert one ahead of it) are arcs of a small weighted
automaton over where a conversation stands: at its start, after a system turn, after a user's, after an assistant's. Read
from the last row to the first, the costs of all four to the end make a vector; vectors less their minimum are the states of
a deterministic automaton, of which there are few, made when they are first met and kept in a table of transitions. The scan
of a conversation is one look at that table a row. Then a trace goes the other way along arcs that are tight, that is, whose
cost is just what the vectors on both sides leave for it, and of those takes the least edit.

Neither way needs a conversation in one task: rows are dealt by ranges, and what a part does to a vector, or to where the
trace stands, joins with what its neighbours do.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import PART, Scan, carried, in_order, schema_of
from .common import cut
from .ordered import joined

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Where a conversation stands. It may end at its start or after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where each place leads by a turn of its own kind, s, u and a; None where such a turn may not stand.
MOVES = {START: (SYSTEM, USER, None), SYSTEM: (None, USER, None), USER: (None, None, ASSISTANT), ASSISTANT: (None, USER, None)}
#: Where each place leads by a user's or assistant's turn that is inserted or whose role is changed; only one of them fits.
FITS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Symbols: 0 is a row that has to go; others are 1 + 2 * (0, 1, 2 for s, u, a; 3 for other roles) + whether it is truncated.
GONE = 0
NEVER = 1 << 20

Vector = tuple[int, int, int, int]


def _closed(costs: list[int]) -> Vector:
    """Costs once turns may also be inserted."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[FITS[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _row_arcs(place: int, symbol: int) -> list[tuple[str, int, int]]:
    """(edit, cost, place after) of what may be done to a row, in the order of the edits' letters."""
    arcs = [("D", DELETE, place)]
    if symbol != GONE:
        kind, broken = divmod(symbol - 1, 2)
        kept = MOVES[place][kind] if kind < 3 else None
        if kept is not None:
            arcs.append(("K", TRUNCATED * broken, kept))
        arcs.append(("R", RETYPE + TRUNCATED * broken, FITS[place]))
    return arcs


END = _closed([0, NEVER, NEVER, 0])


class Lazy:
    """The deterministic automaton: states are vectors less their minimum, transitions are found when first asked for."""

    def __init__(self) -> None:
        self.table: dict[tuple[Vector, int], tuple[Vector, int]] = {}

    def step(self, state: Vector, symbol: int) -> tuple[Vector, int]:
        """(state, weight) ahead of a row, from the state behind it."""
        found = self.table.get((state, symbol))
        if found is None:
            costs = _closed([min(cost + state[after] for _, cost, after in _row_arcs(q, symbol)) for q in range(4)])
            least = min(costs)
            found = self.table[state, symbol] = tuple(min(c - least, NEVER) for c in costs), least
        return found


LAZY = Lazy()


def _packed(state: Vector) -> int:
    return sum(c << 8 * q for q, c in enumerate(state))


def _unpacked(code: int) -> Vector:
    return tuple(code >> 8 * q & 255 for q in range(4))


class Costs(Scan):
    """From the last row to the first: the states behind and ahead of each row, and the weight between them.

    A summary is what a stretch of rows makes of each of four vectors that let only one place be the end.
    """

    def zero(self) -> list[Vector]:
        return [tuple(0 if q == k else NEVER for q in range(4)) for k in range(4)]

    def add(self, summary: list[Vector], batch: pa.RecordBatch) -> list[Vector]:
        symbols = batch.column("symbol").to_pylist()
        out = []
        for vector in summary:
            least = min(vector)
            state, total = tuple(min(c - least, NEVER) for c in vector), least
            for symbol in symbols:
                state, weight = LAZY.step(state, symbol)
                total += weight
            out.append(tuple(c + total for c in state))
        return out

    def join(self, left: list[Vector], right: list[Vector]) -> list[Vector]:
        return [self._applied(right, vector) for vector in left]

    @staticmethod
    def _applied(summary: list[Vector], vector: Vector) -> Vector:
        return tuple(min(vector[k] + summary[k][q] for k in range(4)) for q in range(4))

    def enter(self, summary: list[Vector]) -> Vector:
        costs = self._applied(summary, END)
        return tuple(c - min(costs) for c in costs)

    def run(self, carried: Vector | None, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[Vector, pa.RecordBatch]:
        last = np.zeros(batch.num_rows, bool)
        last[starts] = True
        state, behind, ahead, weights = carried, [], [], []
        for symbol, new in zip(batch.column("symbol").to_pylist(), last.tolist(), strict=True):
            if new:
                state = END
            behind.append(_packed(state))
            state, weight = LAZY.step(state, symbol)
            ahead.append(_packed(state))
            weights.append(weight)
        kept = batch.drop_columns([PART])
        more = {"behind": pa.array(behind, pa.int64()), "ahead": pa.array(ahead, pa.int64()), "weight": pa.array(weights, pa.int32()), "last": pa.array(last)}
        return state, pa.RecordBatch.from_arrays([*kept.columns, *more.values()], names=[*kept.schema.names, *more])


@lru_cache(1 << 16)
def _edits(place: int, symbol: int, ahead: int, behind: int, weight: int, last: bool) -> tuple[str, str, int, int]:
    """(edits, places they lead to, place after, cost) of a row: inserts ahead of it, its own edit, and behind the last row more inserts."""
    own, after = _unpacked(ahead), _unpacked(behind)
    edits, places, total, done = "", "", 0, False
    while not done:
        arcs = [(e, cost, to, cost + after[to] == own[place] + weight) for e, cost, to in _row_arcs(place, symbol)]
        arcs.append(("I", INSERT, FITS[place], INSERT + own[FITS[place]] == own[place]))
        edit, cost, place, _ = min(a for a in arcs if a[3])
        edits, places, total, done = edits + edit, places + str(place), total + cost, edit != "I"
    while last and END[place]:
        place = FITS[place]
        edits, places, total = edits + "I", places + str(place), total + INSERT
    return edits, places, place, total


class Trace(Scan):
    """From the first row to the last: each row's edits, their cost, the repaired lines, and whether its role may follow the one ahead.

    What is carried is where the repaired conversation stands and the initial of the last role; a summary has the first of
    these for each place at which the rows may begin.
    """

    LEGAL = {"su", "ua", "au"}
    COLUMNS = ["symbol", "ahead", "behind", "weight", "last", "role"]

    def zero(self) -> tuple:
        return (START, SYSTEM, USER, ASSISTANT), None

    def add(self, summary: tuple, batch: pa.RecordBatch) -> tuple:
        places = list(summary[0])
        for row in self._rows(batch):
            for k in range(4):
                places[k] = _edits(places[k], *row)[2]
        return tuple(places), self._initial(batch.column("role")[batch.num_rows - 1].as_py())

    def join(self, left: tuple, right: tuple) -> tuple:
        return tuple(right[0][q] for q in left[0]), left[1] if right[1] is None else right[1]

    def enter(self, summary: tuple) -> tuple:
        return summary[0][START], summary[1]

    @staticmethod
    def _initial(role: str) -> str:
        return role[:1]

    def _rows(self, batch: pa.RecordBatch):
        return zip(*(batch.column(c).to_pylist() for c in self.COLUMNS[:-1]), strict=True)

    def run(self, carried: tuple | None, batch: pa.RecordBatch, starts: np.ndarray) -> tuple[tuple, pa.RecordBatch]:
        place, before = carried or (START, None)
        new = np.zeros(batch.num_rows, bool)
        new[starts] = True
        edits, costs, illegal, repaired = [], [], [], []
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        for row, role, text, first in zip(self._rows(batch), roles, texts, new.tolist(), strict=True):
            if first:
                place, before = START, None
            done, places, place, cost = _edits(place, *row)
            lines = []
            for edit, to in zip(done, places, strict=True):
                if edit == "I":
                    lines.append("user:" if to == str(USER) else "assistant:")
                elif edit != "D":
                    lines.append(f"{role if edit == 'K' else 'user' if to == str(USER) else 'assistant'}:{text}")
            edits.append(done)
            costs.append(cost)
            illegal.append(before is not None and before + self._initial(role) not in self.LEGAL)
            repaired.append("\n".join(lines) if lines else None)
            before = self._initial(role)
        out = {"edits": pa.array(edits, pa.string()), "cost": pa.array(costs, pa.int64()), "illegal": pa.array(illegal), "repaired": pa.array(repaired, pa.string())}
        return (place, before), pa.RecordBatch.from_arrays([*batch.columns, *out.values()], names=[*batch.schema.names, *out])


def _is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def repair(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, fault, edits, cost, illegal, repaired, place and PART), one per row, in order over consecutive parts.

    rows has conv_id, turn, role and text; role and text aren't null, other columns are ignored. A conversation's rows are
    taken by turn (null first), those of one turn by role and then by the SHA-256 of role and text; rows that repeat follow each
    other. A null conv_id is a conversation of its own. fault is blank, duplicate (of a role and text seen earlier),
    truncated or null. edits has a letter for each edit (K keep, R another role, D delete, I insert), inserts that end a
    conversation with its last row; repaired has the lines that come of them. illegal tells whether the role's initial may
    not follow that of the row ahead. An empty table gives no rows. Texts are held by the row only, long ones too.
    """
    role_text = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("digest", role_text).withColumn("deal", F.monotonically_increasing_id())
    by = ["conv_id", "turn", "role", "digest", "deal"]
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("deal").withColumn("place", F.monotonically_increasing_id()))
    seen = placed.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = cut(seen.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first"))
    again = placed.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    broken = F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z")
    fault = F.when(_is_blank(F.col("text")), "blank").when(F.col("place") > F.col("first"), "duplicate").when(broken, "truncated")
    kind = F.instr(F.lit("sua"), F.substring("role", 1, 1)).cast("int")
    kind = F.when((kind == 0) | (F.col("role") == ""), 3).otherwise(kind - 1)
    symbol = F.when(F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)), GONE).otherwise(1 + 2 * kind + F.col("fault").isNotNull().cast("int"))
    marked = again.select("conv_id", "place", "turn", "role", "text", fault.alias("fault")).withColumn("symbol", symbol)
    backward = in_order(marked, ["conv_id", F.desc("place")])
    scanned = carried(backward, ["conv_id"], Costs(), schema_of(backward, "behind long, ahead long, weight int, last boolean"), ["symbol"])
    forward = in_order(scanned, ["conv_id", "place"])
    traced = carried(forward, ["conv_id"], Trace(), schema_of(forward, f"`{PART}` int, edits string, cost long, illegal boolean, repaired string"), Trace.COLUMNS)
    return cut(traced.select("conv_id", "turn", "role", "text", "fault", "edits", "cost", "illegal", "repaired", "place", PART))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by a checksum of conversation and turn. Nulls are one space, in the checksum and as role or text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.filter(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(k == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def structure_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the repair of rows.

    A conversation without rows has zeros, an empty audit and the hash of an empty text. Turns that are null leave gaps alone.
    """
    found = repair(rows)
    faults = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    counts = found.groupBy("conv_id").agg(*faults, F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    audit = joined(found, ["conv_id"], "edits", "", "audit", digest=False)
    digest = joined(found, ["conv_id"], "repaired", "\n", "repaired_sha256")
    whole = conversations.select("conv_id").distinct()
    for part in (counts, gaps, audit, digest):
        whole = whole.unionByName(part, allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
