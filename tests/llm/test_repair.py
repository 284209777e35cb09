"""Repair of conversations against a search over all edits in plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from cuelattice.llm import ordered, repair
from cuelattice.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{s(c)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        out += [(c, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def report(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's rows after damage."""
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in {"su", "ua", "au"} for a, b in zip(rows, rows[1:]))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted):
        """(cost, edits, lines) of rows from i on, after a turn of that initial; no more than two inserts in a row are ever of use."""
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if i < len(rows):
            role, text = rows[i][2], rows[i][3]
            ways = [(2, "D", last, ())]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if role[:1] in allowed[last] and role:
                    ways.append((more, "K", role[:1], (f"{role}:{text}",)))
                ways += [(1 + more, "R", to[0], (f"{to}:{text}",)) for to in ("user", "assistant") if to[0] in allowed[last]]
            for cost, edit, to, lines in ways:
                rest = best(i + 1, to, 0)
                found.append((cost + rest[0], edit + rest[1], lines + rest[2]))
        if inserted < 3:
            for to in ("user", "assistant"):
                if to[0] in allowed[last]:
                    rest = best(i, to[0], inserted + 1)
                    found.append((5 + rest[0], "I" + rest[1], (f"{to}:",) + rest[2]))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    count = lambda f: faults.count(f)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(df, originals, rows):
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert set(got) == set(originals)
    for c in originals:
        assert got[c] == report([r for r in rows if r[0] == c]), c
    return got


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    df = QUERIES["op12_conversation_structure_repair"](spark, sf)
    assert df.columns == ["conv_id", *COLUMNS]
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"] * 2
    got = compare(df, {r[0] for r in rows}, damage(rows))
    assert len({x[6] for x in got.values()}) > 20


@pytest.mark.parametrize("seed", range(2))
def test_conversations_over_several_parts(spark, seed, monkeypatch):
    """Odd roles, nulls, ties, repeats, a conversation of hundreds of rows cut by the parts, and a column that clashes."""
    monkeypatch.setattr(ordered, "STRETCH", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    r = random.Random(seed)
    rows = []
    for c in [*range(40), None]:
        n = 250 if c in (7, None) else r.randint(1, 12)
        for i in range(n):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "s"])
            text = r.choice(["Yes.", "No", "Well? ", "", " \t", None, "So it is!\n", "ünd", f"Turn {i}.", f"Turn {i}"])
            rows.append((c, r.choice([i, i, i, i + 3, None]), role, text))
            if r.random() < 0.1:
                rows.append(rows[-1])
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as place", "2 as digest", "3 as fault").repartition(3)
    compare(repair.structure_report(df, repair.damaged(df)), {x[0] for x in rows}, damage(rows))
    plain = [(x[0], x[1], x[2] or "", x[3] or "") for x in rows]
    compare(repair.structure_report(df, df.fillna("", ["role", "text"])), {x[0] for x in rows}, plain)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_of_a_repair(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "How are you?"), (1, 3, "assistant", "Fine.")]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    assert [(x.fault, x.edits, x.cost, x.illegal, x.repaired) for x in got] == [
        (None, "D", 2, False, None),
        ("duplicate", "D", 2, True, None),
        (None, "K", 0, True, "user:How are you?"),
        (None, "K", 0, False, "assistant:Fine."),
    ]


def test_all_rows_dropped_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)
    assert tuple(repair.structure_report(df, repair.damaged(df)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.structure_report(empty, repair.damaged(empty)).count() == 0


def test_few_states_are_ever_made():
    lazy, states = repair.Lazy(), [repair.END]
    for state in states:
        for symbol in range(9):
            after = lazy.step(state, symbol)[0]
            if after not in states:
                states.append(after)
    assert len(states) < 100 and max(max(s) for s in states) < 256
