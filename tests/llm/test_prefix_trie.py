"""The trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from cuelattice.llm import ordered
from cuelattice.llm.prefix_trie import prefix_trie, rebuilt
from cuelattice.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), role or "", text or ""))
    own = {c: [x[4:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return made


def brute(rows):
    made, nodes = sequences(rows), {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t) if w])
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[:-1] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * words(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(path))))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(x) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    df = QUERIES["op13_conversation_prefix_trie"](spark, sf)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in df.dtypes} == {"bigint", "string"}
    assert got(df) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_shared_turns_of_all_depths(spark, seed, monkeypatch):
    """Copies of whole conversations, long shared starts, turnless ones, nulls, ties, repeated rows and a name that clashes."""
    monkeypatch.setattr(ordered, "STRETCH", 5)
    r = random.Random(seed)
    rows = []
    long_one = [(i, r.choice(["user", "assistant", None]), r.choice(["yes", "no  no", "", None, "a b\tc\n"])) for i in range(37)]
    for c in [*range(45), 60, 61, 62, 1003]:
        turns = [(i, r.choice(["user", "assistant"]), r.choice(["yes", "no", "maybe so"])) for i in range(r.choice([1, 1, 2, 3, 5, 8]))]
        if c % 3 == 0:
            n = r.choice([3, 9, 17, 37])
            turns = long_one[:n] + [(90 + i, "user", str(r.randrange(2))) for i in range(r.choice([0, 0, 2]))]
        if c % 7 == 0:
            turns += [(None, "user", "first"), turns[-1], (turns[-1][0], "user", "tie")]
        rows += [(c, *t) for t in turns]
    rows.append((None, 0, "user", "no conversation"))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as place", "2 as rank").repartition(3)
    assert got(prefix_trie(*rebuilt(df))) == brute(rows)


def test_one_conversation_and_none(spark):
    rows = [(5, i, "user", f"turn {i}") for i in range(9)]
    assert got(prefix_trie(*rebuilt(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)
    turnless = [(5, 0, "user", "lost, as the one it begins like is absent")]
    assert zlib.crc32(b"5") % 4 > 0
    assert got(prefix_trie(*rebuilt(spark.createDataFrame(turnless, SCHEMA)))) == brute(turnless)
    assert prefix_trie(*rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
