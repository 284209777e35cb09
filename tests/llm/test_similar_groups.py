"""Near-duplicate groups against brute force: crowded keys, and changes in one place."""

import collections
import itertools
import random
import re

import numpy as np

from cuelattice.llm import simhash

from .test_operators import components


def brute_force(rows):
    sets = {d: set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for d, t in rows}
    return components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))


def groups(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_groups(docs, **more).collect()}


def test_groups_within_one_template(spark):
    """Texts of a template with a passage of their group and words of their own: alike in words, but only groups are similar."""
    r = random.Random(5)
    template = [f"t{i}" for i in range(200)]
    rows = []
    for g in range(60):
        base = list(template)
        at = r.randrange(5, 150)
        base[at : at + 10] = [f"g{g}x{i}" for i in range(10)]
        for _ in range(4):
            w = list(base)
            for k in r.sample(range(200), 2):
                w[k] = f"own{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    want = brute_force(rows)
    assert 50 <= len(set(want.values())) < len(rows) - 60
    for block in (50, 2000):
        assert groups(spark, rows, block=block) == want


def test_pairs_with_changes_in_one_place(spark):
    """A passage added, cut off or put in, and words changed here and there, at similarities of about 0.8 to 0.9."""
    r = random.Random(6)
    vocabulary = [f"v{i}" for i in range(2000)]
    weights = [1 / (i + 1) for i in range(2000)]
    rows = []
    for i in range(160):
        n = r.randrange(120, 400)
        w = r.choices(vocabulary, weights, k=n)
        extra = r.choices(vocabulary, weights, k=int(n * r.uniform(0.08, 0.24)))
        at = r.randrange(n)
        changed = list(w)
        for k in r.sample(range(n), max(1, n // 60)):
            changed[k] = r.choice(vocabulary)
        other = (w + extra, extra + w, w[:at] + extra + w[at:], changed)[i % 4]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    want = brute_force(rows)
    linked = [sum(want[2 * i + 1] == 2 * i for i in range(k, 160, 4)) for k in range(4)]
    assert min(linked) > 10 and sum(linked) < 160
    assert groups(spark, rows) == want


def test_groups_of_the_documents_table(spark):
    """All links of sf0.01 by brute force: every pair of texts that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    having = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    pairs = {(a, b) for ds in having.values() if len(ds) < 400 for a, b in itertools.combinations(sorted(ds), 2)}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert len(links) > 20 and all(len(ds) < 400 for ds in having.values())
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    empty = min((d for d, s in sets.items() if not s), default=None)
    assert got == {d: find(d) if s else empty for d, s in sets.items()}


def test_sketches_bound_what_texts_do_not_share():
    r = np.random.default_rng(3)
    for size, change in ((0, 1), (5, 2), (150, 20), (150, 100), (3000, 400)):
        for _ in range(20):
            a = np.unique(r.integers(-(2**62), 2**62, size))
            b = np.unique(np.concatenate([a[r.random(len(a)) > change / (2 * max(1, size))], r.integers(-(2**62), 2**62, change // 2)]))
            apart = len(np.setxor1d(a, b))
            differ = sum((x ^ y).bit_count() for x, y in zip(*([v & (2**64 - 1) for v in simhash._sketch(s)] for s in (a, b)), strict=True))
            assert differ <= apart and (differ - apart) % 2 == 0
            if size == 150:
                assert differ > apart / 3
