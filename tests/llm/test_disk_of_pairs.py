"""What the near-duplicate stage and the pipeline hold on disk: unlike pairs aren't verified, steps go in parts, outputs of stages go."""

import os
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa

from cuelattice.llm import simhash, toxicity

from .test_similar_groups import brute_force, groups


def texts(seed):
    """Long texts of their own words that have a passage in common with the next one, some of them with a near copy."""
    r = random.Random(seed)
    rows = []
    for i in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(600)]
        words[100:130], words[300:330] = [f"p{i}x{k}" for k in range(30)], [f"p{i + 1}x{k}" for k in range(30)]
        rows.append((2 * i, " ".join(words)))
        if i % 8 == 0:
            rows.append((2 * i + 1, " ".join([*words[:-3], "changed"])))
    return rows


def test_unlike_texts_are_not_verified(spark, monkeypatch):
    asked = []

    class Seen(simhash.Membership):
        def __init__(self, rows, columns):
            asked.append({r.doc_id for r in rows.collect()})
            super().__init__(rows, columns)

    monkeypatch.setattr(simhash, "Membership", Seen)
    rows = texts(1)
    assert groups(spark, rows) == brute_force(rows)
    assert set.union(*asked) == {x for i in range(0, 80, 16) for x in (i, i + 1)}


def test_steps_in_parts(spark, monkeypatch):
    rows = texts(2)
    monkeypatch.setattr(simhash, "MOVED_LEAST", 20_000)
    monkeypatch.setattr(simhash, "MOVED_SHARE", 0.1)
    seen = []
    each = simhash.partitions_for
    monkeypatch.setattr(simhash, "partitions_for", lambda *a: seen.append(each(*a)) or seen[-1])
    assert groups(spark, rows) == brute_force(rows)
    assert max(seen) > 2


def test_whole_sketches_bound_what_texts_do_not_share():
    r = np.random.default_rng(4)
    a, b, apart = [], [], []
    for size, change in ((0, 1), (5, 2), (150, 20), (384, 10), (385, 60), (3000, 400), (3000, 6000)):
        for _ in range(20):
            x = np.unique(r.integers(-(2**62), 2**62, size))
            y = np.unique(np.concatenate([x[r.random(len(x)) > change / (2 * max(1, size))], r.integers(-(2**62), 2**62, change // 2)]))
            a.append(simhash._whole_sketch(x))
            b.append(simhash._whole_sketch(y))
            apart.append(len(np.setxor1d(x, y)))
    differ, apart = simhash._differing_bins(a, b), np.array(apart)
    assert len({len(x) for x in a}) > 3
    assert (differ <= apart).all() and ((differ - apart) % 2 == 0).all()
    assert (differ[-20:] > 2 / 9 * 3000).all()  # texts that share nothing are told apart, whatever their length
    assert len(simhash._differing_bins([], [])) == 0


def test_what_a_stage_was_given_goes(spark, tmp_path, monkeypatch):
    spark.range(5).write.parquet(str(tmp_path / "documents.parquet"))
    held = []

    def stage(s, docs, d):
        held.append(sorted(os.listdir(tmp_path / "out" / os.listdir(tmp_path / "out")[0])) if len(held) else [])
        return docs.selectExpr("id + 1 as id")

    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda s: f"file://{tmp_path}/out")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), stage) for i in range(4)])
    assert sorted(r.id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [4, 5, 6, 7, 8]
    assert held == [[], ["0"], ["1"], ["2"]]


def test_chunks_go_as_they_are_joined():
    chunks = [pa.array(x, pa.list_(pa.int32())) for x in ([[1, 2], [], [3]], [], [[4]], [[5, 6], [7], [8, 9, 10]])]
    chunks[-1] = chunks[-1].slice(1)
    taken = chunks[::-1]
    values, offsets = toxicity.joined_lists(taken)
    assert not taken and values.tolist() == [1, 2, 3, 4, 7, 8, 9, 10] and offsets.tolist() == [0, 2, 2, 3, 4, 5, 8]
    assert [x.tolist() for x in toxicity.joined_lists([])] == [[], [0]]
