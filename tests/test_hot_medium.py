"""One medium with nearly all rows: passes in order lie in many parts, far cues meet blocks, and few ratios are worked out."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from cuelattice.functions import windows
from cuelattice.operators import align, scans, timeline

from .test_alignment import WORDS, best_window, text_score

SEGMENTS = "media_id string, seg_idx int, start_s double, end_s double, text string"
CUES = "media_id string, cue_idx int, start_s double, end_s double, text string"


@pytest.fixture(autouse=True)
def many_parts(spark):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "16"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_parts_of_a_hot_medium_are_even(spark):
    rows = spark.range(64_000).select(F.when(F.col("id") % 50 > 0, "hot").otherwise(F.col("id").cast("string")).alias("media_id"), F.rand(1).alias("c"))
    sizes = sorted(r["count"] for r in scans.in_order(rows, ["media_id", "c"]).groupBy(scans.PART).count().collect())
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def folded(rows, end, least=0.8, most=8.0):
    """The rules for one medium, a cue after the other."""
    out, prev = [], 0.0
    for start, stop, pos, locked in sorted(rows):
        if not locked:
            start = max(prev, 0.0, start)
            stop = max(start + 1e-3, stop)
            stop = start + least if stop - start < least else start + most if stop - start > most else stop
        clamped, late = end is not None and stop > end, end is not None and start >= end
        final = end if clamped else stop
        prev = end if late else final
        if not late and not (clamped and (final <= start if locked else final - start < 0.001)):
            out.append((pos, round(start, 6), round(final, 6)))
    return sorted(out)


@pytest.mark.parametrize("density, share", [(0.3, 0.0), (1.0, 0.02), (3.0, 0.3)])
def test_constraints_of_a_hot_medium(spark, density, share):
    """Cues closer than they may be push each other on across many parts; gaps and locked cues stop that."""
    r, media = random.Random(7), {}
    for m, n, end in (("hot", 3000, 2900.0), ("a", 5, None), ("z", 40, 12.0)):
        media[m] = [(t := r.uniform(-1, n * density), t + r.choice([0.05, 0.8, 2.0, 30.0, -1.0]), i, r.random() < share) for i in range(n)], end
    rows = [(m, s, e, "x", pos, locked) for m, (cues, _) in media.items() for s, e, pos, locked in cues]
    df = spark.createDataFrame(rows, "media_id string, start_s double, end_s double, text string, pos long, locked boolean").repartition(5)
    ends = spark.createDataFrame([(m, end) for m, (_, end) in media.items() if end], "media_id string, media_end double")
    got = timeline.enforce_constraints(df, ends=ends, respect_locks=True).collect()
    for m, (cues, end) in media.items():
        assert sorted((x.pos, round(x.start_s, 6), round(x.end_s, 6)) for x in got if x.media_id == m) == folded(cues, end)


def test_pieces_compose_like_functions():
    r, scan = random.Random(2), timeline.Constraints(0.8, 8.0)
    cues = [(r.uniform(-2, 30), r.uniform(0, 40), r.random() < 0.1, r.choice([None, 25.0])) for _ in range(60)]
    for k in range(0, 60, 3):
        some = [scan._of(*c) for c in cues[k : k + 3]]
        whole = timeline.compose(timeline.compose(some[0], some[1]), some[2])
        other = timeline.compose(some[0], timeline.compose(some[1], some[2]))
        for x in [0.0, *(r.uniform(0, 45) for _ in range(50))]:
            y = x
            for f in some:
                y = timeline.value(f, y)
            assert abs(timeline.value(whole, x) - y) < 1e-9 and abs(timeline.value(other, x) - y) < 1e-9


def test_nearest_and_numbers_of_a_hot_medium(spark):
    r = random.Random(4)
    segs = [("hot", i, float(c := r.randrange(400)), c + r.choice([0.0, 2.0]), f"s{i}") for i in range(500)] + [("b", 0, 5.0, 6.0, "x")]
    cues = [(m, i, float(c := r.randrange(420)), c + 1.0, "") for m in ("hot", "b", "none") for i in range(300)]
    s, c = spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame(cues, CUES)
    center = lambda x: (x[2] + x[3]) / 2
    got = {(x.media_id, x.cue_idx): (x.distance, x.seg_idx) for x in timeline.nearest_segment(c, s).collect()}
    want = {}
    for q in cues:
        found = [(abs(center(x) - center(q)), x[1]) for x in segs if x[0] == q[0]]
        if found:
            want[q[:2]] = min(found)
    assert got == want
    shown = timeline.renumbered(c.withColumnRenamed("cue_idx", "pos")).collect()
    for m in ("hot", "b"):
        inside = sorted((x.start_s, x.end_s, x.pos, x["index"]) for x in shown if x.media_id == m)
        assert [x[3] for x in inside] == list(range(1, 301))
    used = s.filter("seg_idx % 7 = 3").select("media_id", F.col("seg_idx").alias("i"), (F.col("seg_idx") + 1).alias("j"))
    runs = sorted((x.i, x.j) for x in timeline.uncovered_runs(s, used).collect() if x.media_id == "hot")
    assert runs == [(0, 3)] + [(i, min(i + 6, 500)) for i in range(4, 500, 7)]


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ly", "er"]) for _ in range(n))


def test_far_cues_meet_blocks_of_a_long_medium(spark):
    """5,000 segments; cues far from all of them, some with words of none. Results are those of a search over all spans."""
    r = random.Random(5)
    segs, at = [], 0.0
    for _ in range(5000):
        segs.append((at, at + 1.5, sentence(r, r.randint(1, 4))))
        at += 1.5
    texts = [segs[3210][2] + " " + segs[3211][2], "zzyzx qwrtp", "", sentence(r, 3)]
    cues = [(at + 200.0 * k, at + 200.0 * k + 2, t) for k, t in enumerate(texts, 1)] + [(at + 13.0, at + 14.0, "the river stonely"), (600.0, 601.0, segs[400][2])]
    s = spark.createDataFrame([("m", i, *x) for i, x in enumerate(segs)], SEGMENTS)
    c = spark.createDataFrame([("m", i, *x) for i, x in enumerate(cues)], CUES)
    got = {x.cue_idx: x.match for x in align.best_windows(c, s).collect()}
    for i, cue in enumerate(cues):
        want = best_window(cue, segs)
        assert (got[i].i, got[i].j, got[i].token_start, got[i].token_end, got[i].method) == (*want[:4], want[5]), (i, cue)
        assert abs(got[i].score - want[4]) < 1e-9


@pytest.mark.parametrize("longer", [False, True])
def test_bounds_hold_and_spare_ratios(monkeypatch, longer):
    r, calls = random.Random(6), []
    texts = [sentence(r, r.randint(40, 90) if longer else r.randint(0, 12)) for _ in range(64)]
    starts = windows.np.arange(64) * 2.0
    block = windows.Block(texts, starts, starts + 1.8, 60, 3)
    real = windows.Block._ratio
    monkeypatch.setattr(windows.Block, "_ratio", lambda self, *a: calls.append(a) or real(self, *a))
    everything = windows.np.ones(len(block.n), bool)
    searched = 0
    for k in range(12):
        i = r.randrange(58)
        cue = " ".join(w for w in " ".join(texts[i : i + 1 + k % 2]).split() if r.random() > 0.2) if k % 4 else sentence(r, 6)
        start, end = i * 2.0 + 0.3, i * 2.0 + 2.5
        want = None
        for s in range(len(block.n)):
            a, b = int(block.first[s]), int(block.behind[s])
            jac, ratio, run, at, n, m = text_score(cue, " ".join(texts[a:b]).strip())
            time = max(0.0, min(block.end[s], end) - max(block.start[s], start)) / max(1e-6, end - start)
            score = 0.8 * (0.5 * jac + 0.3 * ratio + 0.2 * (run / max(1, min(n, m)))) + 0.2 * time
            if want is None or score > want[4]:
                want = (a, b, at if run else None, at + run if run else None, score)
        (got,) = block.search(cue, start, end, [everything])
        assert got[:4] == want[:4] and abs(got[4] - want[4]) < 1e-12
        (none,) = block.search(cue, start, end, [everything], floor=want[4])
        assert none is None
        searched += len(block.n)
    assert len(calls) * 5 < searched


def test_phrases_by_sliding_counts_spare_ratios(monkeypatch):
    r, calls = random.Random(8), []
    real = windows.phrase_ratio
    monkeypatch.setattr(windows, "phrase_ratio", lambda a, b: calls.append(1) or real(a, b))
    steps = 0
    for _ in range(60):
        flow = [(k, w) for k in range(11) for w in sentence(r, r.randint(0, 6)).lower().split()]
        own = [w[: r.randint(2, 9)] for _, w in flow[r.randrange(20) : r.randrange(20, 30)]][: r.randint(0, 5)] or sentence(r, r.randint(0, 2)).split()
        best = (0, 0, 0.0)
        if own and flow:
            least = max(1, len(own) - 2)
            for n in range(least, max(least, min(len(flow), len(own) + 2)) + 1):
                for i in range(len(flow) - n + 1):
                    steps += 1
                    score = difflib.SequenceMatcher(None, " ".join(own), " ".join(w for _, w in flow[i : i + n])).ratio()
                    if score > best[2]:
                        best = (flow[i][0], flow[i + n - 1][0], score)
        assert windows.best_phrase(own, flow) == best
    assert len(calls) * 4 < steps
