"""Scores by all contexts, however many there are, against brute force."""

import math
import random
import zlib

from cuelattice.llm import lm

from .test_operators import ppm


def test_more_contexts_than_a_bounded_model_holds(spark):
    r = random.Random(8)
    letters = "abcdefghijklmnop"
    texts = {d: " ".join("".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(r.randrange(1, 900))) for d in range(60)}
    texts |= {100 + d: " ".join(r.choices(texts[d].split(), k=30)) + " Zebra é" * (d % 2) for d in range(30)} | {200: ""}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    train = [x.lower().encode() for d, x in texts.items() if not out[d]]
    pad = bytes([lm.PAD]) * lm.ORDER
    contexts = {s[i - k : i] for s in (pad + x for x in train) for i in range(lm.ORDER, len(s) + 1) for k in range(lm.ORDER + 1)}
    assert len(contexts) > lm.CONTEXTS and sum(out.values()) > 5
    score = ppm(train, 10**9)
    want = {d: score(x.lower().encode()) for d, x in texts.items() if len(x) < 1500}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (50, lm.COMMON_WINDOWS):
        got = {x.doc_id: x.score for x in lm.lm_scores(docs, most_windows=most).collect()}
        assert all(math.isclose(got[d], want[d], rel_tol=1e-5, abs_tol=1e-4) for d in want)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(None, "some text"), (None, None)], "doc_id long, text string")
    got = sorted(x.score for x in lm.lm_scores(docs).collect())
    assert math.isclose(got[1], -math.log10(255), rel_tol=1e-6) and math.isclose(got[0], -10 * math.log10(255), rel_tol=1e-6)
