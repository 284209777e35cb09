"""Words held against candidates: as plain Python finds them, few ratios worked out, each row's words matched once and over many tasks."""

import difflib
import random

import pytest

from cuelattice.functions import similarity
from cuelattice.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def nearest(word, candidates):
    best, score = "", 0.0
    for c in candidates:
        a, b = similarity.plain(word), similarity.plain(c)
        s = difflib.SequenceMatcher(None, a, b).ratio() if a and b else float(a == b)
        if s > score:
            best, score = c, s
    return best, score


def random_words(draw, letters, n):
    return ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 12]))) for _ in range(n)]


@pytest.mark.parametrize("letters", ["ab", "thnreioasd", "éèçABß日\U0001f600"])
def test_matches_are_those_of_a_plain_loop(letters):
    draw = random.Random(letters)
    for _ in range(40):
        words, candidates = random_words(draw, letters, 8), random_words(draw, letters, draw.randrange(12))
        assert similarity.best_matches(words, candidates) == [nearest(w, candidates) for w in words]
        assert similarity.best_matches(words, candidates, 0.72) == [x if x[1] >= 0.72 else ("", 0.0) for x in (nearest(w, candidates) for w in words)]


def test_long_words_and_chunks_of_words(monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", 8)
    draw = random.Random(1)
    words = ["".join(draw.choice("abcd") for _ in range(n)) for n in (63, 64, 65, 90, 250, 3)]
    candidates = [*(w[1:] + "x" for w in words), "", "abc", words[4]]
    assert similarity.best_matches(words, candidates) == [nearest(w, candidates) for w in words]


def test_few_ratios(monkeypatch):
    calls, plain_ratio = [], similarity.ratio
    monkeypatch.setattr(similarity, "word_ratio", lambda a, b: calls.append(1) or plain_ratio(a, b))
    draw = random.Random(2)
    cue, said = (" ".join("".join(draw.choice("thnreioasd") for _ in range(draw.randrange(3, 12))) for _ in range(100)) for _ in range(2))
    similarity.correct_words(cue, f"{said} {cue[:12]}")
    assert len(calls) < 100


def tasks_of_python(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("ArrowEvalPython"), plan.index("ArrowEvalPython") < plan.index("Repartition")


def test_each_row_is_matched_once_behind_the_exchange(spark):
    assert tasks_of_python(QUERIES["fuzzy_best"](spark, SF)) == (1, True)


def test_turns_are_corrected_behind_an_exchange(spark):
    assert tasks_of_python(QUERIES["token_correct"](spark, SF)) == (1, True)
