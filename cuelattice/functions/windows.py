"""The best window of consecutive segments for a cue, with the costly ratio only where a bound leaves room for it."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import clean, run_of_meanings, token_cores, token_words

#: Characters are counted in so many bins; what falls into one bin together only loosens a bound.
BINS = 64
#: What rounding may take from a bound.
SLACK = 1e-9


def _counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") % BINS, minlength=BINS)


def _read(text: str) -> tuple[str, frozenset, list[str], list[str]]:
    """A text as it is compared: as a whole, its words, and its cores and their meanings in order."""
    tokens = [token_words(t) for t in text.split()]
    cores = [t for t in tokens if t[1] is not None]
    return clean(text), frozenset([t[0] for t in tokens]), [t[1] for t in cores], [t[2] for t in cores]


def _summed(rows: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Sums of rows[first:behind] for many pairs of places."""
    total = np.concatenate([np.zeros_like(rows[:1]), np.cumsum(rows, axis=0)])
    return total[behind] - total[first]


class Block:
    """Spans of up to `longest` consecutive segments that begin at one of the first `own`.

    For any cue each span has an upper bound of its score: exact in time, from counts of words and characters in the rest.
    Meanings are found by an inverted index of the segments; counts of a span are differences of prefix sums.
    """

    def __init__(self, texts: list[str], starts: np.ndarray, ends: np.ndarray, own: int, longest: int):
        n = len(texts)
        read = [_read(t) for t in texts]
        self.texts, self.words, self.cores, self.senses = ([x[k] for x in read] for k in range(4))
        spans = [(i, i + k) for i in range(min(own, n)) for k in range(1, longest + 1) if i + k <= n]
        self.first, self.behind = np.array(spans, np.int64).reshape(-1, 2).T
        self.n = self.behind - self.first
        self.start, self.end, self.center = starts[self.first], ends[self.behind - 1], ((starts + ends) / 2)[self.first]
        self.meanings: dict[str, tuple[list[int], list[int]]] = {}  # all places of a meaning, and without repeats
        for k in range(n):
            for m, times in Counter(self.senses[k]).items():
                every, places = self.meanings.setdefault(m, ([], []))
                every += [k] * times
                places.append(k)
        held = np.array([t != "" for t in self.texts], np.int64)
        spaces = np.maximum(self._sum(held) - 1, 0)
        self.length = self._sum(np.array([len(t) for t in self.texts], np.int64)) + spaces
        self.counts = self._sum(np.array([_counts(t) for t in self.texts]))
        self.counts[:, ord(" ") % BINS] += spaces
        self.n_cores = self._sum(np.array([len(c) for c in self.cores], np.int64))
        self.n_words = np.array([len(frozenset().union(*self.words[a:b])) for a, b in spans], np.int64)
        self.matchers: dict[int, SequenceMatcher] = {}

    def _sum(self, rows: np.ndarray) -> np.ndarray:
        return _summed(rows, self.first, self.behind)

    def search(self, cue: str, start: float, end: float, masks: list[np.ndarray], floor: float | None = None) -> list[tuple | None]:
        """For each mask of spans the best (i, j, token_start, token_end, score): of equals the first, then the shortest. None if nothing beats the floor."""
        text, words, cores, senses = _read(cue)
        time = np.maximum(0.0, np.minimum(self.end, end) - np.maximum(self.start, start)) / max(1e-6, end - start)
        segments = len(self.texts)
        in_cue: list[int] = []
        n_in_cue: list[int] = []
        in_span: list[int] = []
        for m, times in Counter(senses).items():
            every, places = self.meanings.get(m, ((), ()))
            in_span += every
            in_cue += places
            n_in_cue += [times] * len(places)
        counted = lambda places, times=None: np.bincount(np.array(places, np.int64), times, segments).astype(np.int64)
        shared_words, cue_run, span_run = self._sum(np.stack([np.array([len(words & w) for w in self.words], np.int64), counted(in_cue, n_in_cue), counted(in_span)], axis=1)).T
        both = np.minimum(shared_words, np.minimum(len(words), self.n_words))
        jaccard = both / np.maximum(1, len(words) + self.n_words - both)
        run = np.minimum(np.minimum(cue_run, span_run), len(cores))
        run = run / np.maximum(1, np.minimum(len(cores), self.n_cores))
        alike = 2 * np.minimum(self.counts, _counts(text)).sum(axis=1) / np.maximum(1, self.length + len(text))
        alike = np.where((self.length == 0) | (not text), (self.length == 0) & (not text), alike)
        most = 0.8 * (0.5 * jaccard + 0.3 * alike + 0.2 * np.minimum(run, 1.0)) + 0.2 * time + SLACK
        found: list[tuple | None] = [None] * len(masks)
        best = [-1.0 if floor is None else floor] * len(masks)
        inside = np.logical_or.reduce(masks)
        for s in np.flatnonzero(inside)[np.argsort(-most[inside], kind="stable")].tolist():
            wanted = [p for p, mask in enumerate(masks) if mask[s] and most[s] >= best[p]]
            if not wanted:
                if most[s] < min(best):
                    break
                continue
            scored = self._score(s, text, words, cores, senses, float(alike[s]), float(time[s]), min(best[p] for p in wanted))
            if scored is None:
                continue
            score, at, length = scored
            for p in wanted:
                before = found[p]
                if score > best[p] or before is not None and score == best[p] and s < before[0]:
                    best[p], found[p] = score, (s, at, length)
        token = lambda at, length: (at, at + length) if length else (None, None)
        return [f and (int(self.first[f[0]]), int(self.behind[f[0]]), *token(*f[1:]), best[p]) for p, f in enumerate(found)]

    def _score(self, s: int, text: str, words: frozenset, cores: list[str], senses: list[str], alike: float, time: float, least: float) -> tuple[float, int, int] | None:
        """(score, place and length of the longest run); None if what words and time give leaves it below `least` whatever the ratio."""
        a, b = int(self.first[s]), int(self.behind[s])
        other = frozenset().union(*self.words[a:b])
        jaccard = len(words & other) / len(words | other) if words and other else 0.0
        window = [c for k in range(a, b) for c in self.cores[k]]
        length, at = run_of_meanings(cores, window, senses, [m for k in range(a, b) for m in self.senses[k]])
        run = length / max(1, min(len(cores), len(window)))
        if 0.8 * (0.5 * jaccard + 0.3 * alike + 0.2 * run) + 0.2 * time + SLACK < least:
            return None
        ratio = self._ratio(s, text, " ".join(t for t in self.texts[a:b] if t))
        return 0.8 * (0.5 * jaccard + 0.3 * ratio + 0.2 * run) + 0.2 * time, at, length

    def _ratio(self, s: int, text: str, window: str) -> float:
        if not text or not window:
            return float(text == window)
        if text == window:
            return 1.0
        matcher = self.matchers.get(s)
        if matcher is None:
            matcher = self.matchers[s] = SequenceMatcher(None)
            matcher.set_seq2(window)
        matcher.set_seq1(text)
        return matcher.ratio()


def best_phrase(own: list[str], words: list[tuple[int, str]]) -> tuple[int, int, float]:
    """(number of the first and of the last text, ratio) of the run of words that is most like one's own, two words shorter to two longer.

    words has the number of its text with each. Character counts of a run slide along with it and bound its ratio.
    """
    best = (0, 0, 0.0)
    if not own or not words:
        return best
    text, shortest = " ".join(own), max(1, len(own) - 2)
    wanted = Counter(text)
    sizes = [len(w) for _, w in words]
    for n in range(shortest, max(shortest, min(len(words), len(own) + 2)) + 1):
        if n > len(words):
            break
        held, shared, length = Counter({" ": n - 1}), min(wanted[" "], n - 1), n - 1

        def slide(word: str, by: int, held: Counter = held) -> int:
            """How many more of the wanted characters are shared once a word comes or goes."""
            more = 0
            for ch in word:
                before = held[ch]
                held[ch] = before + by
                if ch in wanted:
                    more += min(wanted[ch], before + by) - min(wanted[ch], before)
            return more

        for _, w in words[:n]:
            shared += slide(w, 1)
        length += sum(sizes[:n])
        for i in range(len(words) - n + 1):
            if i:
                shared += slide(words[i - 1][1], -1) + slide(words[i + n - 1][1], 1)
                length += sizes[i + n - 1] - sizes[i - 1]
            if 2.0 * shared / (length + len(text)) > best[2]:
                score = phrase_ratio(text, " ".join(w for _, w in words[i : i + n]))
                if score > best[2]:
                    best = (words[i][0], words[i + n - 1][0], score)
    return best


def phrase_ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType())]))
def phrase_search(cue: pd.Series, texts: pd.Series) -> pd.DataFrame:
    """`best_phrase` of a cue in consecutive texts."""
    out = []
    for c, parts in zip(cue, texts, strict=True):
        words = [(k, w) for k, t in enumerate(parts if parts is not None else []) for w in token_cores(t or "")]
        out.append(best_phrase(token_cores(c or ""), words))
    return pd.DataFrame(out, columns=["first", "last", "score"])
