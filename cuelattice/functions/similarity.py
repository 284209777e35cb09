"""Similarity of caption texts. The sequence ratio has no built-in equal, so it runs on Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import SYNONYMS

SAME_MEANING, TYPO, CAREFUL_TYPO, LOW_OVERLAP = 0.86, 0.72, 0.80, 0.10


def clean(text: str | None) -> str:
    text = text or ""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


def ratio(a: str, b: str) -> float:
    """SequenceMatcher's ratio, in this order: it isn't symmetric for long texts."""
    if not a or not b or a == b:
        return float(a == b)
    return SequenceMatcher(None, a, b).ratio()


def ratios(pairs: Iterable[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """The ratio of each distinct pair. What a matcher learns of a second text serves all pairs that have it."""
    found, matcher, last = {}, SequenceMatcher(None), None
    for a, b in sorted(set(pairs), key=lambda x: x[1]):
        if not a or not b or a == b:
            found[a, b] = float(a == b)
            continue
        if b != last:
            matcher.set_seq2(b)
            last = b
        matcher.set_seq1(a)
        found[a, b] = matcher.ratio()
    return found


word_ratio = lru_cache(1 << 17)(ratio)


@lru_cache(1 << 17)
def token_parts(token: str) -> tuple[str, str, str]:
    first, behind = 0, len(token)
    while first < behind and not token[first].isalnum():
        first += 1
    while first < behind and not token[behind - 1].isalnum():
        behind -= 1
    return token[:first], token[first:behind], token[behind:]


@lru_cache(1 << 17)
def plain(core: str) -> str:
    return core.lower() if core.isalnum() and core.isascii() else clean(core).lower()


@lru_cache(1 << 17)
def meaning(core: str) -> str:
    """What two words share if one is taken for the other."""
    core = plain(core)
    return SYNONYMS.get(core, core)


#: What ASCII has besides letters and digits.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


@lru_cache(1 << 17)
def token_words(token: str) -> tuple[str, str | None, str | None]:
    """A token, its core and the core's meaning as they are compared; None if it has no core."""
    if token.isascii():
        word = token.lower()
        core = word.strip(MARKS) or None
        return word, core, SYNONYMS.get(core, core)
    core = token_parts(token)[1]
    return plain(token), plain(core) if core else None, meaning(plain(core)) if core else None


def token_cores(text: str) -> list[str]:
    return [c for _, c, _ in map(token_words, text.split()) if c is not None]


@F.pandas_udf(T.IntegerType())
def core_counts(texts: pd.Series) -> pd.Series:
    """How many cores each text has, counted as the search numbers them."""
    return pd.Series([sum(t.isalnum() or any(map(str.isalnum, t)) for t in (x or "").split()) for x in texts], dtype="int32")


#: Pairs of alike words for each word of a cue from which on runs are found by rows of all pairs.
DENSE = 40


def longest_run(cue: list[str], window: list[str]) -> tuple[int, int]:
    """(length, place in the window) of the longest common run; a word found as it is hides its synonyms as starts."""
    return run_of_meanings(cue, window, list(map(meaning, cue)), list(map(meaning, window)))


def run_of_meanings(cue: list[str], window: list[str], of_cue: list[str], of_window: list[str]) -> tuple[int, int]:
    """`longest_run` of words whose meanings are known."""
    if not cue or not window:
        return 0, -1
    alike: dict[str, list[int]] = {}
    same: dict[str, list[int]] = {}
    wanted = set(of_cue)
    for j, (w, m) in enumerate(zip(window, of_window, strict=True)):
        if m in wanted:
            alike.setdefault(m, []).append(j)
            same.setdefault(w, []).append(j)
    met = [alike.get(m, ()) for m in of_cue]
    if sum(map(len, met)) > DENSE * len(cue):
        return _longest_dense(cue, window, of_cue, of_window)
    best, behind = (0, -1), {}
    for i in range(len(cue) - 1, -1, -1):  # from the last word on, so the first of equal runs is the last one that is found
        behind = {j: behind.get(j + 1, 0) + 1 for j in met[i]}
        if behind:
            starts = same.get(cue[i]) or met[i]
            place = max(starts, key=behind.__getitem__)
            if behind[place] >= best[0]:
                best = (behind[place], place)
    return best


def _longest_dense(cue: list[str], window: list[str], of_cue: list[str], of_window: list[str]) -> tuple[int, int]:
    """`longest_run` where many words are alike."""
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(m, len(number)) for m in ms]) for ms in (of_cue, of_window)]
    alike = ids[0][:, None] == ids[1]
    length = np.zeros((len(cue) + 1, len(window) + 1), np.int64)
    for i in range(len(cue) - 1, -1, -1):
        length[i, :-1] = np.where(alike[i], length[i + 1, 1:] + 1, 0)
    best, places = (0, -1), {}
    for j, w in enumerate(window):
        places.setdefault(w, []).append(j)
    for i in np.flatnonzero(length[:-1].max(axis=1) > 0).tolist():
        exact = places.get(cue[i])
        starts = length[i, exact] if exact else length[i, :-1]
        k = int(starts.argmax())
        if starts[k] > best[0]:
            best = (int(starts[k]), exact[k] if exact else k)
    return best


#: Characters of the longest words whose common subsequences are counted in the bits of one number.
BITS = 64
#: Pairs of words that are bounded at once.
PAIRS = 1 << 18


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of words one after another, and the length of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, words), np.int64, len(words))


def _most_alike(words: list[str], others: list[str]) -> np.ndarray:
    """Bounds of the ratio of each word (row) with each of the others: what matches is a common subsequence of both.

    The longest common subsequences of all pairs are found at once, a place of the others at a time, by one number a pair
    whose bits stand for the characters of the word. Of words too long for that only the lengths count.
    """
    (text, sizes), (other, lengths) = _coded(words), _coded(others)
    shared = np.minimum(sizes[:, None], lengths)
    fit, order = np.flatnonzero(sizes <= BITS), np.argsort(-lengths, kind="stable")
    letters, places = np.unique(text, return_inverse=True)
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    held = np.zeros((len(letters) + 1, len(words)), np.uint64)  # the last row is of letters that no word has
    short = at < BITS
    np.bitwise_or.at(held, (places[short], row[short]), np.uint64(1) << at[short].astype(np.uint64))
    held = held[:, fit]
    found = np.minimum(np.searchsorted(letters, other), max(len(letters) - 1, 0))
    code = np.where(letters[found] == other, found, len(letters)) if len(letters) else np.zeros(len(other), np.int64)
    first, left = (np.cumsum(lengths) - lengths)[order], lengths[order]
    open_ = np.full((len(others), len(fit)), ~np.uint64(0))
    for p in range(int(left[0]) if len(left) and len(fit) else 0):
        k = int(np.searchsorted(-left, -p, "left"))
        v = open_[:k]
        u = v & held[code[first[:k] + p]]
        open_[:k] = (v + u) | (v - u)
    ones = np.where(sizes[fit] == BITS, ~np.uint64(0), (np.uint64(1) << np.minimum(sizes[fit], BITS - 1).astype(np.uint64)) - np.uint64(1))
    common = np.empty((len(fit), len(others)), np.int64)
    common[:, order] = np.bitwise_count(~open_ & ones).T
    shared[fit] = common
    total = sizes[:, None] + lengths
    return np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)


def best_matches(words: list[str], candidates: list[str], least: float = 0.0) -> list[tuple[str, float]]:
    """For each word the first of the candidates most like it, and how much; ("", 0.0) if nothing is alike or reaches `least`.

    The ratio is only worked out where a bound leaves room for it, the highest bounds first.
    """
    first: dict[str, int] = {}
    for i, c in enumerate(candidates):
        first.setdefault(plain(c), i)
    others, at = list(first), list(first.values())
    found: dict[str, tuple[str, float]] = {}
    own = list(dict.fromkeys(map(plain, words)))
    step = max(1, PAIRS // max(1, len(others)))
    for k in range(0, len(own) if others else 0, step):
        some = own[k : k + step]
        every = _most_alike(some, others)
        top = every.argmax(axis=1).tolist()
        for word, bounds, c in zip(some, every, top, strict=True):
            best, score = -1, 0.0
            if bounds[c] >= max(least, 1e-9):
                s = word_ratio(word, others[c])
                if s >= least and s > 0.0:
                    best, score = c, s
                if s < bounds[c]:  # others may be as much alike, the highest bounds first
                    worth = np.flatnonzero(bounds >= max(least, score, 1e-9))
                    worth = worth[np.argsort(-bounds[worth], kind="stable")]
                    for c, most in zip(worth.tolist(), bounds[worth].tolist(), strict=True):
                        if most < score:
                            break
                        if most > score or c < best:
                            s = word_ratio(word, others[c])
                            if s >= least and (s > score or s == score > 0.0 and c < best):
                                best, score = c, s
            found[word] = (candidates[at[best]], score) if best >= 0 else ("", 0.0)
    return [found.get(plain(w), ("", 0.0)) for w in words]


def in_style(word: str, style: str) -> str:
    if style.isupper():
        return word.upper()
    if style.islower():
        return word.lower()
    if style.istitle():
        return word.title()
    return word


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(clean(x), clean(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STRING, DOUBLE, INT = T.StringType(), T.DoubleType(), T.IntegerType()
SCORES = _struct(jaccard=DOUBLE, seq=DOUBLE, run=INT, run_start=INT, cue_cores=INT, window_cores=INT)


@F.pandas_udf(SCORES)
def text_scores(cue: pd.Series, window: pd.Series) -> pd.DataFrame:
    """What a cue's text has in common with that of a window of segments."""
    pairs = [(c or "", w or "") for c, w in zip(cue, window, strict=True)]
    words = {x: ({plain(y) for y in x.split()}, token_cores(x), clean(x)) for x in {y for pair in pairs for y in pair}}
    seq = ratios((words[c][2], words[w][2]) for c, w in pairs)
    found: dict[tuple[str, str], tuple] = {}
    for pair in pairs:
        if pair not in found:
            (a, cc, ca), (b, wc, cb) = (words[x] for x in pair)
            found[pair] = (len(a & b) / len(a | b) if a and b else 0.0, seq[ca, cb], *longest_run(cc, wc), len(cc), len(wc))
    return pd.DataFrame([found[x] for x in pairs], columns=SCORES.names)


@F.pandas_udf(T.ArrayType(_struct(word=STRING, score=DOUBLE)))
def fuzzy_best(words: pd.Series, candidates: pd.Series) -> pd.Series:
    """`best_matches` of the words of each row among its candidates."""
    listed = lambda x: [w or "" for w in x] if x is not None else []
    return pd.Series([[{"word": w, "score": s} for w, s in best_matches(listed(ws), listed(cs))] for ws, cs in zip(words, candidates, strict=True)], dtype=object)


REPLACEMENT = _struct(**{"from": STRING, "to": STRING, "reason": STRING, "score": DOUBLE})
CORRECTED = _struct(text=STRING, overlap=DOUBLE, conservative=T.BooleanType(), replacements=T.ArrayType(REPLACEMENT), kept=T.ArrayType(STRING))


def correct_words(cue: str, transcript: str) -> tuple[str, float, bool, list[dict], list[str]]:
    """A cue's words after its transcript: alike words stay, near ones are mended, others follow the transcript in order."""
    said = [c for c in (token_parts(t)[1] for t in transcript.split()) if c]
    if not cue:
        return transcript, 1.0, False, [], []
    a, b = ({plain(c) for c in cs if c} for cs in ([token_parts(t)[1] for t in cue.split()], said))
    shared = len(a & b) / len(a | b) if a and b else 0.0
    careful = shared < LOW_OVERLAP
    meanings = {meaning(s) for s in said}
    out, changes, kept, nth = [], [], [], 0
    split = [token_parts(t) for t in cue.split()]
    asked = list(dict.fromkeys(core for _, core, _ in split if core and (careful or meaning(core) not in meanings)))
    nearest = dict(zip(asked, best_matches(asked, said, CAREFUL_TYPO if careful else TYPO), strict=True))

    def put(core: str, new: str, reason: str, score: float) -> str:
        new = in_style(new, core)
        changes.append({"from": core, "to": new, "reason": reason, "score": score})
        return new

    for token, (lead, core, trail) in zip(cue.split(), split, strict=True):
        if not core or careful:
            word = core
            near = nearest[core] if core and said else ("", 0.0)
            if core and near[1] >= CAREFUL_TYPO:
                word = put(core, near[0], "fuzzy-conservative", near[1])
            elif not core or said:
                kept.append(core or token)
            nth = min(nth + 1, len(said))
            out.append(lead + word + trail)
            continue
        near = ("", 1.0) if meaning(core) in meanings else nearest[core]
        if near[1] >= SAME_MEANING or not said:
            if said:
                kept.append(core)
        elif near[1] >= TYPO:
            core = put(core, near[0], "fuzzy", near[1])
        elif nth < len(said):
            core = put(core, said[nth], "sequential-fallback", 0.0)
            nth += 1
        else:
            kept.append(core)
        out.append(lead + core + trail)
    return " ".join(out).strip() or transcript, shared, careful, changes, kept


@F.pandas_udf(CORRECTED)
def corrected(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for cue, transcript in batches:
        yield pd.DataFrame([correct_words(c or "", t or "") for c, t in zip(cue, transcript, strict=True)], columns=["text", "overlap", "conservative", "replacements", "kept"])
