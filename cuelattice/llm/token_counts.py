"""Token counts that follow edits: a segment tree of pre-tokens per document.

Leaves are stretches of pre-tokens with their characters and tokens; inner nodes hold the sums. An edit re-encodes from
the last leaf that starts two characters or more ahead of it, which is as far as the pattern looks past the end of a
pre-token, until a pre-token ends where an old leaf did behind the edit: from there on the text is as it was, and the
pattern keeps no memory. Only the leaves in between and the sums above them change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, in_worker, shared
from .common import pieces

#: Chunks of text (about a word each) in a new leaf.
LEAF = 64


class TokenTree:
    def __init__(self, bpe: ByteBpe, text: str, leaves: tuple[np.ndarray, np.ndarray] | None = None, parts: list[str] | None = None):
        """leaves: characters and tokens of each leaf, where they are known; parts: the chunks of the text, where they are."""
        self.bpe, self.text, self.reencoded = bpe, text, 0
        self._plant(*(leaves if leaves is not None else self._leaves(bpe.parts(text) if parts is None else parts)))

    def _tokens(self, parts: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(len, map(self.bpe.chunks.__getitem__, parts)), np.int64, len(parts)) // 4
        except KeyError:
            return np.fromiter(map(len, map(self.bpe.learn(parts).__getitem__, parts)), np.int64, len(parts)) // 4

    def _leaves(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.text:
            return np.zeros(1, np.int64), np.zeros(1, np.int64)
        sizes, first = np.fromiter(map(len, parts), np.int64, len(parts)), np.arange(0, len(parts), LEAF)
        return np.add.reduceat(sizes, first), np.add.reduceat(self._tokens(parts), first)

    def _plant(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.width = 1 << max(0, int(len(chars) - 1).bit_length())
        self.used = len(chars)
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(chars)] = np.stack([chars, tokens], axis=1)
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        part = self.sums[self.width : self.width + self.used]
        return part[:, 0].copy(), part[:, 1].copy()

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character `at`, or of the last one."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Put `replacement` in place of text[start:stop]; offsets beyond the text are drawn in."""
        self.count(*self.read(start, stop, replacement))

    def read(self, start: int, stop: int, replacement: str) -> tuple[int, int, list[str]]:
        """The first part of an edit: the leaves that it changes, from the first to the last, and the chunks that take their place."""
        n = len(self.text)
        start = max(0, min(start, n))
        stop = max(start, min(stop, n))
        first, begin = self._find(max(0, start - 2))
        if begin > max(0, start - 2):
            first, begin = 0, 0
        shift = len(replacement) - (stop - start)
        self.text = self.text[:start] + replacement + self.text[stop:]
        # Old leaf ends behind the edit, where they are now.
        last, end = self._find(stop)
        end += int(self.sums[last + self.width, 0])
        at, parts, behind = begin, [], start + len(replacement)
        for found in self.bpe.words.finditer(self.text, begin):
            while end + shift < at and last + 1 < self.used:
                last += 1
                end += int(self.sums[last + self.width, 0])
            if at == end + shift and end >= stop and at >= behind and parts:
                break
            parts.append(found.group())
            at = found.end()
        else:
            last = self.used - 1
        self.reencoded += len(parts)
        return first, last, parts

    def count(self, first: int, last: int, parts: list[str]) -> None:
        """The rest of an edit: tokens of the chunks and the sums above them. It comes ahead of any further edit."""
        sizes = np.stack([np.fromiter(map(len, parts), np.int64, len(parts)), self._tokens(parts)], axis=1)
        fresh = np.add.reduceat(sizes, np.arange(0, len(sizes), LEAF), axis=0) if len(sizes) else np.zeros((0, 2), np.int64)
        if len(fresh) <= last - first + 1:
            for k in range(first, last + 1):
                self._set(k, *(fresh[k - first].tolist() if k - first < len(fresh) else (0, 0)))
        else:  # more leaves than there were: plant anew from the sums at hand
            chars, tokens = self.leaves()
            self._plant(*(np.concatenate([x[:first], fresh[:, i], x[last + 1 :]]) for i, x in enumerate((chars, tokens))))


def edited_counts(docs: DataFrame, vocabulary: str, edits: Column, with_leaves: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, n_tokens_after, n_chars_after, n_reencoded), one per input row; if asked for, the leaves.

    docs has doc_id and text, and what `edits` needs: an array of struct<start int, stop int, replacement string> to be
    applied one after another, offsets in characters of the text so far and drawn in where they lie beyond it. A null
    text counts as empty, null edits as none; null replacements are empty. If docs has leaf_chars and leaf_tokens from
    an earlier run, they are taken over instead of counting the text again. Strings of special tokens are ordinary
    text. Null doc_ids and repeated rows are given each. An empty table gives no rows.
    """
    name, tables = shared(docs.sparkSession, vocabulary)
    known = {"leaf_chars", "leaf_tokens"} <= set(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = in_worker(name, tables, specials=False)
        for batch in pieces(batches, "text"):
            leaves = [None] * batch.num_rows
            if known:
                pairs = zip(batch.column("leaf_chars").to_pylist(), batch.column("leaf_tokens").to_pylist(), strict=True)
                leaves = [None if not a else (np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs]
            texts = batch.column("text").to_pylist()
            parts = [bpe.parts(x) if had is None else [] for x, had in zip(texts, leaves, strict=True)]
            bpe.learn(set().union(*parts))
            trees = [TokenTree(bpe, *x) for x in zip(texts, leaves, parts, strict=True)]
            before = [tree.n_tokens for tree in trees]
            # The first edits of all documents, then the second ones, and so on, so that their new chunks are encoded together.
            edits = [[x for x in changes or () if x is not None] for changes in batch.column("edits").to_pylist()]
            for k in range(max(map(len, edits))):
                read = [(tree, tree.read(x[k]["start"] or 0, x[k]["stop"] or 0, x[k]["replacement"] or "")) for tree, x in zip(trees, edits, strict=True) if k < len(x)]
                bpe.learn(set().union(*(x[2] for _, x in read)))
                for tree, x in read:
                    tree.count(*x)
            out = [(n, tree.n_tokens, len(tree.text), tree.reencoded, *(tree.leaves() if with_leaves else ())) for n, tree in zip(before, trees, strict=True)]
            columns = [batch.column("doc_id"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(4))]
            names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_reencoded"]
            if with_leaves:
                columns += [pa.array([x[i].astype(np.int32) for x in out], pa.list_(pa.int32())) for i in (4, 5)]
                names += ["leaf_chars", "leaf_tokens"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_tokens_after long, n_chars_after long, n_reencoded long" + ", leaf_chars array<int>, leaf_tokens array<int>" * with_leaves
    more = ["leaf_chars", "leaf_tokens"] if known else []
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), edits.alias("edits"), *more).mapInArrow(run, schema)


def example_edits() -> Column:
    """Three edits of each text that follow from its doc_id: words replaced, a line put in, a stretch taken out."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda k: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), n + 1).cast("int")
    change = lambda k, size, text: F.struct(at(k).alias("start"), (at(k) + size).alias("stop"), F.lit(text).alias("replacement"))
    return F.array(change(1, 12, " as amended, "), change(2, 0, "\nA new line of 6 words.\n"), change(3, 40, ""))
