"""Byte-pair encoding by a tokenization automaton.

The automaton accepts exactly the token sequences that the merges produce. It is built by successive merge gadgets: at
first one state follows every byte and any byte may come next. The gadget of a merge (u, v) -> w adds arcs labelled w
wherever arcs labelled u are, into a state with the arcs of the state behind v, all as they are at that moment; then
it takes the arc v behind u away. Tokens with the same arcs behind them share a state, tokens that label arcs of the
same states share a column, and what is left is a table of bits: state by column.

A pre-split word is encoded by a walk over its bytes. At each place the tokens that start there (by a trie) take the
arcs that the state of that place has. Every beginning of a word has just one path, so each place is entered once and
nothing is ever tried again; the path is read off from the end. Many words walk at a time. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, sole_cache

#: The byte-level pattern that splits text ahead of the merges (fixed values of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Chunks that a worker keeps the ids of; beyond, the table starts anew.
CACHE_CHUNKS = 600_000
#: Bytes of the longest words that walk together; longer ones walk alone.
TOGETHER = 64
#: Words from which walking together is faster.
FEW = 50


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Automaton:
    labels: list[bytes]  # of each token
    state: np.ndarray  # token -> the state behind its arcs
    column: np.ndarray  # token -> its column in the table
    arcs: np.ndarray  # state x column, as packed bits: whether the state has such an arc
    keys: np.ndarray  # edges of the trie of tokens: node << 8 | byte, sorted
    child: np.ndarray  # the nodes they lead to
    token: np.ndarray  # node -> the token that it spells, or -1

    def __post_init__(self):
        self.sizes = np.fromiter(map(len, self.labels), np.int64, len(self.labels))
        self.width = self.arcs.shape[1]
        self.trie: dict[int, int] = {}

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found: list[bytes] = [b""] * len(words)
        most = TOGETHER if len(words) >= FEW else 0
        for i in np.flatnonzero(lengths > most).tolist():
            found[i] = self._alone(words[i])
        order = np.argsort(-lengths, kind="stable")
        order = order[(lengths[order] <= most) & (lengths[order] > 0)]
        if len(order):
            for i, ids in zip(order.tolist(), self._together([words[i] for i in order.tolist()], lengths[order]), strict=True):
                found[i] = ids
        return found

    def _together(self, words: list[bytes], lengths: np.ndarray) -> Iterator[bytes]:
        """Words come longest first. last: at each place of each word the token whose arc was taken to it."""
        buffer, start = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(lengths) - lengths
        place = start + np.arange(len(words))
        last = np.full(len(buffer) + len(words), -1, np.int32)
        bits = self.arcs.ravel()
        for p in range(int(lengths[0])):
            who = np.arange(int(np.searchsorted(-lengths, -p, "left")))
            row = self.state[last[place[who] + p]] * self.width
            node, size = np.zeros(len(who), np.int64), 0
            while len(who):
                key = node << 8 | buffer[start[who] + p + size]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                is_edge = self.keys[at] == key
                who, node, size = who[is_edge], self.child[at[is_edge]], size + 1
                spelled = self.token[node]
                good = spelled >= 0
                w, t = who[good], spelled[good]
                if p:
                    c = self.column[t]
                    taken = bits[row[w] + (c >> 3)] >> (c & 7) & 1 == 1
                    w, t = w[taken], t[taken]
                last[place[w] + p + size] = t
                more = lengths[who] > p + size
                who, node = who[more], node[more]
        left, who, path = lengths.copy(), np.arange(len(words)), []
        while len(who):
            t = last[place[who] + left[who]]
            path.append((who, t))
            left[who] -= self.sizes[t]
            who = who[left[who] > 0]
        of, ids = (np.concatenate([x[k] for x in reversed(path)]) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        whole, ends = ids[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(of))).tolist()
        return (whole[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def _alone(self, word: bytes) -> bytes:
        if not self.trie:
            self.trie = dict(zip(self.keys.tolist(), self.child.tolist(), strict=True))
        trie, token, n = self.trie, self.token, len(word)
        last = [-1] * (n + 1)
        for p in range(n):
            row, node = self.arcs[self.state[last[p]]], 0
            for q in range(p, n):
                node = trie.get(node << 8 | word[q], -1)
                if node < 0:
                    break
                t = int(token[node])
                if t >= 0:
                    c = int(self.column[t])
                    if not p or row[c >> 3] >> (c & 7) & 1:
                        last[q + 1] = t
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= len(self.labels[last[at]])
        return np.array(ids[::-1], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _classes(merges: list[tuple[int, int, int]], own: int, other: int, tokens: int, born: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each token, earliest token of each class): tokens that get equal columns (own 0, other 1) or rows (own 1, other 0).

    A token copies the column of its left part, or the row of its right part. Of tokens that no later gadget changes,
    those are equal that were copied from one token between two of its changes.
    """
    changes, changed = defaultdict(list), {m[other] for m in merges}
    for time, m in enumerate(merges):
        changes[m[other]].append(time)
    names: dict[tuple[int, int], int] = {}
    of, first = np.zeros(tokens, np.int64), []
    parts = {m[2]: m[own] for m in merges}
    for t in np.argsort(born, kind="stable").tolist():
        name = (t, -1) if t in changed or t not in parts else (parts[t], bisect_left(changes[parts[t]], born[t]))
        if name not in names:
            names[name] = len(first)
            first.append(t)
        of[t] = names[name]
    return of, np.array(first, np.int64)


def compile_merges(labels: list[bytes], singles: list[int], merges: list[tuple[int, int, int]]) -> Automaton:
    """The automaton of merges (u, v, w) in their order; `singles` are the tokens of single bytes.

    A gadget touches one row and one column of the table. So the rows are made one after another, oldest first: what a
    row copies at its birth, then the columns copied since, by what they are copied from, less what gadgets took away.
    """
    tokens = len(labels)
    born = np.full(tokens, -1, np.int64)
    left, right = np.zeros(tokens, np.int64), np.zeros(tokens, np.int64)
    for time, (u, v, w) in enumerate(merges):
        born[w], left[w], right[w] = time, u, v
    column, c_first = _classes(merges, 0, 1, tokens, born)
    state, s_first = _classes(merges, 1, 0, tokens, born)
    taken: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # token -> column, time and result of its merges
    for time, (u, v, w) in enumerate(merges):
        taken[u].append((int(column[v]), time, w))
    n = len(c_first)
    c_born, c_left = born[c_first], column[left[c_first]]
    is_single = np.zeros(tokens, bool)
    is_single[singles] = True
    depth = np.zeros(n, np.int64)
    for c in np.argsort(c_born, kind="stable").tolist():
        if c_born[c] >= 0:
            depth[c] = depth[c_left[c]] + 1
    levels = []
    for d in range(1, int(depth.max(initial=0)) + 1):
        level = np.flatnonzero(depth == d)
        level = level[np.argsort(c_born[level], kind="stable")]
        levels.append((level, c_born[level], c_left[level]))
    arcs = np.zeros((len(s_first), -(-n // 8)), np.uint8)
    gone: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # token -> columns and times of the arcs that it lost
    entered = is_single.copy()
    for s, a in enumerate(s_first.tolist()):
        birth, row = born[a], np.zeros(n, bool)
        lost = np.full(n, -1, np.int64)
        mine = taken.get(a, [])
        if birth < 0:
            if not is_single[a]:
                continue
            row[:] = (c_born < 0) & is_single[c_first]
        else:
            source = right[a]
            row[:] = np.unpackbits(arcs[state[source]], count=n, bitorder="little")
            if source in gone:
                again = gone[source][1] >= birth
                row[gone[source][0][again]] = True
            row &= c_born < birth

        def take(some: list[tuple[int, int, int]], row: np.ndarray = row, lost: np.ndarray = lost) -> None:
            for c, time, w in some:
                if row[c]:
                    row[c], lost[c], entered[w] = False, time, True

        by_depth = defaultdict(list)
        for x in mine:
            by_depth[0 if c_born[x[0]] < birth else int(depth[x[0]])].append(x)
        take(by_depth[0])
        for d, (level, level_born, level_left) in enumerate(levels, 1):
            k = int(np.searchsorted(level_born, max(birth, 0)))
            if k < len(level):
                now = row[level_left[k:]]
                if mine:
                    now = now | (lost[level_left[k:]] > level_born[k:])
                row[level[k:]] = now
                take(by_depth[d])
        arcs[s] = np.packbits(row, bitorder="little")
        if mine:
            cs = np.flatnonzero(lost >= 0)
            gone[a] = cs, lost[cs]
    nodes, edges, spells = {b"": 0}, {}, [-1]
    for t in np.flatnonzero(entered).tolist():
        label = labels[t]
        for k in range(1, len(label) + 1):
            if label[:k] not in nodes:
                nodes[label[:k]] = len(spells)
                edges[nodes[label[: k - 1]] << 8 | label[k - 1]] = len(spells)
                spells.append(-1)
        spells[nodes[label]] = t
    keys = np.array(sorted(edges), np.int64)
    return Automaton(labels, state, column, arcs, keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(spells, np.int64))


class ByteBpe:
    """A byte-level BPE vocabulary: how text is split, and the automaton for its words."""

    def __init__(self, automaton: Automaton, added: dict[str, int], specials: bool = True):
        self.automaton = automaton
        self.specials = {k: np.array([v], "<u4").tobytes() for k, v in added.items()} if specials else {}
        self.split_specials = re.compile("|".join(f"({re.escape(x)})" for x in self.specials) or r"(?!)")
        self.words = regex.compile(PATTERN)
        self.uneven = re.compile(r"\s\s|^\s|\s\Z")
        self.chunks = dict(self.specials)

    def parts(self, text: str) -> list[str]:
        """Chunks that are encoded apart. Where every white space stands alone between words, a space opens one and a line feed is one."""
        if self.specials and any(x in text for x in self.specials):
            return [y for x in self.split_specials.split(text) if x for y in ([x] if x in self.specials else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if "\0" in text or self.uneven.search(text):
            return self.words.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """The table of chunks and their ids, which then has these."""
        new = {x for x in chunks if x not in self.chunks}
        if len(self.chunks) + len(new) > CACHE_CHUNKS:
            self.chunks = dict(self.specials)
            new = {x for x in chunks if x not in self.chunks}
        split = {x: [w.encode() for w in self.words.findall(x)] for x in new}
        words = list({w for x in split.values() for w in x})
        ids = dict(zip(words, self.automaton.encode(words), strict=True))
        for x, ws in split.items():
            self.chunks[x] = b"".join([ids[w] for w in ws])
        return self.chunks

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.parts(x) for x in texts]
        known = self.learn(set().union(*parts))
        return [b"".join(map(known.__getitem__, x)) for x in parts]

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


_COMPILED: dict[str, tuple[Automaton, dict[str, int]]] = {}
_WORKERS: dict[tuple[str, bool], ByteBpe] = {}


def compiled(description: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a vocabulary's description and its added tokens; the driver keeps the last one."""
    key = hashlib.sha256(description.encode()).hexdigest()
    if key not in _COMPILED:
        model, letters = json.loads(description), byte_letters()
        vocab = model["model"]["vocab"]
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        labels = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            labels[i] = bytes(letters[x] for x in token)
        for token, i in added.items():
            labels[i] = token.encode()
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        _COMPILED.clear()
        _COMPILED[key] = compile_merges(labels, [i for t, i in vocab.items() if len(t) == 1], [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]), added
    return _COMPILED[key]


def shared(spark: SparkSession, vocabulary: str) -> tuple[str, Broadcast]:
    """A vocabulary compiled on the driver and broadcast (its size is fixed), and a name for it."""
    with open(vocabulary, encoding="utf-8") as f:
        description = f.read()
    return hashlib.sha256(description.encode()).hexdigest(), spark.sparkContext.broadcast(compiled(description))


def in_worker(name: str, tables: Broadcast, specials: bool = True) -> ByteBpe:
    """The vocabulary in a worker process, which keeps one and the chunks it has encoded."""
    sole_cache("bpe", _WORKERS.clear)
    if (name, specials) not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[name, specials] = ByteBpe(*tables.value, specials)
    return _WORKERS[name, specials]


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256), one per input row; if asked for, also ids and decoded.

    docs has doc_id and text; other columns are ignored. `vocabulary` is the path of a byte-level tokenizer
    description on the driver. A null text counts as empty: no ids, and the digests of nothing. A null doc_id and
    repeated rows are passed through. Strings of special tokens in a text become their ids. Long texts are read whole.
    An empty table gives no rows.
    """
    name, tables = shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = in_worker(name, tables)
        for batch in pieces(batches, "text"):
            ids = bpe.encode(batch.column("text").to_pylist())
            decoded = [bpe.decode(x) for x in ids]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            }
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
            if with_text:
                out["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
