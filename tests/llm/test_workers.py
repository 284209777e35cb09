"""What Python workers keep and how often they encode: chunks of many documents' edits at once, words of any number of ids, no other operator's cache."""

import pyarrow as pa
import public_tokenizers
import pytest

from cuelattice.llm import bpe, common, packing, toxicity
from cuelattice.llm.token_counts import TokenTree


@pytest.fixture(scope="module")
def tables():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.compiled(f.read())


def test_edits_of_many_texts_are_encoded_together(tables, monkeypatch):
    texts = [f"Text number {i} has wordsof{i} its own, and a few more.\n" * (1 + 40 * (i % 3)) for i in range(20)]
    one, many = bpe.ByteBpe(*tables, False), bpe.ByteBpe(*tables, False)
    expected = []
    for i, x in enumerate(texts):
        tree = TokenTree(one, x)
        tree.edit(i, i + 9, f" new{i}words, ")
        expected.append((tree.n_tokens, tree.text, tree.reencoded, tree.leaves()[1].tolist()))
    trees = [TokenTree(many, x) for x in texts]
    read = [tree.read(i, i + 9, f" new{i}words, ") for i, tree in enumerate(trees)]
    many.learn(set().union(*(x[2] for x in read)))
    monkeypatch.setattr(many, "learn", lambda parts: pytest.fail("encoded again"))
    for tree, x in zip(trees, read, strict=True):
        tree.count(*x)
    assert [(t.n_tokens, t.text, t.reencoded, t.leaves()[1].tolist()) for t in trees] == expected
    assert expected[0][0] == sum(len(x) // 4 for x in one.encode([expected[0][1]]))


def test_words_of_few_and_many_ids():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = packing.WordTokens(f.read())
    text = "plain WORDS " + "zq9" * 60 + " plain"
    ids = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.encode([text.encode(), b""]) == [b"".join(i.to_bytes(4, "little") for i in ids), b""]
    assert max(len(x) for x in words.known.values()) > 4 * len(packing.PACKS)


def test_features_let_go_of_what_other_operators_keep():
    cleared = []
    common.sole_cache("packing", lambda: cleared.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "toxic": pa.array([1], pa.int32()), "t": [b"some text"]})
    assert len(list(toxicity.sample_features(iter([batch])))) == 1
    assert cleared == [1]
