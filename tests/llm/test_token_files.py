"""Token files against the tokenizers library, and their reader's views."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuelattice.llm import token_files as files
from cuelattice.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encode():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def brute(rows, encode):
    out, start = [], 0
    for doc_id, text in rows:
        ids = encode(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_the_library(spark, encode):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    df = QUERIES["op11_token_id_output"](spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, df.collect())) == brute(rows, encode)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(3)
    texts = ["", None, " \t\n", "same words", "ends with <|endoftext|> as text", "İstanbul ÇA ñandú 東京 🙂"]
    texts += [" ".join(r.choice(["river", "stone", "Xylophone", "x" * 40]) for _ in range(n)) for n in (1, 7, 63, 64, 65, 500, 20_000)]
    return [(i * 3 - 5, t) for i, t in enumerate(texts)] + [(1000, "same words")] * 9


def test_sequences_are_views_of_the_file(spark, encode, odd, tmp_path):
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "7 as t", "'x' as ids").repartition(3)
    folder = f"file://{tmp_path}/out"
    manifest = files.write_token_files(df, VOCABULARY, folder, length=64, file_bytes=20_000)
    assert len(manifest["files"]) > 1 and manifest["width"] == 2
    want = brute(odd, encode)
    assert sorted(map(tuple, files.read_documents(spark, folder).collect())) == sorted(want)
    found = files.TokenFiles(folder)
    assert len(found) == manifest["n_sequences"]
    before = pa.total_allocated_bytes()
    shown = [found[i] for i in range(len(found))]
    assert pa.total_allocated_bytes() - before < 4096  # batches of maps, no copies of ids
    for x in found.files.values():
        for ids, _ in (x[i] for i in range(len(x))):
            assert not ids.flags.owndata and not ids.flags.writeable and len(ids) == 64
    ids = np.concatenate([i[np.array(m)] for i, m in shown])
    assert ids.tolist() == [t for _, text in odd for t in encode(text)]
    assert all(not i[~np.array(m)].any() for i, m in shown)
    by_spark = {r.sequence: (r.ids, r["mask"]) for r in files.read_sequences(spark, folder).collect()}
    assert by_spark == {k: (i.tolist(), m.to_pylist()) for k, (i, m) in enumerate(shown)}
    with pytest.raises(IndexError):
        found[len(found)]


def test_what_tasks_left_is_removed_and_a_second_run_replaces_the_first(spark, odd, tmp_path):
    df = spark.createDataFrame(odd, "doc_id long, text string")
    files.write_token_files(df, VOCABULARY, str(tmp_path))
    (tmp_path / "000000-lost.ids.arrow").write_bytes(b"half")
    manifest = files.write_token_files(df, VOCABULARY, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted([files.MANIFEST, *(x[k] for x in manifest["files"] for k in ("ids", "docs"))])


def test_no_documents_null_ids_and_names_of_strings(spark, encode):
    schema = "doc_id string, text string"
    assert files.token_files(spark.createDataFrame([], schema), VOCABULARY).count() == 0
    rows = [(None, "first"), ("a", "b c"), ("b", None)]
    assert list(map(tuple, files.token_files(spark.createDataFrame(rows, schema), VOCABULARY).orderBy("start").collect())) == brute(rows, encode)


def test_a_writer_cuts_long_documents_into_batches(tmp_path):
    ids = np.arange(5000) % 60_000
    with open(tmp_path / "a.ids.arrow", "wb") as f:
        writer = files.SequenceWriter(f, 16, np.uint16, batch=4)
        for part in np.split(ids, [1, 2, 700, 704, 4100]):
            writer.add(part)
        assert writer.close() == -(-5000 // 16)
    found = files.SequenceFile(str(tmp_path), "a.ids.arrow")
    assert np.concatenate([found[i][0] for i in range(len(found))])[:5000].tolist() == ids.tolist()
    assert {b.num_rows for b in found.batches[:-1]} == {4}
