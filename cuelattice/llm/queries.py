"""The numbered queries and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_decode
from .common import table
from .exact_dedup import exact_dedup
from .lm import lm_scores
from .packing import pack_documents
from .prefix_trie import prefix_trie, rebuilt
from .quality import quality_verdicts
from .repair import damaged, structure_report
from .secrets import scan_secrets
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .token_counts import edited_counts, example_edits
from .token_files import token_files
from .toxicity import score_toxicity


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), example_edits())


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure_report(conversations, damaged(conversations))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_bpe_encode_decode": op2_bpe_encode_decode,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_secret_scans": op5_secret_scans,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_id_output": op11_token_id_output,
    "op12_conversation_structure_repair": op12_conversation_structure_repair,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    "op10_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        r AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS l FROM w),
        k AS (SELECT doc_id, i, md5(array_to_string(l, ' ')) AS h FROM r WHERE len(l) = 50),
        f AS (SELECT doc_id, i FROM k JOIN (SELECT h, min(doc_id) AS least FROM k GROUP BY h) USING (h) WHERE doc_id > least),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f),
        s AS (SELECT w.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL), '') AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
    """,
}
