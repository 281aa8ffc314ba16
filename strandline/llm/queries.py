"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, lm, minhash, mixing, pii, quality, rules, shards, simhash, toxicity
from strandline.llm._common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), evenness=0.5, max_repeats=2.0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the shards that it writes to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    encode, width, free = bpe.id_bytes(docs, vocabulary())
    return shards.write_shards(docs, f"{shared_dir(spark)}/strandline/shards-{uuid.uuid4().hex}", 20260101, encode=encode, free=free, width=width)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judge(table(spark, sf_dir, "documents")).select(*columns, "failures", "policy")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_personal_data": op3_personal_data,
    "op4_simhash_near_duplicates": op4_simhash_near_duplicates,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_minhash_fingerprints": op6_minhash_fingerprints,
    "op7_training_order": op7_training_order,
    "op8_lm_score": op8_lm_score,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
}

_WORD = r"[^\x20\x09-\x0D]"
#: Only the rules can be said in SQL. The others hash, learn or iterate; tests/llm compares them with plain Python.
ORACLES: dict[str, str] = {
    "op9_quality_rules": f"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws FROM documents),
windows AS (SELECT row, i, ws[i : i + 2] AS win FROM (SELECT row, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
repeated AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, win) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS o(k) GROUP BY row),
lines AS (SELECT row, len(l) AS n, len(l) - len(list_distinct(l)) AS dup FROM (SELECT row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM w)),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(dup AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, l.n AS n_lines, len(regexp_extract_all(t, '!')) AS n_bangs
    FROM w JOIN lines l USING (row) LEFT JOIN covered c USING (row)),
f AS (SELECT *, {" + ".join(f"CASE WHEN {sql} THEN {rules.bit(name)} ELSE 0 END" for name, sql in rules.RULES.items())} AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {rules.mask("base-1")} <> 0 AS base_failed,
       failures & {rules.mask("web-1")} = 0 AS kept, CAST(failures AS INTEGER) AS failures, 'web-1' AS policy FROM f""",
}
