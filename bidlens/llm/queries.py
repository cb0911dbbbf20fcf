"""One query per operator over the whole driver tables, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bidlens.llm import (
    conversation_repair, decontaminate, jaccard_join, licenses, line_dedup, merkle, packing, pii, quality_ordinal, rule_lists, token_counts, token_files, toxicity,
)
from bidlens.llm.common import table
from bidlens.llm.sql import OP12_SQL, OP13_SQL
from bidlens.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ordinal.graded_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_lists.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, VOCABULARY)
    return token_files.read_back(spark, path)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversations, conversation_repair.damaged(conversations))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.without_newlines(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_personal_data": op3_personal_data,
    "op4_toxicity": op4_toxicity,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_files": op11_token_files,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# Shingles, links by counted overlaps, and the smallest id that links reach.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS set_
  FROM w
), t AS MATERIALIZED (SELECT doc_id, len(set_) AS n, unnest(set_) AS tok FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)
  UNION ALL SELECT b, a FROM p WHERE 100 * shared >= 75 * (na + nb - shared)
), r AS (
  SELECT a AS node, a AS reached FROM (SELECT DISTINCT a FROM e)
  UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.set_) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.doc_id = c.node
"""

ORACLE: dict[str, str] = {
    "op6_ngram_jaccard_join": OP6_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
