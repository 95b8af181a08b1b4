"""Queries over the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, linededup, lmscore, quality, simhash, suffix, toxicity, warc
from .common import remainder, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), cleaned=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_removed")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=False)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 5) == 1
    scored = lmscore.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_text(pages, html_extract.train(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_lm_score": op6_lm_score,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_html": op10_html,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest""",
    "op3_line_dedup": """
WITH pages AS (SELECT doc_id, text, coalesce('=' || source, '') AS site, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT site, count(*) AS n FROM pages GROUP BY site),
held AS (SELECT site, line, count(*) AS n FROM (SELECT site, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM pages) GROUP BY site, line),
bad AS (SELECT held.site, list(line) AS bad FROM held JOIN totals ON held.site = totals.site WHERE held.n >= 3 AND held.n > 0.05 * totals.n GROUP BY held.site),
j AS (SELECT doc_id, text, lines, coalesce(bad, []) AS bad FROM pages LEFT JOIN bad ON pages.site = bad.site)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(bad, trim(x))), chr(10)) END AS text,
  CAST(coalesce(len(list_filter(lines, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(list_filter(lines, lambda x: trim(x) <> '' AND list_contains(bad, trim(x)))), 0) AS BIGINT) AS n_removed
FROM j""",
}
