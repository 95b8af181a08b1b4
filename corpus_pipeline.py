"""The training-data pipeline: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, n_chars brought
up to date where the text changed. What a stage read is deleted once the next
one is written.

Edge cases: a null or empty text is clean, has no lines and no leak; empty
texts are near copies of each other, so the one of the least id stays; rows
without an id are no one's copies and all stay; rows repeated under one id are
one document after the near-dedup; an empty table passes every stage; further
columns pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import bpe, decontaminate, linededup, simhash, toxicity
from sedimenta.llm.common import removed, shared_folder, table
from sedimenta.llm.queries import RANKS, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.7."""
    return toxicity.keep_clean(docs, toxicity_model(spark, docs, sf_dir))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its source's boilerplate lines."""
    return linededup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and digests of every document left."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_dedup", drop_copies), ("decontaminate", drop_leaks), ("byte_bpe", encode)]

#: The learned and hashed stages can't be said in SQL. Tests hold line dedup, near-dedup, decontamination and
#: encoding each against a version by brute force on the stage's own input, toxicity against the model's formula.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        before, docs = docs, spark.read.parquet(f"{top}/{name}")
        if before.inputFiles() and top in before.inputFiles()[0]:
            removed(before)
    return docs
