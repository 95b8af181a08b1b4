"""LM scores with several blocks of pairs: the same in any number of rounds, and in bounded room."""

import os

from pyspark.sql import functions as F

from sedimenta.llm import common, lmscore, queries

DATA = "/root/testdata/sf0.01"


def held(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_rounds_agree_and_leave_room(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.union(docs.limit(3))  # repeated rows are scored each
    out = queries.remainder("doc_id", 5) == 1
    one = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in lmscore.score(docs, ~out).collect())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    folder = common.shared_folder(spark).removeprefix("file:")
    before, most = held(folder), []

    def watched(df, real=common.staged):
        got = real(df)
        most.append(held(folder) - before)
        return got

    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 200_000)
    monkeypatch.setattr(lmscore, "ROUND_BYTES", size // 6, raising=False)
    monkeypatch.setattr(lmscore, "staged", watched)
    many = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in lmscore.score(docs, ~out).collect())
    assert max(most) < 3 * size, max(most) / size
    assert many == one
