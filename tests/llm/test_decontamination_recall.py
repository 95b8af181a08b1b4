"""Decontamination against alignment of every item with every text, and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import decontaminate, queries

DATA = "/root/testdata/sf0.001"


def every_alignment(docs, items, least=0.45):
    """(doc, item, score) by Smith-Waterman of all items at once, a word of the text at a time."""
    number: dict[str, int] = {}
    coded = [[number.setdefault(w, len(number)) for w in decontaminate.words(t or "")] for _, t in items]
    width = max(map(len, coded))
    table = np.array([c + [-2] * (width - len(c)) for c in coded])
    steps = np.arange(width + 1)
    out = {}
    for i, t in docs:
        before, best = np.zeros((len(items), width + 1), np.int64), np.zeros(len(items), np.int64)
        for x in (number.get(w, -1) for w in decontaminate.words(t or "")):
            now = np.zeros_like(before)
            now[:, 1:] = np.maximum(before[:, :-1] + np.where(table == x, 2, -1), np.maximum(before[:, 1:] - 1, 0))
            before = np.maximum.accumulate(now + steps, axis=1) - steps
            best = np.maximum(best, before.max(axis=1))
        out |= {(i, items[k][0]): best[k] / (2 * len(c)) for k, c in enumerate(coded) if c and best[k] >= least * 2 * len(c)}
    return out


def test_recall_of_seeds(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    draw = np.random.default_rng(4)
    for k in range(20):  # edited copies: two words in ten changed, one left out
        words = items[k][1].split()
        edited = [f"x{j}" if draw.random() < 0.2 else w for j, w in enumerate(words)]
        del edited[len(edited) // 2]
        docs.append((10_000 + k, "Some words before it. " + " ".join(edited) + " Some words behind it."))
    want = every_alignment(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench).collect()}
    assert len(want) >= 15
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[p] == pytest.approx(want[p]) for p in got)
    clean = {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in got}


def test_whole_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontaminate(spark, DATA).collect()}
    want = set(every_alignment(docs, items))
    assert got <= want and len(got) >= 0.95 * len(want)


def test_odd_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [("a", f"x {item} y", 1), ("a", f"x {item} y", 1), (None, item, 2), ("b", None, 3), ("c", "", 4), ("d", "word " * 200_000 + item, 5), ("e", "plain", 6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, a int").withColumn("b", F.lit(1)).withColumn("item_id", F.lit("z"))
    bench = spark.createDataFrame([("i1", item), ("i1", item), ("i2", None), ("i3", "")], "item_id string, text string")
    got = sorted((r.doc_id or "", r.item_id, r.score) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == sorted([("", "i1", 1.0)] * 2 + [("a", "i1", 1.0)] * 4 + [("d", "i1", 1.0)] * 2)
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == ["b", "c", "e"]
    assert decontaminate.keep_clean(docs.limit(0), bench).count() == decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows)
