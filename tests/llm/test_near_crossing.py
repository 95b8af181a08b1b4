"""Pairs of the near-dedup that meet between groups: judged where they meet, and connected by one task."""

import random

from pyspark.sql import functions as F

from sedimenta.llm import graph, simhash


def copies(n=120, words=150):
    """Remote copies of one text: most pairs are alike, but under 0.8."""
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for i in draw.sample(range(words), 1 + k % 3):
            own[i] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_pairs_are_told_apart_where_they_meet(spark):
    texts = copies()
    prints = simhash._near_prints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5)
    # all under one fingerprint and each of a group of its own
    held = prints.select(F.col("doc_id").alias("node"), "n", "sketch", F.lit(77).cast("long").alias("fp"), F.xxhash64("doc_id").alias("root"))
    got = {tuple(sorted(r)) for r in simhash.links(held, least=0.8).collect()}
    alike = {(a, b): simhash.similarity(texts[a], texts[b]) for a in range(len(texts)) for b in range(a + 1, len(texts))}
    assert {p for p, x in alike.items() if x >= 0.8} <= got
    assert sum(0.65 <= x < 0.72 for x in alike.values()) > 0.2 * len(alike)  # the minima's bits leave many of those
    assert sum(alike[p] < 0.72 for p in got) < 0.02 * len(alike)


def test_one_task_connects_what_stars_do(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(500), draw.randrange(500)) for _ in range(350)]
    for kind in ("long", "string"):
        df = spark.createDataFrame(edges, "u long, v long").select(F.col("u").cast(kind), F.col("v").cast(kind))
        want = {(r.node, r.root) for r in graph.components(df).collect()}
        assert {(r.node, r.root) for r in graph.components(df, at_once=1000).collect()} == want
    assert graph.components(df.limit(0), at_once=1000).count() == 0
