"""The pipeline's near-dedup against all pairs of a whole table, and the dealing of fingerprints."""

from collections import Counter

from sedimenta.llm import simhash

DATA = "/root/testdata/sf0.01"


def all_pairs(texts, least=0.8):
    """Every pair of similarity `least` or more, by shared shingles."""
    held = {i: simhash.shingles(t or "") for i, t in texts}
    where = {}
    for i, x in held.items():
        for g in x:
            where.setdefault(g, []).append(i)
    shared = Counter()
    for ids in where.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    out = [(a, b) for (a, b), n in shared.items() if n >= least * (len(held[a]) + len(held[b]) - n)]
    empty = [i for i, x in held.items() if not x]
    return out + [(a, b) for k, a in enumerate(empty) for b in empty[k + 1 :]]


def test_recall_of_links(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    links = all_pairs([(r.doc_id, r.text) for r in docs.collect()])
    together = [got[a] == got[b] for a, b in links]
    assert len(links) >= 100 and sum(together) >= 0.95 * len(links)
    parent = {i: i for i in got}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert all(find(i) == find(got[i]) for i in got)  # nothing else is joined


def test_leading_bits_follow_the_count():
    assert simhash.leading(1000) == simhash.LEAD
    for n in (10**7, 10**9, 10**11):
        bits = simhash.leading(n)
        assert simhash.LEAD < bits <= 32 and n * (1 + bits + bits * (bits - 1) / 2) / 2**bits <= simhash.LOAD


def test_more_leading_bits_tell_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: r.component_id for r in simhash.groups(docs).collect()}
    monkeypatch.setattr(simhash, "LOAD", 10)
    assert simhash.leading(1000) > 11
    assert {r.doc_id: r.component_id for r in simhash.groups(docs).collect()} == want
