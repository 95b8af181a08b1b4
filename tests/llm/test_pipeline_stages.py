"""The pipeline's stages, each on its own input, against brute force; odd tables."""

import collections
import hashlib

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
import public_tokenizers
from sedimenta.llm import bpe, decontaminate, queries, simhash
from test_decontamination_recall import every_alignment
from test_near_recall import all_pairs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [{r.doc_id: r for r in df.collect()} for df in out]


def test_toxicity_stage(spark, stages):
    before, after = stages[0], stages[1]
    score = queries.toxicity_model(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).scorer()
    assert set(after) == {i for i, r in before.items() if score(r.text or "")[0] < 0.7}


def test_line_stage(stages):
    before, after = stages[1], stages[2]
    pages, held = collections.Counter(r.source for r in before.values()), collections.Counter()
    for r in before.values():
        held.update((r.source, line) for line in {x.strip(" ") for x in (r.text or "").split("\n")} if line)
    bad = {k for k, n in held.items() if n >= 3 and n > 0.05 * pages[k[0]]}
    assert bad and set(after) == set(before)
    for i, r in before.items():
        want = None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad)
        assert after[i].text == want and after[i].n_chars == len(want or "")


def test_near_stage(stages):
    before, after = stages[2], stages[3]
    links = all_pairs([(i, r.text) for i, r in before.items()])
    parent = {i: i for i in before}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {i for i in before if find(i) == i}
    assert want <= set(after) and len(after) <= len(want) + 0.05 * (len(before) - len(want)) + 1
    assert all(simhash.similarity(before[a].text or "", before[b].text or "") >= 0.8 for a, b in links)


def test_benchmark_stage(spark, stages):
    before, after = stages[3], stages[4]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {i for i, _ in every_alignment([(i, r.text) for i, r in before.items()], items)}
    assert set(before) - bad <= set(after) and len(set(after) & bad) <= 0.05 * len(bad)
    assert decontaminate.words("A b") == ["a", "b"]


def test_encoding_stage(stages):
    before, after = stages[4], stages[5]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(queries.RANKS)), special_tokens={})
    assert set(after) == set(before)
    for i, r in before.items():
        ids = library.encode_ordinary(r.text or "")
        assert after[i].ids == ids and after[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_on_odd_tables(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "  ", None, None, 2), (None, "no id here at all", "en", "s", 17), (5, "Two words\nTwo words", "en", "s", 19), (5, "Two words\nTwo words", "en", "s", 19), (6, "word " * 30_000, "en", "s", 150_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, node string")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 6]
    assert corpus_pipeline.STAGES[-1][1](spark, kept, DATA).count() == 4
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DATA)
    assert none.count() == 0
