"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence, the
sentence probabilities are combined by noisy-or, and the weights are fitted to
document labels alone; the fitted model then points at the offending sentences.

A noisy-or over thousands of clean sentences, each with a little probability,
would call any long text toxic. So a sentence below FLOOR has no part in it,
and what a document has without any such sentence is a leak term of its own.

Edge cases: a null or empty text has no sentence and scores the leak; with no
label of both classes to learn from, every score is half the share of positive
labels (0 without labels); repeated rows are scored independently; several
labels of a document count as the greatest, several texts of an id as the least.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
EDGE = ".,;:!?…#*$%&|<>()[]{}\"'«»"
PREFIXES = (3, 4, 5, 6, 7)
#: Log-odds under which a sentence is clean: a probability of 0.1.
FLOOR = float(np.log(0.1 / 0.9))


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s and not s.isspace()]


def words(sentence: str) -> set[str]:
    """Distinct lower-cased words without marks at their edges."""
    return {w for x in sentence.lower().split() if (w := x.strip(EDGE))}


def features(word: str) -> list[int]:
    """Hashes of the word itself and of its leading characters, which carry over to inflected forms."""
    digest = xxhash.xxh64_intdigest
    return [digest(f"={word}"), *(digest(word[:n]) for n in PREFIXES if len(word) >= n)]


def mass(z: np.ndarray) -> np.ndarray:
    """What sentences of log-odds z add to -log(1 - p) of their document."""
    return np.maximum(0.0, np.logaddexp(0, z) - np.logaddexp(0, FLOOR))


@dataclass
class Model:
    bias: float
    weights: dict[int, float]  #: by a feature's hash
    leak: float = 0.0  #: -log(1 - p) of a document of clean sentences

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def scorer(self):
        """A function text -> (document probability, sentence list, sentence probabilities)."""
        cache: dict[str, float] = {}

        def value(word: str) -> float:
            got = cache.get(word)
            if got is None:
                if len(cache) > 200_000:
                    cache.clear()
                got = cache[word] = self.word(word)
            return got

        def score(text: str) -> tuple[float, list[str], np.ndarray]:
            parts = sentences(text)
            z = np.array([self.bias + sum(map(value, words(s))) for s in parts])
            return float(-np.expm1(-self.leak - mass(z).sum())), parts, 1 / (1 + np.exp(-np.clip(z, -60, 60)))

        return score


def fit(rows: list[tuple[str, int]], epochs: int = 120, least: int = 3, evidence: float = 6.0, ridge: float = 0.02) -> Model:
    """Fit to (text, 0/1) pairs by gradient ascent on the noisy-or likelihood.

    `least` documents must hold a feature, and its log-likelihood ratio against
    the label must reach `evidence`; copies of a text count once. The first two
    thirds of the epochs run without FLOOR, so that every sentence is moved.
    """
    rows = sorted({(t, int(y)) for t, y in rows})
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.0
        return Model(-60.0, {}, float(-np.log1p(-mean / 2)))
    number: dict[str, int] = {}
    bags = [[np.fromiter((number.setdefault(w, len(number)) for w in words(s)), np.int32) for s in sentences(t)] or [np.empty(0, np.int32)] for t, _ in rows]
    of_word = np.zeros((len(number), 1 + len(PREFIXES)), np.uint64)
    for w, i in number.items():
        got = features(w)
        of_word[i, : len(got)] = got
        of_word[i, len(got) :] = got[0]
    del number
    names, column = np.unique(of_word, return_inverse=True)
    of_word = column.reshape(of_word.shape).astype(np.int32)
    del column
    n, pos = len(y), y.sum()
    held, bad = np.zeros(len(names)), np.zeros(len(names))
    for d, bag in enumerate(bags):
        own = np.unique(of_word[np.unique(np.concatenate(bag))])
        held[own] += 1
        bad[own] += y[d]
    picked = np.flatnonzero((held >= least) & (held < n))
    held, bad = held[picked], bad[picked]
    # log-likelihood ratio of each feature's presence against the label
    grid = np.stack([bad, held - bad, pos - bad, n - held - pos + bad])
    means = np.stack([held * pos, held * (n - pos), (n - held) * pos, (n - held) * (n - pos)]) / n
    told = 2 * (grid * np.log(np.where(grid > 0, grid, 1) / np.where(grid > 0, means, 1))).sum(0) >= evidence
    picked, held, bad = picked[told], held[told], bad[told]
    start = np.clip(np.log((bad + 0.5) / (pos + 1)) - np.log((held - bad + 0.5) / (n - pos + 1)), -1, 3)
    new = np.full(len(names), -1, np.int32)
    new[picked] = np.arange(len(picked))
    of_word = new[of_word]
    of_word[:, 1:][of_word[:, 1:] == of_word[:, :1]] = -1  # short words have no prefix in these places
    names = names[picked].tolist()
    at_parts, of_parts, doc = [], [], []
    s = 0
    for d, bag in enumerate(bags):
        for sentence in bag:
            hit = of_word[sentence].ravel()
            hit = hit[hit >= 0]
            at_parts.append(hit)
            of_parts.append(np.full(len(hit), s, np.int32))
            doc.append(d)
            s += 1
    at, of, doc = np.concatenate(at_parts), np.concatenate(of_parts), np.array(doc, np.int32)
    w, b, leak = 0.3 * np.array(start, float), -4.0, 0.0
    gw, gb = np.full(len(w), 1e-6), 1e-6
    for epoch in range(epochs):
        z = b + np.bincount(of, w[at], minlength=s) if len(w) else np.full(s, b)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        whole = 3 * epoch < 2 * epochs
        part = np.logaddexp(0, z) if whole else mass(z)
        none = np.exp(-leak - np.bincount(doc, part, minlength=n))
        some = np.maximum(1 - none, 1e-9)
        pull = np.where(y > 0, none / some, -1.0)
        g = pull[doc] * (p if whole else np.where(z > FLOOR, p, 0.0))
        dw, db = np.bincount(at, g[of], minlength=len(w)) - ridge * w, g.sum()
        gw += dw * dw
        gb += db * db
        w, b = w + 0.5 * dw / np.sqrt(gw), b + 0.5 * db / np.sqrt(gb)
        if not whole:  # the share of toxic documents among those without a sentence above the floor
            clean = np.bincount(doc, part, minlength=n) == 0
            leak = float(-np.log1p(-(y[clean].sum() + 0.1) / (clean.sum() + 10)))
    return Model(float(b), {f: float(x) for f, x in zip(names, w, strict=True)}, leak)


def labelled(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = 4000, chars: int = 65_536) -> list[tuple[str, int]]:
    """At most `rows` labelled documents of at most `chars` characters each, in the order of a hash of the id.

    The labels are cut to the bound before they meet the documents, so the join
    broadcasts no more than `rows` pairs; of several texts of an id, the least
    is taken before they are collected.
    """
    picked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(allowed)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        .select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    )
    found = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(picked), "doc_id")
    return [(r.text, r.label) for r in found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label").collect()]


def score(docs: DataFrame, model: Model, key: str = "doc_id", alarm: float = 0.5) -> DataFrame:
    """(key, score, offending): offending lists the sentences whose own probability reaches `alarm`."""
    kind = docs.schema[key].dataType.simpleString()
    arrow = pa.struct([("sentence", pa.string()), ("p", pa.float64())])

    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        run = state.get("run") or state.setdefault("run", model.scorer())
        got = [run(t) for t in texts(batch)]
        bad = [[{"sentence": s, "p": float(p)} for s, p in zip(parts, ps, strict=False) if p >= alarm] for _, parts, ps in got]
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array([x[0] for x in got], pa.float64()), pa.array(bad, pa.list_(arrow))], ["key", "score", "offending"])

    return map_batches(docs.select(key, "text"), work, f"key {kind}, score double, offending array<struct<sentence string, p double>>").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score stays below `limit`."""
    schema = docs.schema
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        run = state.get("run") or state.setdefault("run", model.scorer())
        return batch.filter(pa.array([run(t)[0] < limit for t in texts(batch)], pa.bool_()))

    return map_batches(docs, work, schema)
