"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over the training texts finds the word n-grams that test items have,
with their places, and codes the words of texts that hold any. Their document
frequencies over all texts tell the seeds: of each item, the n-grams no more
frequent than its own `rare` quantile, so that every item keeps its rarest ones
however often it leaked. Seeds join the passages of texts to items; each joined
passage, an item's length and half as much on either side of the seed, is
aligned with its item, and the alignment's score over the best possible one
tells exact, edited and paraphrased copies.

Test items are handled in blocks of at most BLOCK_WORDS words; a block's words
and n-grams, of that bound, are broadcast, and each block is held against all
texts. Texts stand as 128 bits of their hash between the steps, so what many
rows repeat is aligned once, and rows need no id.

Edge cases: null or empty texts and items match nothing; items shorter than an
n-gram are one seed of all their words; repeated rows are reported each; an
empty benchmark leaves every text alone; ids of texts and items may be of any
type; other columns than those named are ignored or passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, map_batches, staged, texts

BLOCK_WORDS = 400_000
NGRAM = 3
WORD = re.compile(r"\w+")

MATCH, MISMATCH, GAP = 2, -1, -1


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Block:
    """Some test items, their vocabulary and their n-grams as sorted numbers."""

    def __init__(self, items: list[tuple[object, list[str]]]):
        self.items = [(i, w) for i, w in items if w]
        vocabulary: dict[str, int] = {}
        self.coded = [np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int64) for _, w in self.items]
        self.vocabulary = vocabulary
        self.base = len(vocabulary) + 1
        grams, of = [], []
        for k, c in enumerate(self.coded):
            g = self.grams(c) if len(c) >= NGRAM else np.array([self.number(c)])
            grams.append(g)
            of.append(np.stack([np.full(len(g), k), np.arange(len(g))], 1))
        self.gram = np.concatenate(grams) if grams else np.empty(0, np.int64)
        self.place = np.concatenate(of) if of else np.empty((0, 2), np.int64)
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.place = self.gram[order], self.place[order]
        self.known = np.unique(self.gram)
        self.short = {int(self.number(c)): len(c) for c in self.coded if len(c) < NGRAM}

    def number(self, coded: np.ndarray) -> int:
        out = 0
        for x in coded:
            out = out * self.base + int(x) + 1
        return out

    def grams(self, coded: np.ndarray, size: int = NGRAM) -> np.ndarray:
        """Numbers of the n-grams of a coded text; negative where a word is unknown."""
        n = len(coded) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(size):
            part = coded[j : j + n]
            out = out * self.base + part + 1
            ok &= part >= 0
        return np.where(ok, out, -1)

    def code(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def hits(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, position) of the block's n-grams in a coded text."""
        numbers, at = [], []
        for size in sorted({NGRAM, *self.short.values()}):
            g = self.grams(coded, size)
            where = np.flatnonzero(g >= 0)
            if not len(where) or not len(self.known):
                continue
            p = np.minimum(np.searchsorted(self.known, g[where]), len(self.known) - 1)
            where = where[self.known[p] == g[where]]
            numbers.append(g[where])
            at.append(where)
        return (np.concatenate(numbers), np.concatenate(at)) if numbers else (np.empty(0, np.int64), np.empty(0, np.int64))


def align(item: np.ndarray, text: np.ndarray) -> float:
    """Smith-Waterman score of two coded word sequences over that of a whole copy."""
    if not len(item) or not len(text):
        return 0.0
    previous = np.zeros(len(item) + 1, np.int64)
    steps = np.arange(len(item) + 1) * -GAP
    best = 0
    for x in text:
        now = np.zeros(len(item) + 1, np.int64)
        now[1:] = np.maximum(previous[:-1] + np.where(item == x, MATCH, MISMATCH), np.maximum(previous[1:] + GAP, 0))
        now = np.maximum.accumulate(now + steps) - steps  # gaps along the item, all at once
        best = max(best, int(now.max()))
        previous = now
    return best / (MATCH * len(item))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """The test items, a bounded number of words at a time."""
    out, held = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator():
        w = words(row.text)
        if out and held + len(w) > BLOCK_WORDS:
            yield out
            out, held = [], 0
        out.append((row.item_id, w))
        held += len(w)
    if out:
        yield out


def _digest() -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b")


def _passages(docs: DataFrame, block: Broadcast) -> DataFrame:
    """(a, b, grams, places, coded) of each row of docs that holds an n-gram of the block; coded are its words' numbers."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, t in enumerate(texts(batch)):
            coded = block.value.code(t)
            numbers, at = block.value.hits(coded)
            if len(numbers):
                rows.append((i, numbers, at, coded.astype(np.int32).tobytes()))
        if not rows:
            return None
        keys = batch.select(["a", "b"]).take(pa.array([r[0] for r in rows]))
        lists = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([*keys.columns, *lists, pa.array([r[3] for r in rows], pa.binary())], ["a", "b", "grams", "places", "coded"])

    return map_batches(docs.select(*_digest(), "text"), work, "a long, b long, grams array<long>, places array<long>, coded binary", 300)


def _seeds(held: DataFrame, block: Block, rare: float) -> DataFrame:
    """(gram, item, offset) of the block's seeds, by document frequency over all texts."""
    # one number for each n-gram of the block, itself of bounded size
    frequency = {r.gram: r.n for r in held.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    n = np.array([frequency.get(g, 0) for g in block.gram.tolist()], np.int64)
    of = block.place[:, 0]
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(len(block.items) + 1))
    keep = np.zeros(len(n), bool)
    for p, q in zip(edges[:-1], edges[1:], strict=True):
        own = order[p:q]
        _, first = np.unique(block.gram[own], return_index=True)
        keep[own] = n[own] <= np.quantile(n[own[first]], rare, method="higher")
    told = [pa.array(x[keep]) for x in (block.gram, of, block.place[:, 1])]
    return held.sparkSession.createDataFrame(pa.Table.from_arrays(told, ["gram", "item", "offset"]))


def _aligned(block: Broadcast, held: DataFrame, seeds: DataFrame, least: float) -> DataFrame:
    """(a, b, item, score): texts joined to items by seeds and aligned where they meet, at a score of `least` or more."""
    found = held.select("a", "b", F.explode(F.arrays_zip("grams", "places")).alias("x")).select("a", "b", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    met = found.join(F.broadcast(seeds), "gram").select("a", "b", "item", (F.col("place") - F.col("offset")).alias("start"))  # at most BLOCK_WORDS seeds
    spots = staged(met.distinct().groupBy("a", "b", "item").agg(F.sort_array(F.collect_list("start")).alias("starts")))
    each = spots.groupBy("a", "b").agg(F.collect_list(F.struct("item", "starts")).alias("met"))
    coded = held.select("a", "b", "coded").join(each, ["a", "b"]).dropDuplicates(["a", "b"])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, (raw, met) in enumerate(zip(batch.column("coded").to_pylist(), batch.column("met").to_pylist(), strict=True)):
            text = np.frombuffer(raw, np.int32)
            for x in met:
                item = block.value.coded[x["item"]]
                best = max(align(item, text[p:q]) for p, q in _windows(x["starts"], len(item)))
                if best >= least:
                    rows.append((i, x["item"], best))
        if not rows:
            return None
        keys = batch.select(["a", "b"]).take(pa.array([r[0] for r in rows]))
        return pa.RecordBatch.from_arrays([*keys.columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["a", "b", "item", "score"])

    return map_batches(coded, work, "a long, b long, item long, score double", 50)


def _windows(starts: list[int], n: int) -> list[tuple[int, int]]:
    """The stretches of a text to align with an item of n words that seeds put at `starts`; what overlaps is one."""
    out: list[list[int]] = []
    for s in starts:
        a, b = max(0, s - n // 2), s + n + n // 2
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _matches(docs: DataFrame, benchmark: DataFrame, least: float, rare: float) -> DataFrame:
    """(a, b, item_id, score) of texts and the items they hold."""
    spark = docs.sparkSession
    field = benchmark.schema["item_id"].dataType
    out = None
    for items in blocks(benchmark):
        block = Block(items)
        if not len(block.gram):
            continue
        shared = spark.sparkContext.broadcast(block)
        held = staged(_passages(docs, shared))
        found = staged(_aligned(shared, held, _seeds(held, block, rare), least))
        shared.destroy()
        ids = pa.Table.from_arrays([pa.array(range(len(block.items)), pa.int64()), pa.array([i for i, _ in block.items], to_arrow_type(field))], ["item", "item_id"])
        named = found.join(F.broadcast(spark.createDataFrame(ids)), "item").select("a", "b", "item_id", "score")
        out = named if out is None else out.unionByName(named)
    return out if out is not None else spark.createDataFrame([], f"a long, b long, item_id {field.simpleString()}, score double")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.45, rare: float = 0.75) -> DataFrame:
    """(doc_id, item_id, score): texts that hold a test item at a score of `least` or more."""
    found = _matches(docs, benchmark, least, rare)
    return docs.select("doc_id", *_digest()).join(found, ["a", "b"]).select("doc_id", "item_id", "score")


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.45, rare: float = 0.75) -> DataFrame:
    """The rows of docs, all columns, that hold no test item."""
    bad = _matches(docs, benchmark, least, rare).select("a", "b").distinct()
    a, b = _digest()
    names = fresh(docs, "a", "b")
    keyed = docs.withColumns(dict(zip(names, (a, b), strict=True)))
    return keyed.join(bad.toDF(*names), names, "left_anti").select(*docs.columns)
