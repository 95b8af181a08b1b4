"""Language-model scoring with a log-frequency Bloom filter.

Counts of words, of word pairs and of the kinds of words behind each word are
put on a scale of levels whose steps grow with the count; an item of level q is
in the Bloom filter q times, once for each level up to q, so its count is read
back by repeated membership probes. The model interpolates pairs with words by
absolute discounting: p(w | h) = (max(c(h, w) - D, 0) + (PRIOR + D kinds(h)) p(w)) / (c(h) + PRIOR).

Counting: each task sorts its tokens and pairs by hash and sums them; sorted
runs of one hash range (bucket) travel as a row of arrays. The task that gets a
bucket sums it and builds the bucket's part of the filter, as large as its
entries need. All pairs are stored, those seen once too, under 64-bit hashes.

The filter grows with the corpus. The parts for words and kinds are broadcast;
the pairs' part is broadcast while it fits BLOCK_BYTES. Beyond, it is cut into
blocks of at most BLOCK_BYTES. The distinct pairs of a stretch of texts are then
dealt to the tasks that hold the blocks, which send back a level for each; what
else the stretch's scores need waits for them. The bits are the same, so are the
scores. That takes more room than the texts, so it is done for a share of the
texts after the other, up to ROUNDS of them, and each leaves only its scores.

Base counts are exact: the HEAD commonest words are looked up in the worker,
the rest of a text's words are joined to the counts.

Edge cases: a null or empty text is one end token; rows without an id count by
the empty text; repeated rows are learned and scored each; without training
texts every score is zero; columns other than the key and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import commonest, map_batches, removed, staged, texts

HEAD = 262_144
BLOCK_BYTES = 128 << 20
#: With several blocks, shares in which texts are scored, at most, and the least bytes of text of a share.
ROUNDS, ROUND_BYTES = 6, 64 << 20
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 16 << 20, 64
#: Tokens that a task sums at a time, and about the entries that it gathers of a bucket before it sums them.
FLUSH = 1_000_000
BITS, PROBES = 10, 5
DISCOUNT, PRIOR = 0.75, 0.5
STEP = 1.25
END = np.uint64(xxhash.xxh64_intdigest(b"\n", 42))
#: Kinds of what the filter counts.
WORD, PAIR, KINDS = 1, 2, 3
LOW = np.uint64(0xFFFFFFFF)


def levels(most: float = 2.0**62) -> np.ndarray:
    """The least count of each level: 1, 2, 3 ... and from there on in steps of a quarter."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return np.array(out[:-1], np.int64)


LEVELS = levels()
#: What a level stands for: the middle of its counts; 0 for none.
VALUES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2, [float(LEVELS[-1])]])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the leading bits, so that sorted keys have sorted buckets."""
    with np.errstate(over="ignore"):
        return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _places(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of a key's bit places at a level, as shares of 2^32."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
    return h & LOW, (h >> np.uint64(32)) | np.uint64(1)


def entries(n: np.ndarray) -> int:
    return int(np.searchsorted(LEVELS, n, "right").sum())


def build(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The filter of one bucket as bytes, BITS bits for each level of each key."""
    top = np.searchsorted(LEVELS, n, "right")
    size = np.uint64(64 * max(1, -(-int(top.sum()) * BITS // 64)))
    bits = np.zeros(int(size), bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        a, b = _places(keys[top >= level], level)
        for _ in range(PROBES):
            bits[(a * size >> np.uint64(32)).astype(np.int64)] = True
            a = (a + b) & LOW
    return np.packbits(bits, bitorder="little")


class Filter:
    """Filters of several buckets, first to last, side by side."""

    def __init__(self, parts: list[bytes], buckets: int, first: int = 0):
        self.bits = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([8 * len(x) for x in parts], np.uint64)
        self.start, self.size = (np.cumsum(size) - size).astype(np.int64), size
        self.buckets, self.first = buckets, first

    def count(self, keys: np.ndarray) -> np.ndarray:
        return VALUES[self.level(keys)]

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys, read back one by one until one is missing; a probe is made only for those that passed the last."""
        out = np.zeros(len(keys), np.int64)
        bucket = bucket_of(keys, self.buckets) - self.first
        live = np.flatnonzero((bucket >= 0) & (bucket < len(self.size)))
        bucket = bucket[live]
        live = live[held := self.size[bucket] > 0]
        bucket = bucket[held]
        start, size, level = self.start[bucket], self.size[bucket], 1
        while len(live) and level < len(VALUES):
            a, b = _places(keys[live], level)
            for _ in range(PROBES):
                at = start + (a * size >> np.uint64(32)).astype(np.int64)
                hit = np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if len(hit) < len(live):
                    live, b, start, size, a = live[hit], b[hit], start[hit], size[hit], a[hit]
                a = (a + b) & LOW
            out[live] = level
            level += 1
        return out


def hashed(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the texts' tokens, an end token behind each text; the first token of each text)."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in batch]
    size = np.array([len(w) for w in words], np.int64)
    n = int(size.sum())
    plain = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words), repeat(42, n)), np.uint64, n)
    ends = np.cumsum(size)
    tokens = np.insert(plain, ends, END)
    return tokens, (ends - size + np.arange(len(batch))).astype(np.int64)


def histories(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each; 0 stands before the first of a text."""
    out = np.concatenate([[np.uint64(0)], tokens[:-1]]) if len(tokens) else tokens.copy()
    out[first] = 0
    return out


def pair(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(history * np.uint64(0x9E3779B97F4A7C15) + mix(token))


def kinds_key(history: np.ndarray) -> np.ndarray:
    """A history's key among the counts of kinds; a start of text is one like any other."""
    return mix(history + np.uint64(0x9E3779B97F4A7C15))


def summed(key: np.ndarray, n: np.ndarray, *along: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, their sums of n, and what goes along with each."""
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[start], np.add.reduceat(n[order], start) if len(start) else n[:0], *(x[order[start]] for x in along)


SUMS = "kind tinyint, bucket long, keys binary, n binary, histories binary"


def _arrays(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values cut at edges, as binary."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _sums(kind: int, buckets: int, key: np.ndarray, n: np.ndarray, history: np.ndarray) -> pa.RecordBatch:
    """Sorted keys with their sums, one row a bucket."""
    bucket = bucket_of(key, buckets)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    edges = np.append(start, len(key))
    history = history if len(history) else np.empty(0, np.uint64)
    histories = _arrays(history, edges) if len(history) else pa.nulls(len(start), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(start), kind, np.int8)), pa.array(bucket[start]), _arrays(key, edges), _arrays(n.astype(np.int32), edges), histories], ["kind", "bucket", "keys", "n", "histories"])


def counts(docs: DataFrame, buckets: int) -> DataFrame:
    """SUMS of the tokens and of the token pairs of all texts, summed in each task a stretch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, before = (np.concatenate(x) for x in zip(*held, strict=True))
            ones = np.ones(len(tokens), np.int32)
            yield _sums(WORD, buckets, *summed(tokens, ones), np.empty(0, np.uint64))
            yield _sums(PAIR, buckets, *summed(pair(before, tokens), ones, before))

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                tokens, first = hashed(texts(batch.slice(start, 500)))
                held.append((tokens, histories(tokens, first)))
                size += len(tokens)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return docs.select("text").mapInArrow(run, SUMS)


TOLD = "kind tinyint, bucket long, entries long, total long, keys binary, n binary, histories binary, bits binary"


def merged(sums: DataFrame, buckets: int) -> DataFrame:
    """TOLD: each bucket's filter; of words their counts too, of pairs the numbers of kinds by history, to be merged again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def row(kind: int, bucket: int, key: np.ndarray, n: np.ndarray, keep: bool) -> pa.RecordBatch:
            values = [kind, bucket, entries(n), int(n.sum()), key.tobytes() if keep else None, n.tobytes() if keep else None, None, build(key, n).tobytes()]
            types = [pa.int8(), *[pa.int64()] * 3, *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in TOLD.split(", ")])

        def fold() -> None:
            nonlocal held, size
            held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = len(held[0][0])

        def done() -> Iterator[pa.RecordBatch]:
            fold()
            kind, bucket = now
            key, n, *of = held[0]
            yield row(kind, bucket, key, n, kind == WORD)
            if kind == PAIR:
                history, kinds = np.unique(of[0], return_counts=True)
                told = _sums(KINDS, buckets, *summed(kinds_key(history), kinds), np.empty(0, np.uint64))
                none = [pa.nulls(told.num_rows, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([told.column(0), told.column(1), none[0], none[1], told.column(2), told.column(3), none[2], none[3]], [x.split()[0] for x in TOLD.split(", ")])

        for batch in batches:
            for kind, bucket, *arrays in zip(*(batch.column(i) for i in range(5)), strict=True):
                at = kind.as_py(), bucket.as_py()
                if at != now:
                    if now is not None:
                        yield from done()
                    now, held, size = at, [], 0
                # copied, so that the batch they came in can go
                key, n, of = ((np.frombuffer(x.as_buffer(), t).astype(np.int64 if t == np.int32 else t) if x.is_valid else None) for x, t in zip(arrays, (np.uint64, np.int32, np.uint64), strict=True))
                held.append((key, n) if of is None else (key, n, of))
                size += len(key)
                if size > max(FLUSH, 2 * len(held[0][0])) and len(held) > 1:
                    fold()
        if now is not None:
            yield from done()

    return sums.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(run, TOLD)


def lean(df: DataFrame) -> DataFrame:
    """Like `staged`, and the shuffles that led to it are deleted."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return staged(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


class Model:
    """Counts of a training corpus: exact ones of words, and the filters of words, pairs and kinds."""

    def __init__(self, docs: DataFrame):
        size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        self.texts = size[0]
        self.buckets = max(BUCKETS, -(-(size[1] or 0) // BUCKET_BYTES))
        self.told = lean(merged(counts(docs, self.buckets), self.buckets))
        kinds = self.told.where((F.col("kind") == KINDS) & F.col("bits").isNull()).select("kind", "bucket", "keys", "n", "histories")
        self.kinds = lean(merged(kinds, self.buckets))
        held = self.told.where(F.col("kind") == WORD)
        total = held.agg(F.sum("total"), F.sum(F.octet_length("keys") / 8).cast("long")).first()
        self.tokens, self.distinct = total[0] or 0, total[1] or 0
        self.scale = self.tokens + 0.5 * (self.distinct + 1)

        def unpack(batch: pa.RecordBatch) -> pa.RecordBatch:
            key, n = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int64) for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        self.words = map_batches(held.select("keys", "n"), unpack, "key long, n long", 1)
        # the first bucket of each block of pairs: one number for each of the buckets, themselves of bounded size
        sizes = {r.bucket: r.size for r in self.told.where(F.col("kind") == PAIR).select("bucket", F.octet_length("bits").alias("size")).collect()}
        self.blocks, room = [0], BLOCK_BYTES
        for bucket in range(self.buckets):
            if sizes.get(bucket, 0) > room and bucket > self.blocks[-1]:
                self.blocks.append(bucket)
                room = BLOCK_BYTES
            room -= sizes.get(bucket, 0)

    def head(self, most: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of the commonest words, at most `most`, by hash."""
        got = commonest(self.words, most).toArrow()
        key, n = got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()
        order = np.argsort(key)
        return key[order], n[order]

    def filter(self, kind: int) -> Filter:
        """The whole filter of a kind."""
        rows = (self.kinds if kind == KINDS else self.told.where(F.col("kind") == kind)).select("bucket", "bits").toArrow()
        parts = [b""] * self.buckets
        for bucket, bits in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
            parts[bucket] = bits
        return Filter(parts, self.buckets)


def _looked_up(head: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in the head, exact count there) of tokens."""
    keys, n = head
    if not len(keys):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    hit = keys[at] == tokens
    return hit, np.where(hit, n[at], 0)


def _log10(seen: np.ndarray, rest: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log10 of probabilities from counts of pairs, the mass left to words times the word's share, and counts of histories.

    Quantised counts may exceed the history's own, so they are held to it.
    """
    return np.log10(np.minimum((np.minimum(np.maximum(seen - DISCOUNT, 0), total) + rest) / (total + PRIOR), 1.0))


def score(docs: DataFrame, trained_on: Column, key: str = "doc_id", head: int = HEAD) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of each row, learned from the rows where `trained_on`."""
    model = Model(docs.where(trained_on))
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in (model.head(head), model.filter(WORD), model.filter(KINDS))]
    named = docs.select(F.col(key).alias("key"), "text")
    numbers = {"scale": model.scale, "texts": model.texts, "blocks": np.array(model.blocks), "buckets": model.buckets}
    if len(model.blocks) == 1:
        shared.append(context.broadcast(model.filter(PAIR)))
        own = staged(_scored(named.withColumn("row", F.monotonically_increasing_id()), shared, numbers)).drop("chunk", "block", "data")
    else:
        own = _in_rounds(model, named, shared, numbers)
    for x in shared:
        x.destroy()
    log = lambda n: F.log10((n + F.lit(0.5)) / F.lit(model.scale))
    rest = (
        own.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("times"))
        .join(model.words.select(F.col("key").alias("w"), F.col("n")), "w", "left").groupBy("row")
        .agg(F.sum(F.col("times") * log(F.coalesce("n", F.lit(0)))).alias("rest"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"))
    )
    out = own.join(rest, "row", "left")
    return out.select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )


def _in_rounds(model: Model, named: DataFrame, shared: list[Broadcast], numbers: dict) -> DataFrame:
    """What `_scored` tells of each row, with several blocks. Rows are dealt to rounds by their own hash."""
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, min(ROUNDS, -(-size // ROUND_BYTES)))
    done = []
    for i in range(rounds):
        some = named.where(F.pmod(F.xxhash64("key", "text"), F.lit(rounds)) == i)
        found = staged(_scored(some.withColumn("row", F.monotonically_increasing_id() * rounds + i), shared, numbers))
        scores = lean(_answered(model, found.where("chunk IS NOT NULL").select("chunk", "block", "data")))
        own = found.where("row IS NOT NULL").drop("score", "chunk", "block", "data")
        done.append(lean(own.join(scores, "row", "left")))
        removed(found)
        removed(scores)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


SCORED = ["row", "key", "n_tokens", "n_known", "base", "score", "rare", "times", "chunk", "block", "data"]


def _scored(named: DataFrame, shared: list[Broadcast], numbers: dict) -> DataFrame:
    """One row for each text; with several blocks, rows of stretches and of their pairs besides."""
    kind = named.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, words, kinds, *pairs = (x.value for x in shared)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                tokens, first = hashed(texts(batch))
                size = np.diff(np.append(first, len(tokens)))
                row = batch.column("row").to_numpy()
                back, unique = pd.factorize(tokens)
                hit, n = _looked_up(head, unique)
                about = n.astype(float)
                about[~hit] = words.count(unique[~hit])
                # a history is the token before, or the start of a text, which comes last here
                left = PRIOR + DISCOUNT * kinds.count(kinds_key(np.append(unique, np.uint64(0))))
                before = np.append(len(unique), back[:-1])
                before[first] = len(unique)
                total = np.append(about, float(numbers["texts"]))[before]
                rest = left[before] * ((about + 0.5) / numbers["scale"])[back]
                keys = pair(np.append(unique, np.uint64(0))[before], tokens)
                if pairs:
                    which, once = pd.factorize(keys)  # common pairs have many levels; each is probed once
                    sums = np.add.reduceat(_log10(pairs[0].count(once)[which], rest, total), first)
                else:
                    sums = np.zeros(len(row))
                    yield _asked(numbers, row, size, keys, rest, total, batch.column("key").type)
                hit, n = hit[back], n[back]
                base = np.add.reduceat(np.where(hit, np.log10((n + 0.5) / numbers["scale"]), 0.0), first)
                known = np.add.reduceat(hit.astype(np.int64), first)
                of, rare = np.repeat(np.arange(len(row)), size)[~hit], tokens[~hit]
                order = np.lexsort((rare, of))
                of, rare = of[order], rare[order]
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (rare[1:] != rare[:-1])]) if len(of) else np.empty(0, bool)
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(of)))
                ends = np.searchsorted(of[starts], np.arange(len(row) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rare[starts].view(np.int64), times.astype(np.int64))]
                none = [pa.nulls(len(row), t) for t in (pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(size.astype(np.int64)), pa.array(known), pa.array(base), pa.array(sums), *lists, *none], SCORED)

    return named.select("row", "key", "text").mapInArrow(run, f"row long, key {kind}, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>, chunk long, block long, data binary")


def _asked(numbers: dict, row: np.ndarray, size: np.ndarray, keys: np.ndarray, rest: np.ndarray, total: np.ndarray, key_type: pa.DataType) -> pa.RecordBatch:
    """The distinct pairs of a stretch of texts, a row for each block; as block -1 what waits for their levels: see `_sum`."""
    once, at, which = np.unique(keys, return_index=True, return_inverse=True)
    block = np.searchsorted(numbers["blocks"], bucket_of(once, numbers["buckets"]), "right") - 1
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    waits = b"".join(x.tobytes() for x in (np.array([len(row), len(once)], np.int64), row.astype(np.int64), size.astype(np.int64), rest[at], total[at], which.astype(np.uint32)))
    data = [waits, *(once[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(once)], strict=True))]
    none = [pa.nulls(len(data), t) for t in (pa.int64(), key_type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*none, pa.array(np.full(len(data), row[0])), pa.array(np.append(-1, block[edges])), pa.array(data, pa.binary())], SCORED)


def _sum(waits: bytes, levels: np.ndarray) -> pa.RecordBatch:
    """(row, score) of a stretch."""
    n, pairs = np.frombuffer(waits, np.int64, 2).tolist()
    row, size = np.frombuffer(waits, np.int64, 2 * n, 16).reshape(2, n)
    rest, total = np.frombuffer(waits, np.float64, 2 * pairs, 16 + 16 * n).reshape(2, pairs)
    which = np.frombuffer(waits, np.uint32, -1, 16 + 16 * n + 16 * pairs)
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.add.reduceat(_log10(VALUES[levels], rest, total)[which], np.cumsum(size) - size))], ["row", "score"])


def _answered(model: Model, asked: DataFrame) -> DataFrame:
    """(row, score): the pairs answered by the tasks that hold the blocks, the answers added up by stretch.

    A block is held by several tasks, so that its pairs are no one task's.
    """
    spark = asked.sparkSession
    salts = max(1, -(-2 * spark.sparkContext.defaultParallelism // len(model.blocks)))
    first, buckets = np.array([*model.blocks, model.buckets]), model.buckets
    bits = model.told.where(F.col("kind") == PAIR).select("bucket", "bits")

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = np.searchsorted(first[:-1], batch.column(0).to_numpy(), "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(block), batch.column(0), batch.column(1)], ["block", "bucket", "data"])

    none = F.lit(None).cast("long")
    held = map_batches(bits, deal, "block long, bucket long, data binary", 16).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("chunk", none)
    pairs = asked.where("block >= 0").withColumns({"bucket": F.lit(-1).cast("long"), "salt": F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")})
    dealt = held.unionByName(pairs).repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("bucket") < 0).select("block", "salt", "bucket", "chunk", "data")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, filter = None, {}, None
        for batch in batches:
            for block, salt, bucket, chunk, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                if (block.as_py(), salt.as_py()) != at:
                    at, parts, filter = (block.as_py(), salt.as_py()), {}, None
                if bucket.as_py() >= 0:
                    parts[bucket.as_py()] = data.as_py()
                    continue
                if filter is None:
                    a, b = int(first[at[0]]), int(first[at[0] + 1])
                    filter, parts = Filter([parts.get(i, b"") for i in range(a, b)], buckets, a), {}
                levels = filter.level(np.frombuffer(data.as_buffer(), np.uint64)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([at[0]], pa.int64()), pa.array([levels.tobytes()], pa.binary())], ["chunk", "block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waits, levels = None, b"", []
        for batch in batches:
            for chunk, block, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                if chunk.as_py() != now:
                    if now is not None:
                        yield _sum(waits, np.concatenate(levels))
                    now, levels = chunk.as_py(), []
                if block.as_py() < 0:
                    waits = data.as_py()
                else:
                    levels.append(np.frombuffer(data.as_py(), np.uint8))
        if now is not None:
            yield _sum(waits, np.concatenate(levels))

    told = asked.where("block < 0").unionByName(dealt.mapInArrow(answer, "chunk long, block long, data binary"))
    return told.repartition("chunk").sortWithinPartitions("chunk", "block").mapInArrow(add, "row long, score double")
