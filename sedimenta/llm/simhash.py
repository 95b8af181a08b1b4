"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 4 of 64 bits have a value between them
that differs from each in at most 2. So every fingerprint emits all its
variants within 2 bits, variants are shuffled, and fingerprints that share a
variant collide. By the triangle inequality each collision is a link, so within
a variant all may hang on its least fingerprint: no pair of a dense group is
lost to the components, and none but these stars is written out.

A fingerprint's 2,081 variants are shuffled in groups: those which agree in
their leading bits travel as one row (leading bits, fingerprint) and unfold in
the task that gets these bits; 46 rows at 9 bits, 211 at 20. How many bits lead
follows from the number of fingerprints, so that no key holds more than about
LOAD of them. Every link is verified there by its distance.

Edge cases: a null or empty text has the fingerprint zero, linked like any
other; rows without an id take the component of their fingerprint and lend it
no id; repeated rows are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged, texts
from .graph import components

HALF = 2
#: Links to other fingerprints that `near_groups` tries first for each, in each place where they meet.
ROUNDS = 2
#: Leading bits that deal out the variants, at least, and fingerprints of one leading key, about.
LEAD, LOAD = 9, 500_000
#: Links of near copies up to which one task connects them.
AT_ONCE = 200_000
#: Variants that a task unfolds at a time.
UNFOLD = 3_000_000


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    start = np.concatenate([[0], ends])[:n].tolist()
    stop = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(start, stop, strict=True)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, fp long")


@lru_cache(maxsize=64)
def _masks(first: int, last: int, weight: int) -> np.ndarray:
    """Every value with at most `weight` bits set, all of places first..last-1."""
    return np.array(sorted(sum(1 << i for i in c) for k in range(weight + 1) for c in combinations(range(first, last), k)), np.uint64)


def leading(n: int) -> int:
    """Leading bits for n fingerprints: as many as keep the mean load of a key under LOAD."""
    bits = LEAD
    while bits < 32 and n * (1 + bits + bits * (bits - 1) / 2) / 2**bits > LOAD:
        bits += 1
    return bits


def _hang(fps: np.ndarray, left: np.ndarray, lead: np.ndarray, low: int, rounds: int, bits: int, roots: np.ndarray | None = None, places: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among fps whose variants have the leading bits `lead` above place `low` and up to `left` more flips.

    With `roots`, all links between different ones, told by the `places` of their fps.
    """
    keep = np.uint64((1 << low) - 1)
    sizes = np.array([len(_masks(0, low, w)) for w in range(HALF + 1)])[left]
    if sizes.sum() > UNFOLD and low > 8:  # unfold by the next bits first
        step = low - 8
        rows, subs, lefts = [], [], []
        for w in range(HALF + 1):
            own = np.flatnonzero(left == w)
            m = _masks(step, low, w)
            weight = np.bitwise_count(m)
            rows.append(np.repeat(own, len(m)))
            subs.append(((lead[own] | (fps[own] & keep))[:, None] ^ m[None, :]).ravel() >> np.uint64(step) << np.uint64(step))
            lefts.append(np.tile(w - weight.astype(np.int64), len(own)))
        row, sub, rest = map(np.concatenate, (rows, subs, lefts))
        order = np.argsort(sub, kind="stable")
        row, sub, rest = row[order], sub[order], rest[order]
        sizes = np.array([len(_masks(0, step, w)) for w in range(HALF + 1)])[rest]
        for a, b in _runs(sub, sizes):
            if b - a > 1:
                yield from _hang(fps[row[a:b]], rest[a:b], sub[a:b], step, rounds, bits, *((None, None) if roots is None else (roots[row[a:b]], places[row[a:b]])))
        return
    variants, owners = [], []
    for w in range(HALF + 1):
        own = np.flatnonzero(left == w)
        if len(own):
            m = _masks(0, low, w)
            variants.append(((lead[own] | (fps[own] & keep))[:, None] ^ m[None, :]).ravel())
            owners.append((own, len(m)))
    if not variants:
        return
    v = np.concatenate(variants)
    s = np.sort(v)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    del s
    if not len(twice):
        return
    seen = np.zeros(1 << 20, bool)
    seen[(twice & np.uint64(0xFFFFF)).astype(np.int64)] = True
    hit = np.flatnonzero(seen[(v & np.uint64(0xFFFFF)).astype(np.int64)])
    place = np.searchsorted(twice, v[hit])
    hit = hit[twice[np.minimum(place, len(twice) - 1)] == v[hit]]
    starts = np.cumsum([0, *(len(o) * k for o, k in owners)])
    owner = np.empty(len(hit), np.int64)
    for (own, k), a, b in zip(owners, starts[:-1], starts[1:], strict=True):
        inside = (hit >= a) & (hit < b)
        owner[inside] = own[(hit[inside] - a) // k]
    value, fp = v[hit], fps[owner]
    if roots is not None:
        yield from _crossing(value, fp, roots[owner], places[owner])
        return
    order = np.lexsort((fp, value))
    value, fp = value[order], fp[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    least = fp[np.flatnonzero(first)[np.cumsum(first) - 1]]
    # two of one lead that meet under another meet under their own as well, and are told there
    top = np.uint64(64 - bits)
    told = (least != fp) & ((least >> top != fp >> top) | (least >> top == value >> top))
    links = np.unique(np.stack([least, fp], 1)[told], axis=0)
    links = _forests(links, rounds)
    if len(links):
        assert (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 2 * HALF).all()
        yield links[:, 0], links[:, 1]


def _crossing(value: np.ndarray, fp: np.ndarray, root: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of fps that share a value and aren't of one root (0 is like none), the lesser fp's first, each told under one value only."""
    order = np.lexsort((root, value))
    value, fp, root, place = value[order], fp[order], root[order], place[order]
    n = len(value)
    last = np.flatnonzero(np.append(value[1:] != value[:-1], True)) + 1
    stop = last[np.searchsorted(last, np.arange(n), "right")]
    own = np.flatnonzero(np.append((value[1:] != value[:-1]) | (root[1:] != root[:-1]) | (root[1:] == 0), True)) + 1
    other = own[np.searchsorted(own, np.arange(n), "right")]  # the first of another root
    at = np.arange(n)
    while len(at := at[other[at] < stop[at]]):
        a, b = fp[at], fp[other[at]]
        u, v = np.minimum(a, b), np.maximum(a, b)
        told = _meeting(u, v) == value[at]
        if told.any():
            x, y, turned = place[at[told]], place[other[at[told]]], (a > b)[told]
            yield np.where(turned, y, x), np.where(turned, x, y)
        other[at] += 1


def _meeting(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The one value between u and v, HALF bits at most from each, under which their pair is told."""
    x = u ^ v
    one = x & (~x + np.uint64(1))
    rest = x ^ one
    return u ^ one ^ np.where(np.bitwise_count(x) > HALF, rest & (~rest + np.uint64(1)), np.uint64(0))


def _forests(links: np.ndarray, rounds: int) -> np.ndarray:
    """Those of some links that connect what is not yet connected, then those that would without these, and so on.

    A round keeps at most one link a fingerprint and loses no connection; more
    rounds leave other ways where a link fails a later test.
    """
    kept: list[int] = []
    left = list(range(len(links)))
    pairs = links.tolist()
    for _ in range(rounds):
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        rest = []
        for i in left:
            a, b = map(find, pairs[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append(i)
            else:
                rest.append(i)
        left = rest
    return links[sorted(kept)]


def _runs(key: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of whole runs of equal keys, of about UNFOLD in all or one run each."""
    edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.array([0])
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(total[edges], total[edges[a]] + UNFOLD, "right")) - 1)
        b = min(b, len(edges) - 1)
        yield int(edges[a]), int(edges[b])
        a = b


def links(distinct: DataFrame, rounds: int = 1, least: float | None = None) -> DataFrame:
    """(u, v) between fingerprints of `distinct` (fp) that differ in at most 4 bits, enough of them to connect whatever is linked.

    `rounds` times over, if so many ways there are. With a column root in
    `distinct`, all pairs that differ so, once each, but those of one root; 0 is like none.
    With `least`, and columns node, n and sketch, (a, b) between nodes instead, without
    the pairs whose sizes or sketches tell them apart at that similarity.
    """
    extra = [c for c in distinct.columns if c == "root"]
    if least is not None:
        words = [f"s{i}" for i in range((len(SKETCH) + ODD) // 64)]
        distinct = distinct.select("fp", "root", "n", *[F.get("sketch", F.lit(i)).alias(w) for i, w in enumerate(words)], "node")
        extra += ["n", *words, "node"]
    bits = leading(distinct.count())
    low = 64 - bits
    heads = sorted({sum(1 << i for i in c) for k in range(HALF + 1) for c in combinations(range(bits), k)})
    dealt = distinct.select("fp", *extra, F.explode(F.array(*[F.lit(m).cast("long") for m in heads])).alias("m")).select(F.shiftrightunsigned("fp", low).bitwiseXOR(F.col("m")).alias("lead"), "fp", *extra).repartition("lead").sortWithinPartitions("lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held)
            lead, fp = part.column(0).to_numpy().astype(np.uint64), part.column(1).to_numpy().view(np.uint64)
            roots = part.column(2).to_numpy() if extra else None
            left = HALF - np.bitwise_count((fp >> np.uint64(low)) ^ lead).astype(np.int64)
            sizes = np.array([len(_masks(0, low, w)) for w in range(HALF + 1)])[left]
            for a, b in _runs(lead, sizes):
                if b - a > 1:
                    for u, v in _hang(fp[a:b], left[a:b], lead[a:b] << np.uint64(low), low, rounds, bits, *((None, None) if roots is None else (roots[a:b], np.arange(a, b)))):
                        if least is not None:
                            alike = _alike(part, u, v, least)
                            nodes = part.column("node").combine_chunks()
                            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(of[alike])) for of in (u, v)], ["a", "b"])
                            continue
                        u, v = (u, v) if roots is None else (fp[u], fp[v])
                        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(u.view(np.int64))], ["u", "v"])

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size > 20_000:  # all but the last lead are whole
                lead = batch.column(0).to_numpy()
                cut = int(np.searchsorted(lead, held[-1].column(0)[-1].as_py(), "right"))
                if cut < batch.num_rows:
                    yield from solve([*held, batch.slice(0, cut)])
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from solve(held)

    kind = "u long, v long" if least is None else "a {0}, b {0}".format(distinct.schema["node"].dataType.simpleString())
    return dealt.mapInArrow(run, kind)


def _alike(part: pa.Table, u: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows may have similarity `least`: by their sizes, the minima's bits and the odd bits.

    Of sets of n and m shingles that are so alike, at most (n + m) (1 - least) / (1 + least)
    shingles are in one only, and each of these turns one odd bit.
    """
    n = part.column("n").to_numpy()
    n, m = n[u], n[v]
    far = [np.bitwise_count(w[u] ^ w[v]).astype(np.int64) for w in (part.column(f"s{i}").to_numpy().view(np.uint64) for i in range((len(SKETCH) + ODD) // 64))]
    own = len(SKETCH) // 64
    return (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6) & (sum(far[:own]) <= _differing(least)) & (sum(far[own:]) <= (n + m) * (1 - least) / (1 + least) + 1e-6)


def groups(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the least doc_id reachable over links."""
    prints = staged(fingerprints(docs, shingle))
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(ids, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Seeds of the two fingerprints and multipliers of the eight minima, two a mark, that a text gets in `near_groups`.
SEEDS = (42, 7)
MINIMA = tuple(xxhash.xxh64_intdigest(f"minimum {i}", 42) | 1 for i in range(8))
#: A text's sketch has a bit of each of so many minima. Of two texts of similarity s, a share (1 - s) / 2 of the bits differ.
SKETCH = tuple(xxhash.xxh64_intdigest(f"sketch {i}", 42) | 1 for i in range(256))
#: Bits behind these that tell of so many hashed places whether an odd number of the text's shingles falls there.
ODD = 512


def _differing(least: float) -> float:
    """Bits that the sketches of two texts of similarity `least` differ in at most, four standard deviations from the mean."""
    share = (1 - least) / 2
    return len(SKETCH) * share + 4 * math.sqrt(len(SKETCH) * share * (1 - share))


def shingles(text: str, size: int = 5) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a: str, b: str, size: int = 5) -> float:
    """Jaccard similarity of two texts' shingle sets; two empty texts are alike."""
    x, y = shingles(a, size), shingles(b, size)
    return len(x & y) / len(x | y) if x or y else 1.0


def _word_print(counts: dict[bytes, int], seed: int) -> int:
    h = np.array([xxhash.xxh64_intdigest(w, seed) for w in counts], dtype=">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    weight = np.fromiter(counts.values(), np.int64, len(counts))
    return int(np.packbits(2 * (weight @ bits) > weight.sum()).view(">u8")[0])


def near_groups(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id): groups of documents linked by shingle similarity of `least` or more.

    Texts of one word sequence are one node. A node's keys are its two word
    fingerprints, each moved by one of four marks, so that a ball is shared
    only by texts near in words and with a mark in common. A mark is a pair of
    minima of the shingle hashes; of two texts of similarity 0.8, 98 in 100
    share one. Marks that only one node has emit nothing. Colliding pairs are
    then verified on the whole texts: first enough of them to connect whatever
    collides, then all that weren't tried and lie between different groups, so
    a pair that fails hides none that holds. Of the latter, pairs are left out
    where they are met, before any join, if sizes or sketches tell them apart:
    a large group of remote copies has many. The bound of the minima's bits is
    four standard deviations from what is due at `least`, so that of pairs just
    at it one in 30,000 is lost; sizes and odd bits lose none. Fingerprints that
    had no link when all were linked are met by none and left out.
    """
    prints = staged(_near_prints(docs, size))
    nodes = prints.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("marks", "doc_id").alias("marks"), F.min_by("prints", "doc_id").alias("prints"), F.min_by("n", "doc_id").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")).where(F.col("node").isNotNull())
    entries = staged(nodes.select("node", "prints", "n", "sketch", F.posexplode("marks").alias("i", "mark")))
    shared = entries.groupBy("i", "mark").agg(F.count("*").alias("holders")).where(F.col("holders") > 1)
    keys = staged(entries.join(shared, ["i", "mark"]).select("node", "n", "sketch", F.explode("prints").alias("print"), "mark").select("node", "n", "sketch", F.col("print").bitwiseXOR(F.col("mark")).alias("fp")))
    heads = staged(keys.groupBy("fp").agg(F.min("node").alias("head")))
    linked = staged(links(heads.select("fp"), rounds=ROUNDS).distinct())  # a pair meets in several places
    same = keys.join(heads, "fp").where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = linked.join(heads.withColumnsRenamed({"fp": "u", "head": "a"}), "u").join(heads.withColumnsRenamed({"fp": "v", "head": "b"}), "v").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    pairs = staged(same.union(near).distinct())
    true = staged(_verified(docs, pairs, size, least))
    roots = staged(components(true.select(F.col("b").alias("u"), F.col("a").alias("v")), at_once=AT_ONCE))
    met = linked.select(F.col("u").alias("fp")).union(linked.select("v")).union(keys.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp")).distinct()
    held = staged(keys.join(met, "fp", "left_semi").join(roots, "node", "left").select("node", "n", "sketch", "fp", F.xxhash64(F.coalesce("root", "node")).alias("root")))
    left = links(held, least=least)
    left = staged(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    more = staged(_verified(docs, left, size, least))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more.select("b", "a")), at_once=AT_ONCE)
    placed = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return prints.select("doc_id", "digest").join(placed, "digest", "left").select("doc_id", "component_id")


def _verified(docs: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """Those of `pairs` (a, b) whose texts have similarity `least` or more."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # the ids grow with the documents: no side of these joins is for broadcasting
    body = staged(docs.select(F.col("doc_id").alias("node"), "text").join(ids.hint("merge"), "node").groupBy("node").agg(F.min("text").alias("text")))
    both = pairs.join(body.withColumnsRenamed({"node": "a", "text": "ta"}).hint("merge"), "a").join(body.withColumnsRenamed({"node": "b", "text": "tb"}).hint("merge"), "b")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        close = [similarity(x or "", y or "", size) >= least for x, y in zip(*(batch.column(c).to_pylist() for c in ("ta", "tb")), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(both.select("a", "b", "ta", "tb"), verify, f"a {kind}, b {kind}", 200)


def _near_prints(docs: DataFrame, size: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    factors, drawn = np.array(MINIMA, np.uint64), np.array(SKETCH, np.uint64)

    def sketch(h: np.ndarray) -> list[int]:
        bits = np.concatenate([(drawn[i : i + 32, None] * h[None, :]).min(1) >> np.uint64(20) & np.uint64(1) for i in range(0, len(drawn), 32)])
        odd = np.bincount((h * factors[0] >> np.uint64(65 - ODD.bit_length())).astype(np.int64), minlength=ODD) & 1
        return np.packbits(np.concatenate([bits, odd]).astype(np.uint8)).view(np.uint64).tolist()

    def one(text: str) -> tuple[bytes, list[int], list[int], int, list[int]]:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        joined = b" ".join(words)
        digest = xxhash.xxh3_128_digest(joined)
        if not words:
            return digest, [], [], 0, []
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        n = max(1, len(words) - size + 1)
        ends = np.cumsum([len(w) + 1 for w in words])
        start, stop = np.concatenate([[0], ends])[:n].tolist(), (ends[-n:] - 1).tolist()
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(start, stop, strict=True)], np.uint64)
        least = np.array([(h * f).min() for f in factors], np.uint64)
        marks = [int(a ^ (b >> np.uint64(1))) for a, b in least.reshape(-1, 2)]
        h = np.unique(h)
        return digest, marks, [_word_print(counts, s) for s in SEEDS], len(h), sketch(h)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [one(t) for t in texts(batch)]
        longs = [pa.array([np.array(x[i], np.uint64).view(np.int64) for x in got], pa.list_(pa.int64())) for i in (1, 2, 4)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in got], pa.binary()), *longs, pa.array([x[3] for x in got], pa.int64())], ["doc_id", "digest", "marks", "prints", "sketch", "n"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, digest binary, marks array<long>, prints array<long>, sketch array<long>, n long")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, all columns: that of the least doc_id; rows without an id all stay."""
    first = near_groups(docs).where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("copies"))
    first = staged(first)
    twice = first.where("copies > 1").select("doc_id")
    kept = docs.join(first.where("copies = 1").select("doc_id").hint("merge"), "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
    if twice.isEmpty():
        return kept
    return kept.unionByName(docs.join(twice.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
