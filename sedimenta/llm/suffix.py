"""Suffix-array dedup on bytes: remove what repeats an earlier string of `length` bytes.

A radix sort of suffixes by most significant digits, no deeper than `length`
bytes; suffixes that stay equal to that depth are the repeated windows. Only
equality counts, so digits are hashes, and the first one is sampled: it is the
window's minimiser, the 16-byte string of least hash in it. Equal windows have
equal minimisers at equal places, and neighbouring windows mostly share one, so
the first pass deals out one row for some forty suffixes. Digits that occur
once are settled; only the others send their bytes to the second pass, which
sorts the suffixes of a digit by all that is left of them. Whatever comes out
equal is compared byte by byte before anything is removed.

Copies of whole texts are settled by their SHA-256 before the sort. Of a digit
that a batch of texts holds twice or more, one row goes to the digit's task and
the others, known to repeat, anywhere. Digits with more than HOT occurrences
take a third pass in which every suffix is dealt out by 128 bits of its own
hash and only the least place of each is joined back, by place, so no group of
equals meets in one task. HOT changes the way, not the result.

Edge cases: a null text is empty; texts under `length` bytes lose nothing;
repeated rows (same id, same text) are one document; rows without an id come
after all others; texts under one id are ordered by their digests; columns
other than doc_id and text are ignored; `length` is 16 to 1,000.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

DIGIT = 16
HOT = 200_000
#: Bytes of a text that are sorted at a time; pieces overlap by a window less one byte.
PIECE = 60_000
CHUNK = 1 << 20


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _join(left: np.ndarray, size: int, right: np.ndarray) -> np.ndarray:
    """Hashes of strings made of one of `size` bytes and the one behind it."""
    n = len(right) - size
    if n <= 0:
        return left[:0]
    with np.errstate(over="ignore"):
        out = left[:n] * np.uint64(0xBF58476D1CE4E5B9) ^ (right[size : size + n] + np.uint64(0x94D049BB133111EB))
        out ^= out >> np.uint64(31)
        return out * np.uint64(0xD6E8FEB86659FD93)


def hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all strings of `length` bytes, by doubling."""
    with np.errstate(over="ignore"):
        power = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        power ^= power >> np.uint64(29)
    out, done, size = None, 0, 1
    while True:
        if length & size:
            out, done = (power, size) if out is None else (_join(power, size, out), done + size)
        if done == length:
            return out
        power = _join(power, size, power)
        size *= 2


def minimisers(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(digit, its place, first window, last window) of each minimiser of a text's windows."""
    for start in range(0, max(1, len(data) - length + 1), PIECE):
        piece = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - start), start)
        if len(piece) < length:
            return
        h = hashes(piece, DIGIT)
        # the hash rules, then the place: the leftmost of equal digits
        least = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        width, reach = length - DIGIT + 1, 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        at = (least & np.uint64(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        yield h[at[first]], at[first] + start, first + start, last + start


def _pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return at << 20 | (at - first) << 10 | (last - first)


#: A minimiser's digit was seen once in its batch of texts; twice or more, this row speaks for them; twice or more, another does.
ALONE, FIRST, FURTHER = 0, 1, 2
SPOTS = "digit long, doc long, spot long"


def digits(docs: DataFrame, length: int) -> DataFrame:
    """(digit, doc, spot, kind): spot packs the minimiser's place with its first and last window."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc").to_numpy()
        digit, doc, spot = [], [], []
        for i, data in zip(ids, _bytes(batch.column("data")), strict=True):
            for h, at, first, last in minimisers(data, length):
                digit.append(h)
                doc.append(np.full(len(h), i))
                spot.append(_pack(at, first, last))
        if not digit:
            return None
        digit = np.concatenate(digit).view(np.int64)
        order = np.argsort(digit, kind="stable")
        digit = digit[order]
        new = np.concatenate([[True], digit[1:] != digit[:-1]])
        alone = new & np.append(new[1:], True)
        kind = np.where(alone, ALONE, np.where(new, FIRST, FURTHER)).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(digit), pa.array(np.concatenate(doc)[order]), pa.array(np.concatenate(spot)[order]), pa.array(kind)], ["digit", "doc", "spot", "kind"])

    return map_batches(docs.select("doc", "data"), work, f"{SPOTS}, kind tinyint", 300)


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose digit some other row has; rows are streamed in the order of their digits.

    Only the first row of a digit in each batch goes to the digit's task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row, not yet told, and the digit before it
        for batch in batches:
            further = batch.column(3).to_numpy() == FURTHER
            if further.any():
                yield batch.select([0, 1, 2]).filter(pa.array(further))
                batch = batch.filter(pa.array(~further))
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks().to_batches()[0]
            digit = now.column(0).to_numpy()
            same = np.concatenate([[before is not None and digit[0] == before], digit[1:] == digit[:-1]])
            some = same | (now.column(3).to_numpy() == FIRST)
            some[:-1] |= same[1:]
            yield now.select([0, 1, 2]).slice(0, now.num_rows - 1).filter(pa.array(some[:-1]))
            held, before = now.slice(now.num_rows - 1), digit[-2] if len(digit) > 1 else before
        if held is not None and (held.column(3)[0].as_py() == FIRST or before is not None and held.column(0)[0].as_py() == before):
            yield held.select([0, 1, 2])

    further = F.col("kind") == FURTHER
    dealt = rows.repartition(F.when(further, F.xxhash64("doc", "spot")).otherwise(F.col("digit")))
    return dealt.sortWithinPartitions(further, "digit").mapInArrow(run, SPOTS)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, packed): texts as Zstandard frames, which halves what a join of texts shuffles."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([press(x) for x in _bytes(batch.column("data"))], pa.binary())], ["doc", "packed"])

    return map_batches(docs.select("doc", "data"), work, "doc long, packed binary", 300)


def _unpacked(column) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def contexts(docs: DataFrame, spots: DataFrame, length: int) -> DataFrame:
    """(digit, doc, first, bytes): the bytes of all windows of each minimiser."""
    lists = spots.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("spot", "digit"))).alias("spots"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digit, doc, first, held = [], [], [], []
        for i, data, spots in zip(batch.column("doc").to_pylist(), _unpacked(batch.column("packed")), batch.column("spots").to_pylist(), strict=True):
            for x in spots:
                at, back, more = x["spot"] >> 20, x["spot"] >> 10 & 1023, x["spot"] & 1023
                digit.append(x["digit"])
                doc.append(i)
                first.append(at - back)
                held.append(data[at - back : at - back + more + length])
        return pa.RecordBatch.from_arrays([pa.array(digit, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(held, pa.binary())], ["digit", "doc", "first", "held"])

    return map_batches(_packed(docs).join(lists, "doc"), work, "digit long, doc long, first long, held binary", 200)


def _windows(held: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hash, row, place in the bytes) of all windows of some contexts."""
    data = np.frombuffer(b"".join(held), np.uint8)
    size = np.array([len(x) for x in held], np.int64)
    begin = np.cumsum(size) - size
    n = size - length + 1
    row = np.repeat(np.arange(len(held)), n)
    place = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return data, hashes(data, length)[place], row, place


def equals(data: np.ndarray, h: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Of windows in order, for each the first that is equal to it, by the hash and then by every byte."""
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    head = np.empty(len(h), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    late = np.flatnonzero(head != np.arange(len(h)))
    if not len(late):
        return head
    # windows one behind the other whose heads are so too share their bytes: each run is compared once
    a, b = place[late], place[head[late]]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)]))
    size = np.diff(np.append(start, len(late))) + length - 1
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    wrong = np.logical_or.reduceat(data[np.repeat(a[start], size) + step] != data[np.repeat(b[start], size) + step], first)
    if wrong.any():  # different strings of one hash
        odd = np.isin(h, h[late[np.repeat(wrong, size - length + 1)]])
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(odd).tolist():
            head[i] = seen.setdefault(data[place[i] : place[i] + length].tobytes(), i)
    return head


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows to remove, as the (doc, start, stop) of runs of bytes."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)]) if len(doc) else np.empty(0, bool)
    at = np.flatnonzero(new)
    stop = start[np.append(at[1:], len(doc)) - 1] + length if len(doc) else start
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(start[at]), pa.array(stop)], ["doc", "start", "stop"])


RUNS = "doc long, start long, stop long"


def settle(rows: DataFrame, length: int) -> DataFrame:
    """Runs of the windows that are not the first of their equals; rows come by digit, in the order of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        # the first windows of a digit that goes on, and the bytes of their contexts
        of, seen, seen_at, seen_in = None, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)

        def solve(part: pa.Table) -> pa.RecordBatch:
            nonlocal of, seen, seen_at, seen_in
            digit, doc, first = (part.column(i).to_numpy() for i in range(3))
            fresh = np.concatenate([[True], (digit[1:] != digit[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])])
            part, digit, doc, first = part.filter(pa.array(fresh)), digit[fresh], doc[fresh], first[fresh]
            texts = part.column(3).to_pylist()
            data, h, row, place = _windows(texts, length)
            with np.errstate(over="ignore"):
                h = h ^ digit.view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15)
            goes_on = of is not None and of == digit[0]
            if not goes_on:
                seen, seen_at, seen_in = seen[:0], seen_at[:0], seen_in[:0]
            old = len(seen)
            head = equals(np.concatenate([seen_in, data]), np.concatenate([seen, h]), np.concatenate([seen_at, place + len(seen_in)]), length)
            late = head[old:] != np.arange(old, old + len(h))
            last = np.flatnonzero((digit[row] == digit[-1]) & ~late)
            if not (goes_on and digit[0] == digit[-1]):
                seen, seen_at, seen_in = seen[:0], seen_at[:0], seen_in[:0]
            of = digit[-1]
            rows, back = np.unique(row[last], return_inverse=True)
            kept = [texts[i] for i in rows.tolist()]
            width = np.array([len(x) for x in texts], np.int64)
            moved = np.cumsum(width[rows]) - width[rows] + len(seen_in)
            begin = (np.cumsum(width) - width)[rows]
            seen, seen_at = np.concatenate([seen, h[last]]), np.concatenate([seen_at, place[last] - begin[back] + moved[back]])
            seen_in = np.concatenate([seen_in, np.frombuffer(b"".join(kept), np.uint8)])
            at = place - (np.cumsum(width) - width)[row]
            return _runs(doc[row[late]], (first[row] + at)[late], length)

        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                held.append(batch := whole.slice(start, 2000))
                size += batch.nbytes
                if size > CHUNK:
                    yield solve(pa.Table.from_batches(held))
                    held, size = [], 0
        if sum(b.num_rows for b in held):
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("digit").sortWithinPartitions("digit", "doc", "first").mapInArrow(run, RUNS)


def settle_hot(rows: DataFrame, length: int) -> DataFrame:
    """The same for digits with any number of rows: every window is dealt out by its own 128-bit hash.

    Places are combined before the shuffle, and what is joined back is keyed by
    place, which is unique, so equal windows never gather in one task.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, first = batch.column("doc").to_numpy(), batch.column("first").to_numpy()
        a, b, ids, starts = [], [], [], []
        for d, f, held in zip(doc, first, batch.column("held").to_pylist(), strict=True):
            n = len(held) - length + 1
            wide = np.array([xxhash.xxh3_128_digest(held[i : i + length]) for i in range(n)], "V16").view("<u8").reshape(n, 2)
            a.append(wide[:, 0])
            b.append(wide[:, 1])
            ids.append(np.full(n, d))
            starts.append(f + np.arange(n))
        columns = [np.concatenate(x) for x in (a, b, ids, starts)]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64)) for x in columns], ["a", "b", "doc", "start"])

    windows = staged(map_batches(rows, work, "a long, b long, doc long, start long"))
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "start")).alias("first")).select("first.doc", "first.start")
    return windows.join(first, ["doc", "start"], "left_anti").select("doc", "start", (F.col("start") + length).alias("stop"))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with `doc` (a number in the order of the ids) and `data`, and the (doc, digest, n) of its documents."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    light = docs.select("doc_id", F.sha2(data, 256).alias("digest"), F.length(data).cast("long").alias("n")).distinct()
    light = staged(light)
    odd = light.agg(F.count("*") - F.countDistinct("doc_id")).first()[0]
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if not odd and whole:
        return docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), data.alias("data")), light.select(F.col("doc_id").cast("long").alias("doc"), "digest", "n")
    spark = docs.sparkSession
    ordered = light.orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    index = staged(spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), f"doc_id {light.schema['doc_id'].dataType.simpleString()}, digest string, n long, doc long"))
    keyed = docs.select("doc_id", data.alias("data"), F.sha2(data, 256).alias("digest")).alias("d").join(index.alias("i"), F.expr("d.doc_id <=> i.doc_id AND d.digest = i.digest"))
    return keyed.select("d.doc_id", "i.doc", "d.data"), index.select("doc", "digest", "n")


def repeats(docs: DataFrame, documents: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """(doc, start, stop) of bytes to remove; runs may overlap."""
    # every document but the first of its digest; joined by document, so that a text with many copies is no one task's
    long = documents.where(F.col("n") >= length)
    firsts = long.groupBy("digest").agg(F.min("doc").alias("doc")).select("doc")
    copies = staged(long.join(firsts, "doc", "left_anti").select("doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))
    spots = staged(repeated(digits(docs, length)))
    spots = spots.join(copies.select("doc"), "doc", "left_anti")
    many = staged(spots.groupBy("digit").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("digit"))
    out = copies
    if many.isEmpty():
        return out.unionByName(staged(settle(contexts(docs, spots, length), length)))
    out = out.unionByName(staged(settle(contexts(docs, spots.join(many, "digit", "left_anti"), length), length)))
    return out.unionByName(settle_hot(contexts(docs, spots.join(many, "digit", "left_semi"), length), length))


def dedup(docs: DataFrame, length: int = 100, hot: int = HOT, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept (binary)] of each row."""
    if not DIGIT <= length <= 1000:
        raise ValueError("length must be 16 to 1,000 bytes")
    named, documents = numbered(docs)
    runs = repeats(named, documents, length, hot)
    lists = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), pa.array([press(x) for x in _bytes(batch.column("data"))], pa.binary())], ["doc_id", "doc", "packed"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, runs in zip(_unpacked(batch.column("packed")), batch.column("runs").to_pylist(), strict=True):
            kept, place, spans, end = [], 0, 0, -1
            for x in runs or ():
                if x["start"] > end:
                    kept.append(data[place : x["start"]])
                    spans += 1
                end = max(end, x["stop"])
                place = end
            kept.append(data[place:])
            left = b"".join(kept)
            rows.append((len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * text
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text else [])])

    packed = map_batches(named, pack, f"doc_id {kind}, doc long, packed binary")
    return map_batches(packed.join(lists, "doc", "left").select("doc_id", "packed", "runs"), cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text else ""))
