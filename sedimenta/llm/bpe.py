"""Byte-level BPE encoding and decoding.

Distinct words of the corpus are encoded by Spark higher-order functions: an
`aggregate` folds ranked merges over the array of a word's bytes, looking pairs
up in a literal rank map. The HEAD most frequent words, a documented bound,
become the dictionary by which workers encode whole texts; the words beyond it
go through the same ranked merges in the worker. Decoding concatenates the ids'
binary pieces.

Bytes stand in Spark strings as the 256 characters of ISO-8859-1, so that they
can be keys of a map. The map is an array of SLOTS small maps, found by the
pair's hash: a look-up in one large map would scan it.

Edge cases: a null text is empty; an empty text has no ids; words longer than
LONG bytes are merged with a heap, in n log n; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import commonest, fresh, map_batches, staged, texts

#: Words whose encodings are broadcast, and the bytes a word has at most to be among them.
HEAD = 262_144
LONG = 64
SLOTS = 65_536
#: White space as the pattern's \s means it, spelt out for Java.
SPACES = r"\t-\r \x85\xA0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")


class Ranks:
    """The rank map as a literal for Spark."""

    def __init__(self, ranks: dict[bytes, int]):
        slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
        for piece, rank in ranks.items():
            key = piece.decode("latin-1")
            slots[xxhash.xxh64_intdigest(key.encode(), 42) % SLOTS][key] = rank
        self.literal = F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")

    @staticmethod
    def of(ranks: Column, piece: Column) -> Column:
        """The rank of a piece, or null."""
        return F.try_element_at(F.get(ranks, F.pmod(F.xxhash64(piece), F.lit(SLOTS)).cast("int")), piece)

    def fold(self, word: Column) -> Column:
        """ids of a word by ranked merges: the leftmost pair of least rank is joined until no pair has a rank."""
        # a lambda over the one literal names it, so that the plan holds it once
        return F.get(F.transform(F.array(self.literal), lambda ranks: self._fold(ranks, word)), F.lit(0))

    def _fold(self, ranks: Column, word: Column) -> Column:
        raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
        start = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.substring(raw, i, F.lit(1)))

        def ranked(pieces: Column) -> Column:
            n = F.size(pieces) - 1
            return F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), lambda a, b: self.of(ranks, F.concat(a, b)))

        def join(pieces: Column, rank: Column) -> Column:
            at = F.array_position(rank, F.array_min(rank)).cast("int")
            pair = F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at)))
            return F.when(F.array_min(rank).isNull(), pieces).otherwise(F.concat(F.slice(pieces, F.lit(1), at - 1), pair, F.slice(pieces, at + 2, F.size(pieces))))

        def step(state: Column, _: Column) -> Column:
            pieces = state["pieces"]
            # so does an aggregate over the one array of a step's ranks, which is then worked out once
            merged = F.aggregate(F.array(ranked(pieces)), pieces, join)
            after = F.aggregate(F.array(merged), F.struct(pieces.alias("pieces"), F.lit(False).alias("more")), lambda s, m: F.struct(m.alias("pieces"), (F.size(m) < F.size(s["pieces"])).alias("more")))
            return F.when(state["more"], after).otherwise(state)

        folded = F.aggregate(F.array_repeat(F.lit(0), F.length(raw) - 1), F.struct(start.alias("pieces"), F.lit(True).alias("more")), step)["pieces"]
        whole = self.of(ranks, raw)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, lambda piece: self.of(ranks, piece)))


def dictionary(docs: DataFrame, ranks: dict[bytes, int], pattern: str, head: int = HEAD) -> DataFrame:
    """(word, ids): the `head` most frequent words of at most LONG bytes, encoded by the fold.

    Words are counted over all texts; the rest of the vocabulary needs no entry.
    """
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("word")).where(F.octet_length("word") <= LONG)
    top = commonest(staged(found.groupBy("word").agg(F.count("*").alias("n"))), head)
    return top.select("word", Ranks(ranks).fold(F.col("word")).alias("ids"))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one word; the leftmost pair of least rank first, by a heap over a linked list."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, j, size = heapq.heappop(heap)
        if piece[i] is None or after[i] != j or piece[j] is None or len(piece[i]) + len(piece[j]) != size:
            continue
        piece[i], piece[j] = piece[i] + piece[j], None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i] + piece[k])) is not None:
                heapq.heappush(heap, (r, i, k, len(piece[i]) + len(piece[k])))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h] + piece[i])) is not None:
            heapq.heappush(heap, (r, h, i, len(piece[h]) + len(piece[i])))
    return [ranks[p] for p in piece if p is not None]


class Codec:
    """Encodes texts to ids as little-endian 32-bit integers, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known: dict[str, bytes], spare: int = 100_000):
        self.ranks, self.known, self.spare = ranks, known, spare
        self.find = regex.compile(pattern).findall
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.extra: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        got = self.extra.get(word)
        if got is None:
            got = np.array(merge(word.encode(), self.ranks), "<u4").tobytes()
            if len(self.extra) >= self.spare:
                self.extra.clear()
            if len(word) <= LONG:
                self.extra[word] = got
        return got

    def encode(self, text: str) -> bytes:
        known, words = self.known, self.find(text)
        got = list(map(known.get, words))
        if None in got:
            got = [x if x is not None else self.word(w) for x, w in zip(got, words, strict=True)]
        return b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def known_words(stream: bytes) -> dict[str, bytes]:
    """The dictionary's words with their ids as little-endian 32-bit integers."""
    out: dict[str, bytes] = {}
    for batch in pa.ipc.open_stream(stream):
        ends = batch.column("ids").offsets.to_numpy() * 4
        flat = batch.column("ids").flatten().to_numpy().astype("<u4").tobytes()
        out.update((w, flat[a:b]) for w, a, b in zip(batch.column("word").to_pylist(), ends[:-1] - ends[0], ends[1:] - ends[0], strict=True))
    return out


def encode(docs: DataFrame, path: str, pattern: str, head: int = HEAD, ids: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_tokens, ids (on demand), ids_sha256 and decoded_sha256 of each row's text."""
    ranks = load_ranks(path)
    words = dictionary(docs, ranks, pattern, head).toArrow()
    stream = pa.BufferOutputStream()
    with pa.ipc.new_stream(stream, words.schema) as out:
        out.write_table(words)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, stream.getvalue().to_pybytes()))
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = state.get("codec") or state.setdefault("codec", Codec(shared.value[0], pattern, known_words(shared.value[1])))
        coded = [codec.encode(t) for t in texts(batch)]
        columns = [batch.column(c) for c in keep] + [pa.array([len(x) // 4 for x in coded], pa.int64())]
        if ids:
            columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())))
        columns += [pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in coded])]
        return pa.RecordBatch.from_arrays(columns, names)

    names = [*keep, *fresh(docs.select(*keep), "n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256")]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep] + ["long", *(["array<int>"] if ids else []), "string", "string"]
    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), work, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)), 500)


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """rows with `decoded` (binary): the pieces of `column`, concatenated.

    Native: ids index a literal array of hexadecimal pieces.
    """
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return rows.withColumn(fresh(rows, "decoded")[0], F.unhex(F.array_join(F.transform(F.coalesce(F.col(column), F.array().cast("array<int>")), lambda i: F.get(literal, i)), "")))
