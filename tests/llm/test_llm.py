"""The training-data operators against brute force, on small fixtures and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from sedimenta.llm import bpe, decontaminate, graph, html_extract, linededup, lmscore, quality, queries, simhash, suffix, toxicity, warc

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "Word " * 3000), (6, "Tie tie TIE"), (6, "Tie tie TIE"), (None, "no id at all here"), (8, "naïve café ½ 日本語 x\x85y"), (9, "x" * 20000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with working ones."""
    return spark.createDataFrame([(*r, "src", 7, "k") for r in ODD], "doc_id long, text string, source string, score int, key string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


# 1 --------------------------------------------------------------------------------------------------


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if held[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_base(spark, odd, none):
    for _, text in [*ODD, *documents(spark), (0, "a b c a b c d\na\na\n \n ")]:
        assert quality.base(text or "") == slow_base(text or "")
    got = quality.judge(odd).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got)
    assert quality.judge(none).count() == quality.keep_clean(none).count() == 0


def test_quality_verdict(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality(spark, DATA).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept == (labels[r.doc_id] == 1) for r in rows)
    assert quality.failed_rule("Home | News | About | Contact us today") == "navigation"
    assert quality.failed_rule("We use cookies to improve this site.") == "boilerplate"
    assert quality.failed_rule("A plain sentence of several words ends here.") is None
    assert quality.clean("Good words stand in this line.\nHome | News | About\n")[:2] == ("Good words stand in this line.\n", 1)


# 2 --------------------------------------------------------------------------------------------------


def slow_print(text, n=4):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark):
    docs = documents(spark) + [(1000 + i, t) for i, t in [(0, None), (1, ""), (2, "one two"), (3, "one two")]]
    prints = {i: slow_print(t or "") for i, t in docs}
    ids = sorted(prints)
    want = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.groups(df).select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id").collect()}
    assert got == {i: (prints[i], want[i]) for i in ids}


def test_ball_links_are_complete(spark, monkeypatch):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in draw.choice(64, draw.integers(0, 6), replace=False)) for b in base for _ in range(4)]
    values = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    want = roots(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for most in (simhash.UNFOLD, 3000):  # the second unfolds by further bits
        monkeypatch.setattr(simhash, "UNFOLD", most)
        lone = {v: v for v in values}
        got = lone | {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
        assert {i: want[i] for i in values} == {i: roots(values, got.items())[i] for i in values}


def test_near_groups(spark, odd, none):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts = []
    for i in range(30):
        words = [word() for _ in range(300)]
        texts.append((i, " ".join(words)))
        for k in range(3):
            edited = list(words)
            for _ in range(k):
                edited[draw.randrange(300)] = word()
            texts.append((100 + 3 * i + k, " ".join(edited)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    want = roots([i for i, _ in texts], [(a, b) for k, (a, s) in enumerate(texts) for b, t in texts[k + 1 :] if simhash.similarity(s, t) >= 0.8])
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(want[got[i]] == want[i] for i in want)
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "8", "9", "None"]
    assert simhash.keep_first(none).count() == simhash.groups(none).count() == 0


def test_near_groups_of_a_template(spark):
    """Texts just under 0.8 alike, with near copies among them: no failed pair hides one that holds."""
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    word = lambda: vocabulary[min(draw.randrange(60), draw.randrange(60))]
    template, texts = [word() for _ in range(300)], []
    for _ in range(60):
        member = list(template)
        for at in draw.sample(range(0, 300, 10), 5):
            member[at] = word()
        again = list(member)
        again[draw.randrange(300)] = word()
        texts += [" ".join(member), " ".join(again)]
    draw.shuffle(texts)
    texts = list(enumerate(texts))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    held = simhash._near_prints(df, 5).collect()
    shared = Counter(m for r in held for m in enumerate(r.marks))
    keys = {r.doc_id: [p ^ m for p in r.prints for m in [x for i, x in enumerate(r.marks) if shared[i, x] > 1]] for r in held}
    meet = lambda a, b: any(((x ^ y) & (2**64 - 1)).bit_count() <= 4 for x in keys[a] for y in keys[b])
    close = [(a, b) for k, (a, s) in enumerate(texts) for b, t in texts[k + 1 :] if meet(a, b) and simhash.similarity(s, t) >= 0.8]
    want = roots([i for i, _ in texts], close)
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()} == want


def test_crossing_pairs(spark, monkeypatch):
    draw = np.random.default_rng(8)
    base = draw.integers(0, 2**63, 20, dtype=np.uint64)
    values = sorted({int(b) ^ sum(1 << int(i) for i in draw.choice(64, draw.integers(0, 4), replace=False)) for b in base for _ in range(8)})
    values = [x - (1 << 64) if x >> 63 else x for x in values]
    of = {v: int(draw.integers(0, 3)) for v in values}  # 0 is like none
    want = sorted(tuple(sorted((a, b))) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and (of[a] != of[b] or not of[a]))
    df = spark.createDataFrame(list(of.items()), "fp long, root long")
    for most in (simhash.UNFOLD, 3000):
        monkeypatch.setattr(simhash, "UNFOLD", most)
        assert sorted(tuple(sorted(r)) for r in simhash.links(df).collect()) == want


# 3 --------------------------------------------------------------------------------------------------


def test_line_dedup(spark, odd, none):
    pages = [(i, f"Menu bar\n unique {i}\n\nfooter{i % 2}", "h1") for i in range(20)] + [(50 + i, f"Menu bar\nother {i}", None if i < 3 else "h2") for i in range(6)]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string").withColumn("site", F.lit("clash")).withColumn("bad", F.lit(1))
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(df, ratio=0.6).collect()}
    assert got[0] == " unique 0\n\nfooter0" and got[51] == "other 1" and got[54] == "other 4"
    want = {r.doc_id: (r.text, r.n_removed) for r in linededup.drop_boilerplate(df, ratio=0.3, counts=True).collect()}
    assert want[0] == (" unique 0\n", 2)
    out = linededup.drop_boilerplate(odd, least=1, ratio=2.0)
    assert out.columns == odd.columns and sorted(map(str, (r.text for r in out.collect()))) == sorted(str(t) for _, t in ODD)
    assert linededup.drop_boilerplate(none).count() == 0


def test_line_dedup_by_salted_join(spark, monkeypatch):
    pages = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(map(str, linededup.drop_boilerplate(pages).select("doc_id", "text").collect()))
    monkeypatch.setattr(linededup, "BROADCAST_LINES", -1)
    assert sorted(map(str, linededup.drop_boilerplate(pages).select("doc_id", "text").collect())) == want


# 4 --------------------------------------------------------------------------------------------------


def slow_align(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(0, table[i][j] + (2 if x == y else -1), table[i][j + 1] - 1, table[i + 1][j] - 1)
    return max(map(max, table)) / (2 * len(a))


def test_alignment():
    draw = random.Random(1)
    for _ in range(60):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(1, 14))] for _ in range(2))
        assert decontaminate.align(np.array(a), np.array(b)) == pytest.approx(slow_align(a, b))


def test_decontamination(spark, odd, none, monkeypatch):
    items = [(i, " ".join(f"{w}{i}" for w in "the quick brown fox jumps over many lazy dogs near river banks".split())) for i in range(6)] + [(9, "two words"), (10, None), (11, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = items[2][1].split()
    edited = " ".join("changed" if k in (3, 8) else w for k, w in enumerate(words))
    docs = [(1, "clean text that shares nothing"), (2, "before " + items[0][1].upper() + " after"), (3, "x y " + edited + " z"), (4, "say two words now"), (5, None), (6, "two of words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(2, 0), (3, 2), (4, 9)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.keep_clean(df, bench).collect()} == {1, 5, 6}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)  # several blocks
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert decontaminate.keep_clean(odd, bench).count() == len(ODD)
    assert decontaminate.contaminated(none, bench).count() == decontaminate.contaminated(df, bench.limit(0)).count() == 0


# 5 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [5, bpe.HEAD])
def test_bpe(spark, odd, none, head):
    path = public_tokenizers.path(queries.RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    docs = spark.createDataFrame([*ODD, *documents(spark), (77, "<|endoftext|> it's  \n\n x\x1cy")], "doc_id long, text string")
    got = bpe.encode(docs, path, public_tokenizers.PATTERN, head, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode(spark.createDataFrame(got[:20]), path)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


def test_fold_equals_merge(spark):
    ranks = bpe.load_ranks(public_tokenizers.path(queries.RANKS))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = bpe.dictionary(docs, ranks, public_tokenizers.PATTERN, 4000).collect()
    assert len(words) > 1000 and all(r.ids == bpe.merge(r.word.encode(), ranks) for r in words)


# 6 --------------------------------------------------------------------------------------------------


def test_lm_scores(spark, none):
    docs = documents(spark) + [(9000, None), (9001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = queries.remainder("doc_id", 5) == 1
    got = {r.doc_id: r for r in lmscore.score(df, ~held, head=50).collect()}
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    counts = Counter(x for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        own, r = tokens(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(x in counts for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own))
        assert r.score <= 0
    out = [r for i, r in got.items() if zlib.crc32(str(i).encode()) % 5 == 1]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lmscore.score(none, ~held).count() == 0
    assert all(r.score == r.base_score == 0 for r in lmscore.score(df, F.lit(False)).collect())


def test_lm_learns_pairs_seen_once(spark):
    docs = [(1, "a b c d"), (2, "a b e f"), (3, "g d"), (4, "b c")]
    got = {r.doc_id: r.score for r in lmscore.score(spark.createDataFrame(docs, "doc_id long, text string"), F.lit(True)).collect()}
    texts = {i: [*t.split(), None] for i, t in docs}
    words = Counter(w for t in texts.values() for w in t)
    pairs = Counter(p for t in texts.values() for p in zip(["start", *t[:-1]], t, strict=True))
    for i, t in texts.items():
        want = 0.0
        for h, w in zip(["start", *t[:-1]], t, strict=True):
            total = len(docs) if h == "start" else words[h]
            mass = sum(n - 0.75 for (x, _), n in pairs.items() if x == h)
            word = (words[w] + 0.5) / (words.total() + 0.5 * (len(words) + 1))
            want += math.log10((pairs[h, w] - 0.75 + (0.5 + total - mass) * word) / (total + 0.5))
        assert got[i] == pytest.approx(want)


def exact_scores(docs):
    """log10 of texts under interpolated bigrams with exact counts."""
    texts = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for i, t in docs}
    words = Counter(w for t in texts.values() for w in t)
    pairs = Counter(p for t in texts.values() for p in zip(["start", *t[:-1]], t, strict=True))
    kinds = Counter(h for h, _ in pairs)
    scale, n = sum(words.values()) + 0.5 * (len(words) + 1), len(docs)
    one = lambda h, w: (pairs[h, w] - 0.75 + (0.5 + 0.75 * kinds[h]) * (words[w] + 0.5) / scale) / ((n if h == "start" else words[h]) + 0.5)
    return {i: sum(math.log10(one(h, w)) for h, w in zip(["start", *t[:-1]], t, strict=True)) for i, t in texts.items()}


def test_lm_scores_are_those_of_exact_counts(spark):
    docs = documents(spark)
    want = exact_scores(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for head in (50, lmscore.HEAD):
        rows = {r.doc_id: r for r in lmscore.score(df, F.lit(True), head=head).collect()}
        off = {i: abs(rows[i].score - want[i]) for i in want}
        assert all(off[i] <= 0.1 * rows[i].n_tokens + 0.1 for i in want)  # a step of a quarter, in the pair's and in the history's count
        assert sum(off[i] / (1 + abs(want[i])) for i in want) < 0.01 * len(want)


def test_lm_blocks_agree(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    held = queries.remainder("doc_id", 5) == 1
    one = {r.doc_id: r.score for r in lmscore.score(df, ~held).collect()}
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 4000)
    assert len(lmscore.Model(df.where(~held)).blocks) >= 16
    many = {r.doc_id: r.score for r in lmscore.score(df, ~held).collect()}
    assert many == pytest.approx(one, rel=1e-9)


def test_lm_of_odd_rows(spark, odd):
    got = lmscore.score(odd.withColumn("row", F.lit(1)).withColumn("n", F.lit(1)), F.lit(True))
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    assert len(rows) == len(ODD)
    want = exact_scores(list(enumerate(t for _, t in ODD)))
    assert sorted(r.score for r in rows) == pytest.approx(sorted(want.values()), rel=0.1, abs=0.2)
    assert {r.n_tokens for r in rows if r.doc_id == 5} == {3001} and len({(r.base_score, r.score) for r in rows if r.doc_id == 6}) == 1


def test_filter_reads_counts_back():
    draw = np.random.default_rng(1)
    items, n = np.sort(draw.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)), draw.integers(1, 5000, 5000)
    bucket = lmscore.bucket_of(items, 7)
    held = lmscore.Filter([lmscore.build(items[bucket == i], n[bucket == i]).tobytes() for i in range(7)], 7)
    got = held.count(items)
    assert (np.abs(got - n) <= 0.25 * n + 1).mean() > 0.98
    assert (held.count(draw.integers(0, 2**63, 5000, dtype=np.uint64)) == 0).mean() > 0.98
    assert np.bitwise_count(held.bits).sum() / (8 * len(held.bits)) < 0.43  # ten bits an entry and five probes set about 0.39
    assert not lmscore.Filter([b""] * 7, 7).count(items).any()


# 7 --------------------------------------------------------------------------------------------------


def slow_suffix(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_of_whole_texts(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, DATA).collect()}
    assert got == slow_suffix(docs)
    hot = suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string"), hot=5).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in hot} == got


def test_equal_hashes_are_compared_by_bytes():
    draw = np.random.default_rng(2)
    data = np.concatenate([draw.integers(0, 3, 400, dtype=np.uint8), np.tile(draw.integers(0, 9, 60, dtype=np.uint8), 4)])
    place = np.arange(len(data) - 20)
    for h in (np.zeros(len(place), np.uint64), (data[place] % 2).astype(np.uint64), suffix.hashes(data, 20)[place]):
        seen = {}
        want = [seen.setdefault(data[i : i + 20].tobytes(), i) for i in place.tolist()]
        assert suffix.equals(data, h, place, 20).tolist() == want


@pytest.mark.parametrize("hot", [3, suffix.HOT])
def test_suffix_dedup(spark, hot):
    draw = random.Random(3)
    noise = lambda n: "".join(draw.choice("abc ") for _ in range(n))
    passage = noise(400)
    docs = [(i, noise(draw.randrange(200)) + passage[draw.randrange(150) : draw.randrange(250, 400)] + noise(120)) for i in range(40)]
    docs += [(100, "a" * 1000), (101, "ab" * 300), (102, "a" * 99), (103, "a" * 100), (104, None), (105, ""), (106, "x" * 61000 + "yz" * 80), (107, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.dedup(df, hot=hot).collect()}
    assert got == slow_suffix(docs)


def test_suffix_dedup_of_odd_rows(spark, odd, none):
    assert suffix.dedup(none).count() == 0
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in suffix.dedup(odd.withColumn("doc", F.lit(1)).withColumn("data", F.lit("x"))).collect())
    ids = {i: k for k, i in enumerate(sorted({i or 99 for i, _ in ODD}))}
    want = slow_suffix([(ids[i or 99], t) for i, t in dict(ODD).items()])
    assert got == sorted((i or 99, *want[ids[i or 99]][:2]) for i, _ in ODD)
    two = spark.createDataFrame([(1, "q" * 150 + "r" * 150), (1, "r" * 150), (None, "q" * 150)], "doc_id long, text string")
    assert sum(r.n_removed for r in suffix.dedup(two).collect()) > 0
    with pytest.raises(ValueError):
        suffix.dedup(none, length=2000)


# 8 --------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}\r\nX: y", f"<p>{'common ' * 40}{i % 3}</p>" if i else None) for i in range(30)] + [(40, None, "short"), (41, "u", "short"), (42, "u", "é" * 50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"{warc.shared_folder(spark)}/warc-test-{random.random()}"
    warc.write(df, folder)
    rows = {r.page_id: r for r in warc.read(spark, folder, payload=True).collect()}
    for i, _, html in pages:
        data = (html or "").encode()
        assert rows[i].payload_bytes == len(data) and rows[i].payload_digest == hashlib.sha256(data).hexdigest()
        first = min(k for k, _, h in pages if (h or "") == (html or "")) if len(data) >= 100 else i
        assert (rows[i].record_type, rows[i].refers_to) == (("response", None) if first == i else ("revisit", first))
        assert bytes(rows[i].payload) == (data if first == i else b"")
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_damage():
    good = warc.record(1, "u", b"payload", None)
    assert warc.read_record(good)["payload"] == b"payload"
    for bad in (good.replace(b"WARC/1.1", b"HTTP/1.1"), good[:-1], good.replace(b"payload", b"pay1oad"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.read_record(bad)
    import zstandard

    frame = zstandard.ZstdCompressor().compress(good)
    assert list(warc.frames(warc.skippable(b"") + frame + frame)) == [good, good]
    for bad in (frame[:-3], b"junk" + frame, warc.skippable(b"no dictionary") + frame):
        with pytest.raises(ValueError):
            list(warc.frames(bad))


# 9 --------------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, none):
    draw = random.Random(4)
    calm = lambda: " ".join(draw.choice("calm words stand here and there for many days under old trees".split()) for _ in range(8)) + "."
    rows = [(f"{calm()} {calm()} {calm()}", 0) for _ in range(80)] + [(f"{calm()} {calm()} A {w} thing.", 1) for w in ["rotten", "vile"] * 20]
    model = toxicity.fit(rows)
    score = model.scorer()
    p, parts, each = score("Calm words stand here. A vile thing. More calm words.")
    assert p >= 0.7 and parts[int(np.argmax(each))] == "A vile thing."
    assert score("Calm words stand here.")[0] < 0.3 and 0 <= score("")[0] <= 1
    held = toxicity.score(odd, model).collect()
    assert len(held) == len(ODD) and all(0 <= r.score <= 1 for r in held)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit([]).scorer()("x")[0] < 0.01 and toxicity.fit([("a", 1)]).scorer()("x")[0] <= 1


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op9_toxicity(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    assert sum(p == y for p, y in out) >= 0.93 * len(out)
    assert sum(p and not y for p, y in out) <= 1


# 10 -------------------------------------------------------------------------------------------------


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><header class=site>Site <a href=/>home</a></header><nav><ul><li><a href=x>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies on this page</div><div id=content><h1>Title &amp; more</h1><p>First <b>bold</b>\n words   here&nbsp;now.<p>Second para with <a href=y>a link</a> in it."
        "<div class=ad>Buy this great thing today</div><ul><li>one item</li><li>two items</li></ul><form>Mail <input><button>Go</button></form><p>Last.</p></div>"
        "<div id=comments><p>A reader says something long about all of it.</p></div><aside>Related things</aside><footer>&copy; 2020 words</footer></body></html>"
    )
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    weights = html_extract.train(rows)
    want = "Title & more\nFirst bold words here now.\nSecond para with a link in it.\none item\ntwo items\nLast."
    assert html_extract.extract(page, weights) == want
    assert html_extract.extract(page.replace("div id=content", "article").replace("<p>Last.</p></div>", "<p>Last.</p></article>"), weights) == want
    for text, out in (("", ""), ("<p", ""), ("plain words only", "plain words only"), ("<!-- open", ""), ("<p>1 < 2 and 3 > 2 is so</p>", "1 < 2 and 3 > 2 is so"), ("<nav>x <a>y</a>", ""), ("<article><p>half a &am", "half a &am")):
        assert html_extract.extract(text, weights) == out
    assert html_extract.main_text(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string"), weights).first().text == ""


def test_html_of_unclosed_elements(spark):
    weights = html_extract.learn([])
    page = "<article><p>Some words stand before it.</p>{}<p>More words stand behind it.</p></article>"
    both = "Some words stand before it.\nMore words stand behind it."
    for name in ("svg", "select", "canvas", "object", "math"):
        assert html_extract.extract(page.format(f"<{name}>"), weights) == both
    for name in ("script", "style", "title", "textarea"):
        assert html_extract.extract(page.format(f"<{name}>"), weights) == "Some words stand before it."
    assert html_extract.extract(page.format("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object>a fallback</object> hold.</p>"), weights).split("\n")[1] == "So x=2 and a fallback hold."


def test_html_of_all_pages(spark):
    got = {r.page_id: r.text for r in queries.op10_html(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1].replace("<br>", " ")
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


# pipeline -------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.count() <= docs.count() and {"doc_id", "ids"} <= set(out.columns)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
