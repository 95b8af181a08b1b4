"""Quality rules: the verdict of the whole query against the rules said plainly, and odd tables."""

import re
from collections import Counter

from pyspark.sql import functions as F

from sedimenta.llm import quality, queries

DATA = "/root/testdata/sf0.001"


def bad_line(line):
    words = line.split()
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in line)
    separators = sum(w in quality.SEPARATORS for w in words)
    letters = [c for c in line if c.isalpha()]
    most = max(Counter(words).values(), default=0)
    return n > 0 and any(
        [
            n > 1 and symbols / n > 0.25,
            sum(w.endswith("!!") for w in words) / n > 0.3,
            n < 4 and not line.rstrip().endswith(quality.ENDS),
            separators >= 2 and separators / n > 0.15,
            n <= 25 and bool(quality.BOILERPLATE.search(line)),
            len(line) >= 20 and line.upper() == line and line.lower() != line and sum(map(str.isupper, line)) >= 0.7 * len(letters),
            n >= 10 and most / n > 0.4,
        ]
    )


def verdict(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    held = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if held[w] > 1 for j in range(3)}
    if len(words) < 50 or 100 * len(inside) > 50 * len(words):
        return False
    lost = sum(len(x.split()) for x in text.split("\n") if bad_line(x))
    return lost <= 0.5 * sum(len(x.split()) for x in text.split("\n"))


def test_verdicts_of_whole_texts(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r.kept for r in queries.op1_quality(spark, DATA).collect()}
    assert got == {i: verdict(t) for i, t in docs.items()}
    assert 0 < sum(got.values()) < len(got)


def test_kept_rows_lose_their_bad_lines(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("key", F.lit(1)).withColumn("kept", F.lit("x"))
    out = quality.keep_clean(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in out.collect():
        assert r.text == "\n".join(x for x in texts[r.doc_id].split("\n") if not bad_line(x))
