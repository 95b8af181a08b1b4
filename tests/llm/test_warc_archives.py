"""WARC archives of some size, and rows that are odd."""

import random
import time

from sedimenta.llm import warc

import zstandard


def test_reading_is_linear():
    draw = random.Random(1)
    press = zstandard.ZstdCompressor(level=1).compress
    frame = [press(warc.record(i, "http://h/", draw.randbytes(2000), None)) for i in range(500)]
    archive = warc.skippable(b"") + b"".join(frame) * 100
    assert len(archive) > 100_000_000
    start = time.perf_counter()
    assert sum(1 for _ in warc.frames(archive)) == 50_000
    assert time.perf_counter() - start < 20


def test_odd_rows(spark):
    same = "<p>" + "same " * 40 + "</p>"
    rows = [("a", "u", same), ("a", "u", same), ("b", None, same), (None, "u", same), (None, None, None), ("c", "u", "x" * 2_000_000), ("d", "u", "tie"), ("d", "u", "tie")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id string, url string, html string, digest string, first int")
    got = sorted((r.page_id or "", r.payload_bytes, r.record_type, r.refers_to or "") for r in warc.round_trip(pages).collect())
    n = len(same)
    assert got == [("", 0, "response", ""), ("", n, "response", ""), ("a", n, "response", ""), ("a", n, "response", ""), ("b", n, "revisit", "a"), ("c", 2_000_000, "response", ""), ("d", 3, "response", ""), ("d", 3, "response", "")]


def test_writing_again_changes_nothing(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>page {i}</p>" * 50) for i in range(200)], "page_id long, url string, html string").repartition(5)
    folder = f"{warc.shared_folder(spark)}/warc-again-{random.random()}"
    held = []
    for _ in range(2):
        warc.write(pages, folder)
        held.append(sorted(tuple(r) for r in spark.read.format("binaryFile").load(folder).selectExpr("substring_index(path, '/', -1) AS name", "sha2(content, 256)").collect()))
    assert held[0] == held[1]
    assert warc.read(spark, folder).count() == 200
