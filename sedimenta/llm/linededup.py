"""Line dedup by site-relative frequency, in DataFrame operations alone.

For each host, the share of its pages that contain a line is the line's count
of pages over the host's page total; lines above the boilerplate ratio go.

Edge cases: a null text has no line and stays null; blank lines are never
dropped; lines are compared without the spaces at their ends; a null host is a
host of its own; repeated rows count as pages each; a document may end up
empty, but no row is dropped; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

#: Pairs of (host, line) up to which the boilerplate lists are broadcast; beyond, a salted shuffle join.
BROADCAST_LINES = 100_000
SALTS = 32


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.05, least: int = 3) -> DataFrame:
    """(site, bad): the keys of each host's boilerplate lines.

    A line is listed if it is on `least` pages of the host and on more than
    `ratio` of them, so a list holds at most (mean lines per page) / ratio keys.
    """
    site = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("site")
    own = pages.select(site, F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: _key(F.trim(x)))).alias("keys"))
    totals = own.groupBy("site").agg(F.count("*").alias("pages"))
    held = own.select("site", F.explode("keys").alias("key")).groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    common = held.join(totals, "site").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return common.groupBy("site").agg(F.collect_list("key").alias("bad"))


def drop_boilerplate(pages: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.05, least: int = 3, counts: bool = False) -> DataFrame:
    """pages with boilerplate lines removed from `text`; counts adds n_lines and n_removed (non-blank lines)."""
    site, bad, salt = fresh(pages, "site", "bad", "salt")
    lists = staged(boilerplate(pages, text, host, ratio, least)).select(F.col("site").alias(site), F.col("bad").alias(bad))
    size = lists.agg(F.sum(F.size(bad)).alias("n")).first().n or 0
    keyed = pages.withColumn(site, F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")))
    if size <= BROADCAST_LINES:
        joined = keyed.join(F.broadcast(lists), site, "left")
    else:
        salted = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, [site, salt], "left")
    lines = _lines(text)
    stays = F.when(F.col(bad).isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(bad), _key(F.trim(x)))), "\n"))
    out = [F.col(c) if c != text else stays.alias(text) for c in pages.columns]
    if counts:
        filled = F.filter(F.coalesce(lines, F.array()), lambda x: F.trim(x) != "")
        gone = F.filter(filled, lambda x: F.coalesce(F.array_contains(F.col(bad), _key(F.trim(x))), F.lit(False)))
        out += [F.size(filled).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed")]
    return joined.select(*out)
