"""Readers of change logs and of the files other tools write about a repository.

A log is records `--hash--time--author--subject` with an optional \\x1f list of
co-authors, each followed by `added<TAB>deleted<TAB>path` lines.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.identity import is_bot

ESCAPE = re.compile(rb"\\([0-7]{3}|[abtnvfr\"\\])")
# fixed values: the escapes of quoted paths
ESCAPES = {b"a": b"\a", b"b": b"\b", b"t": b"\t", b"n": b"\n", b"v": b"\v", b"f": b"\f", b"r": b"\r", b'"': b'"', b"\\": b"\\"}


def unquoted(path: str) -> str:
    """A path with its quotes and its octal and letter escapes undone."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    raw = ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if len(m[1]) == 3 else ESCAPES[m[1]], path[1:-1].encode("utf-8", "surrogateescape"))
    return raw.decode("utf-8", "replace")


def _unquote_series(paths: pd.Series) -> pd.Series:
    return paths.map(unquoted, na_action="ignore")


def unquote(path: Column) -> Column:
    """The column's quoted paths undone; others never leave the JVM's values."""
    return F.when(F.startswith(path, F.lit('"')), F.pandas_udf(_unquote_series, "string")(path)).otherwise(path)


def parse(records: DataFrame) -> DataFrame:
    """commits of records (pos, value): hash, pos, date, time, hour, author, subject, co_authors, files.

    A record's text is the header without its leading dashes and the lines
    under it. Headers split at their first four double dashes, so a subject
    keeps its own. Commits without files stay.
    """
    body = F.split("value", "\n")
    head = F.get(body, F.lit(0))
    part = F.split(head, "--", 4)
    told = F.split(F.get(part, F.lit(3)), "\u001f")
    co = F.transform(F.slice(told, F.lit(2), F.greatest(F.size(told) - 1, F.lit(0))), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([^<]*?)\s*(?:<[^>]*>)?\s*$", 1)).alias("name"), F.regexp_extract(x, r"<([^>]*)>", 1).alias("email")))
    author = F.get(part, F.lit(2))
    named = F.array_distinct(F.transform(F.filter(co, lambda x: (x["name"] != "") & (x["name"] != author) & ~is_bot(x["name"], x["email"])), lambda x: x["name"]))
    rows = F.filter(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))), lambda x: x.rlike("^(\\d+|-)\t(\\d+|-)\t"))
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    files = F.transform(rows, lambda x: F.struct(F.element_at(F.split(x, "\t", 3), 3).alias("raw"), number(F.element_at(F.split(x, "\t", 3), 1)).alias("added"), number(F.element_at(F.split(x, "\t", 3), 2)).alias("deleted")))
    time = F.get(part, F.lit(1))
    return records.select(F.get(part, F.lit(0)).alias("hash"), "pos", F.to_date(F.substring(time, 1, 10)).alias("date"), time.alias("time"), F.substring(time, 12, 2).try_cast("int").alias("hour"), author.alias("author"), F.get(told, F.lit(0)).alias("subject"), named.alias("co_authors"), files.alias("files"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """parse() over log files, cut into records by Spark's own reader, so one file can be read by many tasks.

    `pos` orders records by their place in the file.
    """
    lines = spark.read.option("lineSep", "\n--").text(path)
    return parse(lines.select(F.monotonically_increasing_id().alias("pos"), F.rtrim(F.regexp_replace("value", r"^--", "")).alias("value")).where("value <> ''"))


def changes(commits: DataFrame) -> DataFrame:
    """One row for each commit and file: header, path, old_path, renamed, added, deleted."""
    rows = commits.select("hash", "pos", "date", "author", "subject", F.explode("files").alias("f")).select("*", "f.raw", "f.added", "f.deleted").drop("f")
    path = unquote(F.col("raw"))
    renamed = path.contains(" => ")
    return rows.select("hash", "pos", "date", "author", "subject", F.when(renamed, X.renamed_to(path)).otherwise(path).alias("path"), F.when(renamed, X.renamed_from(path)).alias("old_path"), renamed.alias("renamed"), "added", "deleted")


def people(commits: DataFrame) -> DataFrame:
    """hash, pos, date, people, position, person: the author at position 0."""
    everyone = F.concat(F.array("author"), F.col("co_authors"))
    return commits.select("hash", "pos", "date", F.size(everyone).alias("people"), F.posexplode(everyone).alias("position", "person"))


def reverts(records: DataFrame) -> DataFrame:
    """hash, reverted: commits named by `This reverts commit`, of records (hash, body)."""
    return records.select("hash", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^This reverts commit ([0-9a-f]{7,40})\b"), F.lit(1))).alias("reverted"))


def ignored(spark: SparkSession, *paths: str) -> DataFrame:
    """hash: commits listed in files with # comments."""
    named = spark.read.text(list(paths)).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("hash"))
    return named.where(F.col("hash").rlike("^[0-9a-f]{7,64}$")).distinct()


def tree(spark: SparkSession, path: str) -> DataFrame:
    """path: a listing parted by NUL characters."""
    return spark.read.option("lineSep", "\u0000").text(path).select(F.col("value").alias("path")).where("path <> ''")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """language, path, code, comment, blank, complexity of a line counter's JSON."""
    schema = "Name string, Files array<struct<Location string, Code long, Comment long, Blank long, Complexity long>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("Name").alias("language"), F.explode("Files").alias("f")).select("language", F.col("f.Location").alias("path"), F.col("f.Code").alias("code"), F.col("f.Comment").alias("comment"), F.col("f.Blank").alias("blank"), F.col("f.Complexity").alias("complexity"))


def languages(files: DataFrame) -> DataFrame:
    """language, files, code, comment, blank, complexity, most code first."""
    return files.groupBy("language").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("code", "comment", "blank", "complexity")]).orderBy(F.desc("code"), "language")


def author_log(spark: SparkSession, path: str) -> DataFrame:
    """name, email, commits of `name<TAB>email` lines, most commits first."""
    rows = spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("name"), F.substring_index("value", "\t", -1).alias("email")).where("value LIKE '%\t%'")
    return rows.groupBy("name", "email").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "name", "email")


def functions(spark: SparkSession, path: str) -> DataFrame:
    """file, function, anonymous, ccn, nloc, params, start, stop of a complexity tool's CSV, each once."""
    schema = "nloc long, ccn long, tokens long, params long, length long, location string, file string, function string, long_name string, start long, stop long"
    rows = spark.read.schema(schema).csv(path).dropDuplicates()
    anonymous = F.col("function").isin("", "(anonymous)") | F.col("function").isNull()
    return rows.select("file", F.when(anonymous, F.concat(F.lit("anonymous at "), "start")).otherwise(F.col("function")).alias("function"), anonymous.alias("anonymous"), "ccn", "nloc", "params", "start", "stop").orderBy("file", "start", "stop", "function")


def npm_packages(rows: DataFrame) -> DataFrame:
    """path, name, version, scope of package.json texts (path, text): declared dependencies."""
    both = rows.select("path", *[F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>").alias(k) for k in ("dependencies", "devDependencies")])
    out = None
    for scope in ("dependencies", "devDependencies"):
        one = both.select("path", F.explode(scope).alias("name", "version")).withColumn("scope", F.lit(scope))
        out = one if out is None else out.unionByName(one)
    return out


def go_modules(rows: DataFrame) -> DataFrame:
    """path, name, version of go.mod texts; indirect requirements are left out."""
    line = rows.select("path", F.explode(F.split("text", "\n")).alias("line")).where("line NOT LIKE '%// indirect%'")
    found = line.select("path", F.regexp_extract("line", r"^\s*(?:require\s+)?([\w.\-/~]+\.[\w.\-/~]+)\s+(v\S+)", 1).alias("name"), F.regexp_extract("line", r"^\s*(?:require\s+)?([\w.\-/~]+\.[\w.\-/~]+)\s+(v\S+)", 2).alias("version"))
    return found.where("name <> ''")


def cargo_packages(rows: DataFrame) -> DataFrame:
    """path, name of Cargo.toml texts: keys of [dependencies] and of its target forms."""
    section = F.explode(F.filter(F.split("text", r"(?m)^\s*\["), lambda x: x.rlike(r"^(target\..*\.)?dependencies\]")))
    line = rows.select("path", section.alias("section")).select("path", F.explode(F.split("section", "\n")).alias("line"))
    return line.select("path", F.regexp_extract("line", r"^\s*([A-Za-z0-9_-]+)\s*=", 1).alias("name")).where("name <> ''")


def toml_value(text: Column, table: str, key: str) -> Column:
    """The string under a key of a [table], or null."""
    pattern = rf"(?ms)^\[{re.escape(table)}\]\s*$(?:(?!^\[).)*?^\s*{re.escape(key)}\s*=\s*[\"']([^\"']*)[\"']"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
