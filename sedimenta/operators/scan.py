"""Scanners of text and the tables other scanners hand over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X

# fixed values: phrases that name a licence, the first to match wins
LICENCES = (
    ("Apache-2.0", "apache license, version 2.0"),
    ("MIT", "mit license"),
    ("MIT", "permission is hereby granted, free of charge"),
    ("GPL-3.0", "gnu general public license version 3"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms"),
)
IPV4 = r"(?:^|[^\d.])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?:[^\d.]|$)"
EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
DEBT = r"\b(TODO|FIXME|XXX|HACK)\b"
BIDI = "[‪-‮⁦-⁩]"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, number (from 1), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n"))).select(key, (F.col("pos") + 1).alias("number"), F.col("col").alias("line"))


def _octets(address: Column) -> Column:
    return F.transform(F.split(address, r"\."), lambda x: x.cast("int"))


def is_public_address(address: Column) -> Column:
    """Dotted quads that name a host: octets in range, none of loopback, unspecified, broadcast, netmasks or documentation ranges."""
    o = _octets(address)
    at = lambda i: F.get(o, F.lit(i))
    documentation = ((at(0) == 192) & (at(1) == 0) & (at(2) == 2)) | ((at(0) == 198) & (at(1) == 51) & (at(2) == 100)) | ((at(0) == 203) & (at(1) == 0) & (at(2) == 113))
    return F.forall(o, lambda x: x <= 255) & ~(at(0).isin(0, 127, 255)) & ~documentation


def addresses(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, address, n: public IPv4 literals of texts."""
    found = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(IPV4), F.lit(1))).alias("address"))
    return found.where(is_public_address(F.col("address"))).groupBy(key, "address").agg(F.count("*").alias("n"))


def emails(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(1)))).alias("email"))


def licences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, licence: by the first phrase, in the order of the table, that a text holds."""
    low = F.lower(text)
    named = F.coalesce(*[F.when(F.contains(low, F.lit(phrase)), F.lit(name)) for name, phrase in LICENCES])
    return docs.select(key, named.alias("licence")).where("licence IS NOT NULL")


def debt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, markers: notes of work left undone."""
    return docs.select(key, F.regexp_count(text, F.lit(DEBT)).cast("long").alias("markers")).where("markers > 0")


def trojan_source(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, kind: lines with bidirectional controls or with words of mixed scripts."""
    each = lines(docs, key, text)
    mixed = F.exists(F.regexp_extract_all("line", F.lit(r"([\p{L}_][\p{L}\p{N}_]*)"), F.lit(1)), lambda w: w.rlike("[A-Za-z]") & w.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"))
    return each.select(key, "number", F.when(F.col("line").rlike(BIDI), "bidi").when(mixed, "mixed script").alias("kind")).where("kind IS NOT NULL")


def commented_code(docs: DataFrame, key: str, text: str, share: float = 0.8, least: int = 3) -> DataFrame:
    """key, code_lines: comment blocks of `least` lines or more of which `share` look like statements.

    A block is a run of comment lines; its number is the line's less the count of comment lines before it.
    """
    each = lines(docs, key, text).where(F.col("line").rlike(r"^\s*(#|//)")).withColumn("block", F.col("number") - F.row_number().over(W.partitionBy(key).orderBy("number")))
    code = F.col("line").rlike(r"^\s*(#|//)\s*(return\b|import\b|from\b|if\b.*[:{]|for\b.*[:{]|while\b.*[:{]|def\b|[\w.\[\]]+\s*(=|\+=|-=)\s*\S|[\w.]+\(.*\)\s*;?$|.*[;{}]\s*$)")
    blocks = each.groupBy(key, "block").agg(F.count("*").alias("n"), F.count_if(code).alias("code"))
    return blocks.where((F.col("n") >= least) & (X.ratio(F.col("code"), F.col("n")) >= share)).groupBy(key).agg(F.sum("n").alias("code_lines"))


def secret_groups(rows: DataFrame) -> DataFrame:
    """value, rule, files, commits, places, confidence, at_head, test_only, local_only: sightings of one value together."""
    rank = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("confidence"))
    return rows.groupBy("value").agg(
        F.min_by("rule", F.struct("file", "commit", "line")).alias("rule"), F.sort_array(F.collect_set("file")).alias("files"), F.countDistinct("commit").alias("commits"),
        F.countDistinct(F.struct("file", "line")).alias("places"), F.max_by("confidence", rank).alias("confidence"), F.bool_or("at_head").alias("at_head"), F.bool_and("test_code").alias("test_only"), F.bool_and("local").alias("local_only"),
    )


def vulnerable_packages(scan: DataFrame) -> DataFrame:
    """name, version, ecosystem, source, advisories, ids, score, fixed: one row a package of a nested scan.

    `fixed` is the least version over the installed one, by the numbers in it.
    """
    packages = scan.select(F.explode("results").alias("r")).select(F.col("r.source").alias("source"), F.explode("r.packages").alias("p"))
    each = packages.select("source", "p.name", "p.version", "p.ecosystem", F.explode("p.vulnerabilities").alias("v"))
    higher = F.filter(F.col("v.fixed"), lambda x: X.version_key(x) > X.version_key("version"))
    each = each.withColumn("fix", F.array_min(F.transform(higher, lambda x: F.struct(X.version_key(x).alias("key"), x.alias("text")))))
    return each.groupBy("name", "version", "ecosystem", "source").agg(F.count("*").alias("advisories"), F.sort_array(F.collect_set("v.id")).alias("ids"), F.max("v.score").alias("score"), F.min("fix").alias("fix")).withColumn("fixed", F.col("fix.text")).drop("fix")


def package_url(ecosystem: Column, name: Column, version: Column) -> Column:
    """The purl of a package, by its ecosystem's rule."""
    kind = F.when(ecosystem == "PyPI", "pypi").when(ecosystem == "npm", "npm").when(ecosystem == "Go", "golang").when(ecosystem == "crates.io", "cargo").when(ecosystem == "Maven", "maven").otherwise("generic")
    escaped = F.replace(F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit("/"))
    plain = F.when(kind == "pypi", F.replace(F.lower(escaped), F.lit("_"), F.lit("-"))).otherwise(escaped)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), plain, F.when(version.isNotNull(), F.concat(F.lit("@"), F.url_encode(version))).otherwise(""))


def action_pins(workflows: DataFrame, key: str, text: str) -> DataFrame:
    """key, uses, pinned: actions a workflow runs and whether a whole commit names them."""
    used = lines(workflows, key, text).select(key, F.regexp_extract("line", r"^\s*-?\s*uses:\s*['\"]?([^'\"\s#]+)", 1).alias("uses")).where("uses <> '' AND uses NOT LIKE './%'")
    return used.select(key, "uses", F.col("uses").rlike("@[0-9a-f]{40}$").alias("pinned"))


def imports_of(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, module: modules a Python or JavaScript file imports."""
    python = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)"), F.lit(1))
    script = F.regexp_extract_all(text, F.lit(r"""(?:require\(|from\s+|import\s+)['"]([^'"]+)['"]"""), F.lit(1))
    return files.select(key, F.explode(F.array_distinct(F.when(F.endswith(key, F.lit(".py")), python).otherwise(script))).alias("module"))


def unused_packages(declared: DataFrame, imported: DataFrame) -> DataFrame:
    """Declared packages (name) whose name no import begins with."""
    heads = imported.select(F.lower(F.regexp_replace(F.regexp_extract("module", r"^(@[^/]+/[^/]+|[^./]+)", 1), "_", "-")).alias("name")).distinct()
    return declared.select("name").where(F.lower(F.regexp_replace("name", "_", "-")).isNotNull()).withColumn("low", F.lower(F.regexp_replace("name", "_", "-"))).join(heads.withColumnRenamed("name", "low"), "low", "left_anti").select("name")


def lock_drift(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """manifest, lock, drifted: the nearest lock file at or above each manifest; drifted if the manifest is newer; no row without one.

    Each folder above a manifest is a candidate key, so the search is an equi-join.
    """
    parts = F.split(X.folder("path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    near = manifests.select(F.col("path").alias("manifest"), F.col("time").alias("t"), F.explode(F.array_distinct(above)).alias("folder"))
    held = near.join(locks.select(X.folder("path").alias("folder"), F.col("path").alias("lock"), F.col("time").alias("lt")), "folder")
    return held.groupBy("manifest").agg(F.max_by(F.struct("lock", "t", "lt"), F.struct(F.length("folder"), "lock")).alias("x")).select("manifest", "x.lock", (F.col("x.t") > F.col("x.lt")).alias("drifted"))
