"""Rules that turn tables into findings, and what compares findings.

A finding is severity, rule, subject and evidence (JSON). Rules only filter
and project, so their order costs nothing; `ordered` sorts a report's findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

SEVERITIES = ("critical", "warning", "info")
SCHEMA = "severity string, rule string, subject string, evidence string"


def finding(df: DataFrame, rule: str, severity: Column | str, subject: Column | str, *evidence: str) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    told = F.to_json(F.struct(*evidence)) if evidence else F.lit("{}")
    return df.select(severity.alias("severity"), F.lit(rule).alias("rule"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"), told.alias("evidence"))


def dormant(now: DataFrame, today: str, months: int = 12) -> DataFrame:
    old = X.whole_months(F.col("now"), F.lit(today).cast("date"))
    return finding(now.withColumn("months", old).where(old >= months), "dormant", "warning", F.lit("history"), "months")


def bug_magnets(fixes: DataFrame, tree: DataFrame, min_recent: int = 3, warn_at: int = 5) -> DataFrame:
    hot = fixes.where((F.col("recent") >= min_recent) & ~X.is_test_path("path")).join(tree, "path", "left_semi")
    return finding(hot, "bug_magnets", F.when(F.col("recent") >= warn_at, "warning").otherwise("info"), "path", "recent", "fixes")


def tight_coupling(coupled: DataFrame, min_degree: int = 80, min_revs: int = 5) -> DataFrame:
    tight = coupled.where((F.col("degree") >= min_degree) & (F.col("average_revs") >= min_revs) & ~X.is_test_path("entity") & ~X.is_test_path("coupled"))
    return finding(tight, "tight_coupling", "warning", F.concat_ws(" <> ", "entity", "coupled"), "degree", "average_revs")


def hidden_coupling(coupled: DataFrame, edges: DataFrame, min_degree: int = 60, min_revs: int = 5) -> DataFrame:
    """Coupled pairs with no import edge either way."""
    pair = edges.select(F.least("src", "dst").alias("entity"), F.greatest("src", "dst").alias("coupled")).distinct()
    tight = coupled.where((F.col("degree") >= min_degree) & (F.col("average_revs") >= min_revs)).join(pair, ["entity", "coupled"], "left_anti")
    return finding(tight, "hidden_coupling", "info", F.concat_ws(" <> ", "entity", "coupled"), "degree")


def knowledge_islands(islands: DataFrame, area: DataFrame, min_fraction: float = 0.01) -> DataFrame:
    total = area.agg(F.sum("lines").alias("all"))
    large = islands.join(F.broadcast(total), F.col("lines") >= F.lit(min_fraction) * F.col("all"))
    return finding(large, "knowledge_islands", "info", "area", "owner", "share")


def tangled_commits(found: DataFrame, commits: DataFrame, min_share: float = 0.02, min_count: int = 5) -> DataFrame:
    counts = found.agg(F.count("*").alias("tangled")).join(commits.agg(F.count("*").alias("commits")), how="cross")
    return finding(counts.where((F.col("tangled") >= min_count) & (F.col("tangled") >= F.lit(min_share) * F.col("commits"))), "tangled_commits", "info", F.lit("history"), "tangled", "commits")


def bus_factor(owned: DataFrame, threshold: float = 0.7, min_lines: int = 200) -> DataFrame:
    each = owned.groupBy("person").agg(F.sum("added").alias("lines"))
    best = each.agg(F.max_by("person", F.struct("lines", "person")).alias("person"), F.max("lines").alias("lines"), F.sum("lines").alias("all"))
    return finding(best.where((F.col("all") >= min_lines) & (F.col("lines") > F.lit(threshold) * F.col("all"))), "bus_factor", "warning", "person", "lines", "all")


def placeholder_identity(people: DataFrame, min_share: float = 0.01) -> DataFrame:
    """Addresses that no one has with a share of the commits (email, commits)."""
    total = people.agg(F.sum("commits").alias("all"))
    named = people.where(F.lower("email").rlike(X.PLACEHOLDER_EMAIL)).join(F.broadcast(total), F.col("commits") >= F.lit(min_share) * F.col("all"))
    return finding(named, "placeholder_identity", "info", "email", "commits")


def credential_files(tree: DataFrame) -> DataFrame:
    return finding(tree.where(X.path_kinds("path")["credential"]), "credential_files", "critical", "path")


def brain_methods(functions: DataFrame, min_ccn: int = 15, min_lines: int = 100) -> DataFrame:
    return finding(functions.where((F.col("ccn") >= min_ccn) & (F.col("nloc") >= min_lines)), "brain_methods", "warning", F.concat_ws(":", "file", "function"), "ccn", "nloc")


def complexity_growth(grown: DataFrame, floor: float = 25.0, min_growers: int = 3) -> DataFrame:
    """One finding if enough of the hotspots (path, before, after) grew by `floor` percent."""
    some = grown.where(F.col("after") >= (1 + F.lit(floor) / 100) * F.col("before")).agg(F.count("*").alias("growers"), F.sort_array(F.collect_list("path")).alias("paths"))
    return finding(some.where(F.col("growers") >= min_growers), "complexity_growth", "warning", F.lit("hotspots"), "growers", "paths")


def debt_in_hotspots(debt: DataFrame, min_markers: int = 3, min_files: int = 2) -> DataFrame:
    held = debt.agg(F.count("*").alias("files"), F.max("markers").alias("most"))
    return finding(held.where((F.col("most") >= min_markers) | (F.col("files") >= min_files)), "debt_in_hotspots", "info", F.lit("hotspots"), "files", "most")


def hardcoded_addresses(found: DataFrame, key: str) -> DataFrame:
    return finding(found, "hardcoded_addresses", "info", F.concat_ws(":", F.col(key).cast("string"), "address"), "n")


def secrets(groups: DataFrame) -> DataFrame:
    real = groups.where(~F.col("test_only") & ~F.col("local_only"))
    return finding(real, "secrets_found", F.when(F.col("at_head") & (F.col("confidence") == "high"), "critical").otherwise("warning"), "value", "places", "commits")


def vulnerable(packages: DataFrame) -> DataFrame:
    severity = F.when(F.col("score") >= 9, "critical").when(F.col("score") >= 7, "warning").otherwise("info")
    return finding(packages, "vulnerable_dependencies", severity, F.concat_ws("@", "name", "version"), "score", "advisories", "fixed")


def unpinned_actions(pins: DataFrame, key: str) -> DataFrame:
    return finding(pins.where(~F.col("pinned")), "hygiene_actions", "info", F.concat_ws(" ", key, "uses"))


def sweeping_commits(found: DataFrame) -> DataFrame:
    return finding(found, "sweeping_commits", "info", "hash")


def import_commits(found: DataFrame) -> DataFrame:
    return finding(found, "import_commits", "info", "hash")


def import_cycles(strong: DataFrame) -> DataFrame:
    held = strong.groupBy("root").agg(F.count("*").alias("files"))
    return finding(held, "import_cycles", "warning", "root", "files")


def ordered(findings: DataFrame) -> DataFrame:
    """Severity first, then rule, then subject."""
    return findings.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "rule", "subject")


def tripped(findings: DataFrame, level: str) -> DataFrame:
    """One row, tripped: whether any finding is at `level` or worse."""
    bad = SEVERITIES[: SEVERITIES.index(level) + 1]
    return findings.agg(F.coalesce(F.bool_or(F.col("severity").isin(*bad)), F.lit(False)).alias("tripped"))


def against_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose rule and subject the baseline has not."""
    return findings.join(baseline.select("rule", "subject"), ["rule", "subject"], "left_anti").select(*findings.columns)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """rule, subject, change: new, resolved or persisting."""
    b = before.select("rule", "subject", F.lit(True).alias("was")).distinct()
    a = after.select("rule", "subject", F.lit(True).alias("is")).distinct()
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "resolved").otherwise("persisting")
    return b.join(a, ["rule", "subject"], "full").select("rule", "subject", change.alias("change"))
