"""Tables of a report: what its sections list, the order they list it in, and the rules over shapes, locks and candidates.

Each takes tables and returns one; ties are broken by names, so that two runs
list the same. Orders are columns to sort by; only a section's first rows are
ever sorted in one place.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import metrics as M
from .rules import finding

# fixed values: floors of what is worth a row, and the names of pip's requirement files
COMPLEX, NESTED, BUMPS, SWALLOWED = 10, 5, 3, 5
CRITICAL_SCORE = 9.0
REQUIREMENT_FILE = r"(^|/)[^/]*(requirements|constraints)[^/]*\.(txt|in)$"
CONFIDENCES = ("high", "medium", "low")


# dates and states of a history ------------------------------------------------------------------------


def since_date(spec: str, today: dt.date) -> dt.date:
    """`2y`, `18m`, `90d` before today, or a date as it is; ValueError for anything else and before 1970."""
    spec = (spec or "").strip().lower()
    if told := re.fullmatch(r"(\d+)([ymd])", spec):
        n, unit = int(told[1]), told[2]
        if unit == "d":
            out = today - dt.timedelta(days=n)
        else:
            year, month = divmod(today.year * 12 + today.month - 1 - n * (12 if unit == "y" else 1), 12)
            out = dt.date(year, month + 1, min(today.day, calendar.monthrange(year, month + 1)[1]))
    else:
        out = dt.date.fromisoformat(spec)
    if out.year < 1970:
        raise ValueError(f"no date before 1970: {spec!r}")
    return out


def as_of(commits: DataFrame, date: str, end_of_day: bool = True) -> DataFrame:
    """One row, hash: the last of commits (hash, time, pos) at the end of a day, or before it begins; null if none."""
    bound = F.lit(date).cast("timestamp")
    before = F.col("time") < F.timestamp_add("DAY", F.lit(1), bound) if end_of_day else F.col("time") <= bound
    return commits.where(before).agg(F.max_by("hash", F.struct("time", "pos")).alias("hash"))


def ref_spread(commits: DataFrame) -> DataFrame:
    """all, head, fix_all, fix_head of commits (subject, on_head)."""
    fix = X.is_fix("subject")
    return commits.agg(F.count("*").alias("all"), F.count_if("on_head").alias("head"), F.count_if(fix).alias("fix_all"), F.count_if(fix & F.col("on_head")).alias("fix_head"))


def unscored(commits: DataFrame, changes: DataFrame, scored: DataFrame) -> DataFrame:
    """commits, fixes, outside, fixes_outside: commits with files of which none is scored (path)."""
    marked = changes.select("hash", "path").join(scored.select("path", F.lit(1).alias("s")), "path", "left").groupBy("hash").agg((F.max("s").isNull()).alias("outside"))
    out = commits.select("hash", X.is_fix("subject").alias("fix")).join(marked, "hash", "left")
    return out.agg(F.count("*").alias("commits"), F.count_if("fix").alias("fixes"), F.count_if(F.col("outside")).alias("outside"), F.count_if(F.col("outside") & F.col("fix")).alias("fixes_outside"))


def merges_by_identity(merges: DataFrame, since: str | None = None) -> DataFrame:
    """name, email, merges of merge commits (date, name, email)."""
    return (merges.where(F.col("date") >= F.lit(since).cast("date")) if since else merges).groupBy("name", "email").agg(F.count("*").alias("merges"))


def commits_walked(lines: DataFrame, history: DataFrame) -> DataFrame:
    """path, walked: commits (time) no older than the oldest that still owns a line (path, time) of a file.

    The history is counted by time first, so the comparison is with distinct times.
    """
    oldest = lines.groupBy("path").agg(F.min("time").alias("oldest"))
    wanted = oldest.select(F.col("oldest").alias("t"), F.lit(0).cast("long").alias("n")).distinct()
    counted = history.groupBy(F.col("time").alias("t")).agg(F.count("*").alias("n")).unionByName(wanted).groupBy("t").agg(F.sum("n").alias("n"))
    ranged = M.cumulated(M.ranked(counted, F.desc("t")), upto="n").select(F.col("t").alias("oldest"), F.col("upto").alias("walked"))
    return oldest.join(ranged, "oldest").select("path", "walked")


# defects traced back -----------------------------------------------------------------------------------


def inducing(blamed: DataFrame) -> DataFrame:
    """fix, commit, date, files: of the commits that lines removed by a fix are blamed to (fix, path, commit, time), the latest; tests don't count."""
    each = blamed.where(~X.is_test_path("path")).groupBy("fix", "commit").agg(F.max("time").alias("time"), F.sort_array(F.collect_set("path")).alias("files"))
    return each.groupBy("fix").agg(F.max_by(F.struct("commit", "time", "files"), F.struct("time", "commit")).alias("x")).select("fix", "x.commit", F.to_date("x.time").alias("date"), "x.files")


def induced_between(fixes: DataFrame, found: DataFrame, start: str, end: str) -> DataFrame:
    """Paths made buggy before `start`, by the fixes (hash, date) that landed in [start, end)."""
    landed = fixes.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))).select(F.col("hash").alias("fix"))
    known = found.where(F.col("date") < F.lit(start).cast("date"))
    return known.join(landed, "fix", "left_semi").select(F.explode("files").alias("path")).where(~X.is_test_path("path")).distinct()


# lists ---------------------------------------------------------------------------------------------------


def why_empty(revs: DataFrame, kinds: DataFrame, min_revs: int = 2) -> DataFrame:
    """reason, files: why files (path, revs) that changed `min_revs` times or more aren't ranked, by their kinds (path, reason)."""
    return revs.where(F.col("revs") >= min_revs).join(kinds, "path", "left").groupBy(F.coalesce("reason", F.lit("ranked")).alias("reason")).agg(F.count("*").alias("files"))


def documents(revs: DataFrame, kinds: DataFrame, k: int = 15, least: int = 2) -> DataFrame:
    """path, revs: the most changed documents."""
    return revs.join(kinds.where("reason = 'doc'").select("path"), "path", "left_semi").where(F.col("revs") >= least).orderBy(F.desc("revs"), "path").limit(k)


def complex_functions(functions: DataFrame, k: int | None = None, least: int = COMPLEX) -> DataFrame:
    """Functions of a complexity worth a row, suspect spans last, then the most complex and the longest."""
    out = functions.where(F.col("ccn") >= least).orderBy(F.coalesce("suspect", F.lit(False)), F.desc("ccn"), F.desc("nloc"), "file", "function", "start")
    return out.limit(k) if k else out


def first_look(functions: DataFrame, nested: DataFrame) -> DataFrame:
    """path, look: of each file the function to open first: the deepest if it nests NESTED levels, else the most complex."""
    deep = nested.where(F.col("nesting") >= NESTED).groupBy(F.col("file").alias("path")).agg(F.max_by(F.struct("name", "nesting"), F.struct("nesting", (-F.col("start")).alias("s"))).alias("d"))
    full = functions.where((F.col("ccn") >= COMPLEX) & ~F.coalesce("suspect", F.lit(False))).groupBy(F.col("file").alias("path")).agg(F.max_by(F.struct("function", "ccn"), F.struct("ccn", (-F.col("start")).alias("s"))).alias("c"))
    told = F.when(F.col("d").isNotNull(), F.concat("d.name", F.lit("() nesting "), "d.nesting")).otherwise(F.concat("c.function", F.lit("() complexity "), "c.ccn"))
    return deep.join(full, "path", "full").select("path", told.alias("look"))


def own_sources(files: DataFrame, kinds: DataFrame) -> DataFrame:
    """Rows (path) of the repository's own source: no tests, samples, documents, vendored or generated files."""
    out = kinds.where(F.exists("reasons", lambda r: r.isin("test", "sample", "doc", "vendored", "generated"))).select("path")
    return files.join(out, "path", "left_anti")


def secrets_by_rule(sightings: DataFrame) -> DataFrame:
    """rule, confidence, at_head, history, first: places of values, once each, by rule and confidence; placeholders aside."""
    place = sightings.where(~F.col("placeholder")).groupBy("rule", "confidence", "value", "commit", "file", "line").agg(F.bool_or("at_head").alias("at_head"))
    first = F.coalesce(F.min(F.when(F.col("at_head"), F.col("file"))), F.min("file"))
    return place.groupBy("rule", "confidence").agg(F.count_if("at_head").alias("at_head"), F.count_if(~F.col("at_head")).alias("history"), first.alias("first"))


def grade(confidence: Column | str) -> Column:
    """A confidence's place in a report, the surest first."""
    place = F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col(confidence) if isinstance(confidence, str) else confidence)
    return F.when(place == 0, len(CONFIDENCES) + 1).otherwise(place)


# dependencies --------------------------------------------------------------------------------------------


def requirements(files: DataFrame) -> DataFrame:
    """source, name, requirement, pinned: what each line of pip requirement files (source, text) asks for.

    Comments, options and markers are left out; only one `==` without a wildcard names one version.
    """
    line = files.where(F.col("source").rlike(REQUIREMENT_FILE)).select("source", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim(F.regexp_replace("line", r"(^|\s)#.*$", "")))
    shape = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)"
    asked = F.regexp_replace(F.regexp_extract("line", shape, 2), r"\s+", "")
    name = F.lower(F.regexp_replace(F.regexp_extract("line", shape, 1), "[-_.]+", "-"))
    return line.where((F.col("line") != "") & ~F.startswith("line", F.lit("-"))).select("source", name.alias("name"), asked.alias("requirement"), asked.rlike(r"^===?[^,*]+$").alias("pinned")).where("name <> ''")


def informational(advisories: DataFrame) -> DataFrame:
    """id, kind of advisories (id, affected as JSON) that report no vulnerability: unmaintained, unsound, notice."""
    kinds = F.from_json("affected", "array<struct<database_specific:struct<informational:string>>>")
    told = F.filter(F.transform(kinds, lambda a: a["database_specific"]["informational"]), lambda k: k.isNotNull() & (k != ""))
    return advisories.select("id", F.get(told, F.lit(0)).alias("kind")).where("kind IS NOT NULL")


def vulnerable_ranked(packages: DataFrame) -> DataFrame:
    """packages with reach (0 imported and running, 1 running, 2 development only) and critical.

    Critical is a malicious package, or a pinned one of a score in the critical
    band that a lock of something deployed holds; a requirement without one
    version is a floor and not what is installed.
    """
    floating = F.col("source").rlike(REQUIREMENT_FILE) & ~F.coalesce("pinned", F.lit(False))
    bad = F.coalesce(F.col("score") >= CRITICAL_SCORE, F.lit(False)) & ~floating & F.coalesce("deploys", F.lit(False))
    reach = F.when(~F.coalesce("runtime", F.lit(True)), 2).when(F.coalesce("imported", F.lit(False)), 0).otherwise(1)
    return packages.withColumn("reach", reach).withColumn("critical", F.coalesce("malicious", F.lit(False)) | bad)


def vulnerable_first(ranked: DataFrame) -> DataFrame:
    """Of each lock file (source), the package to deal with first: malicious, critical, with a fix, of the highest score."""
    key = F.struct(~F.coalesce("malicious", F.lit(False)), ~F.col("critical"), F.col("fixed").isNull(), -F.coalesce("score", F.lit(-1.0)), "reach", "name")
    return ranked.groupBy("source").agg(F.min_by("name", key).alias("name"), F.count("*").alias("packages"), F.max("score").alias("score"))


def npm_lock(files: DataFrame) -> DataFrame:
    """source, path, name, version, dev, direct of package-lock.json texts (source, text): what is installed, and what the root asks for itself."""
    kind = "map<string,struct<version:string,dev:boolean,dependencies:map<string,string>,devDependencies:map<string,string>>>"
    held = files.select("source", F.from_json(F.get_json_object("text", "$.packages"), kind).alias("p"))
    each = held.select("source", F.explode("p").alias("path", "x"))
    root = each.where("path = ''").select("source", F.explode(F.array_distinct(F.concat(*[F.coalesce(F.map_keys(f"x.{k}"), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")]))).alias("name"))
    named = each.where("path <> ''").select("source", "path", F.regexp_extract("path", r"node_modules/((?:@[^/]+/)?[^/]+)$", 1).alias("name"), "x.version", F.coalesce("x.dev", F.lit(False)).alias("dev"))
    top = F.col("path") == F.concat(F.lit("node_modules/"), "name")
    return named.join(root.withColumn("asked", F.lit(True)), ["source", "name"], "left").select("source", "path", "name", "version", "dev", (F.coalesce("asked", F.lit(False)) & top).alias("direct"))


def yarn_lock(files: DataFrame) -> DataFrame:
    """source, name, version of yarn.lock texts (source, text): an entry's header names packages, its version stands under it."""
    entry = files.select("source", F.explode(F.split("text", r"\n(?=[\"@A-Za-z0-9])")).alias("e"))
    name = F.regexp_extract("e", r'^"?(@?[^@"\s]+)@', 1)
    return entry.select("source", name.alias("name"), F.regexp_extract("e", r'(?m)^\s+version:?\s+"?([^"\s]+)"?', 1).alias("version")).where("name <> '' AND version <> ''").distinct()


def drift_past_sweeps(drift: DataFrame, swept: DataFrame) -> DataFrame:
    """manifest, date: drifts (manifest, commit, date) dated by their newest change that isn't sweeping (hash); none where all are."""
    return drift.join(swept.select(F.col("hash").alias("commit")), "commit", "left_anti").groupBy("manifest").agg(F.max("date").alias("date"))


def action_order(pins: DataFrame, owner: str | None = None) -> DataFrame:
    """place, uses, trust: unpinned steps (uses, ref, secrets, pos) in the order to pin them.

    Owners farthest off first (others 0, the repository's own 1, the forge's 2),
    then branches, then steps that get secrets, then the order of the files.
    """
    who = F.substring_index("uses", "/", 1)
    trust = F.when(who.isin("actions", "github"), 2).when(F.lower(who) == (owner or "").lower(), 1).otherwise(0)
    return M.ranked(pins.withColumn("trust", trust), F.asc("trust"), F.asc(F.coalesce(F.col("ref") != "branch", F.lit(True))), F.asc(~F.coalesce("secrets", F.lit(False))), F.asc("pos")).select("place", "uses", "trust")


# rules over shapes ----------------------------------------------------------------------------------------


def deep_nesting(functions: DataFrame, hot: DataFrame) -> DataFrame:
    """One finding over functions (file, name, start, nesting, bumps, cognitive) nested or bumpy; a warning if one is in a hotspot (path)."""
    deep = functions.where((F.col("nesting") >= NESTED) | (F.col("bumps") >= BUMPS)).join(hot.select(F.col("path").alias("file"), F.lit(True).alias("hot")), "file", "left")
    worst = F.max_by(F.concat_ws(":", "file", "name"), F.struct("cognitive", "nesting", "file"))
    all_of = deep.agg(F.count("*").alias("functions"), worst.alias("worst"), F.coalesce(F.bool_or("hot"), F.lit(False)).alias("hot")).where("functions > 0")
    return finding(all_of, "deep_nesting", F.when(F.col("hot"), "warning").otherwise("info"), "worst", "functions")


def swallowed_errors(shapes: DataFrame, hot: DataFrame, least: int = SWALLOWED) -> DataFrame:
    """One finding over files (path, empty) with empty handlers, from `least` in all; a warning if one is a hotspot."""
    held = shapes.where("empty > 0").join(hot.select("path", F.lit(True).alias("hot")), "path", "left")
    all_of = held.agg(F.sum("empty").alias("handlers"), F.count("*").alias("files"), F.max_by("path", F.struct(F.coalesce("hot", F.lit(False)).alias("h"), "empty")).alias("first"), F.coalesce(F.bool_or("hot"), F.lit(False)).alias("hot"))
    return finding(all_of.where(F.col("handlers") >= least), "swallowed_errors", F.when(F.col("hot"), "warning").otherwise("info"), "first", "handlers", "files")


def commented_out(found: DataFrame, key: str, least: int = 10) -> DataFrame:
    return finding(found.where(F.col("code_lines") >= least), "commented_out_code", "info", key, "code_lines")


def instructions_drift(files: DataFrame, last: str, months: int = 6, commits: int = 100) -> DataFrame:
    """Findings over instruction files (path, date, behind) far behind the last commit in time and in commits."""
    old = X.whole_months(F.col("date"), F.lit(last).cast("date"))
    return finding(files.withColumn("months", old).where((F.col("months") >= months) & (F.col("behind") >= commits)), "agent_instructions_drift", "info", "path", "months", "behind")


def signoff_by_co_author(signed: DataFrame, authors: DataFrame, least: int = 2) -> DataFrame:
    """Findings over people (email) who sign off commits they co-author (hash, email) and author none."""
    held = signed.join(authors.select("email").distinct(), "email", "left_anti").groupBy("email").agg(F.countDistinct("hash").alias("commits"))
    return finding(held.where(F.col("commits") >= least), "signoff_by_co_author", "info", "email", "commits")


def checks_run(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """measure, result of the checks (measure, skipped: why, or null) that a report ran: not computed, clean or n found."""
    n = findings.groupBy(F.col("rule").alias("measure")).agg(F.count("*").alias("n"))
    told = F.when(F.col("skipped").isNotNull(), F.concat(F.lit("not computed: "), "skipped")).when(F.col("n").isNull(), "clean").otherwise(F.concat("n", F.lit(" found")))
    return checks.join(n, "measure", "left").select("measure", told.alias("result"))


# candidates ----------------------------------------------------------------------------------------------


def cut_off_score(ranking: DataFrame, key: str, k: int = 15) -> DataFrame:
    """One row for one ranking (key, place, outcome, cost): hits and what to expect, headroom, AUC, recall at a fifth of the cost, Popt and first false alarms."""
    out = M.headroom(ranking, k)
    for part in (M.auc(ranking), M.recall_at_effort(ranking), M.popt(ranking.withColumnRenamed("place", "_at"), key, F.asc("_at")), M.initial_false_alarms(ranking, k)):
        out = out.join(part, how="cross")  # one row each
    return out


def paired(base: DataFrame, candidate: DataFrame, outcome: DataFrame, k: int = 15, saturated: float = 0.5) -> DataFrame:
    """cut, pool, positives, base_hits, cand_hits, d, saturated, added, dropped: two rankings (cut, path, place) held against one outcome (cut, path).

    The candidate's order is cut to the base's pool; what it doesn't rank comes after, in the base's order.
    """
    key = ["cut", "path"]
    own = base.select(*key, F.col("place").alias("bp"))
    other = candidate.select(*key, F.col("place").alias("cp"))
    both = own.join(other, key, "full").join(outcome.select(*key, F.lit(1).alias("hit")), key, "left")
    pool = both.where("bp IS NOT NULL")
    moved = M.ranked(pool, F.asc_nulls_last("cp"), F.asc("bp"), by=("cut",))
    hits = moved.groupBy("cut").agg(
        F.count("*").alias("pool"), F.count("hit").alias("positives"), F.count_if(F.col("hit").isNotNull() & (F.col("bp") <= k)).alias("base_hits"), F.count_if(F.col("hit").isNotNull() & (F.col("place") <= k)).alias("cand_hits"),
        F.count_if(F.col("cp").isNull()).alias("dropped"),
    )
    added = both.groupBy("cut").agg(F.count_if(F.col("bp").isNull()).alias("added"))
    return hits.join(added, "cut").select("cut", "pool", "positives", "base_hits", "cand_hits", (F.col("cand_hits") - F.col("base_hits")).alias("d"), (X.ratio(F.col("positives"), F.col("pool")) >= saturated).alias("saturated"), "added", "dropped")


def decided(rows: DataFrame) -> DataFrame:
    """mean, p, wins, losses, ties over repositories: rows (repo, d), the mean difference of each, and the exact one-sided sign-flip test of these."""
    effects = rows.groupBy("repo").agg(F.avg("d").alias("effect")).orderBy("repo").collect()  # one row a repository
    values = [r.effect for r in effects]
    out = (sum(values) / len(values) if values else None, M.sign_flip(values), *(sum(test(v) for v in values) for test in (lambda v: v > 0, lambda v: v < 0, lambda v: v == 0)))
    return rows.sparkSession.createDataFrame([out], "mean double, p double, wins long, losses long, ties long")


def snoring(cuts: DataFrame, horizon: int = 6) -> DataFrame:
    """cuts (repo, cut, label_end) with exposed: whether bugs from after the cut may not be labelled yet, two horizons before the labels end."""
    return cuts.withColumn("exposed", F.coalesce(F.add_months("cut", 2 * horizon) > F.col("label_end"), F.lit(False)))


def signals(scores: DataFrame) -> DataFrame:
    """variant, hits in all, and the medians of auc and recall over cut-offs that have them."""
    return scores.groupBy("variant").agg(F.sum("hits").alias("hits"), F.percentile("auc", F.lit(0.5)).alias("auc"), F.percentile("recall", F.lit(0.5)).alias("recall"))

