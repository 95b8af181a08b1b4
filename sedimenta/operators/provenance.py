"""Trailers, cohorts, signatures and the shape of commits; labels and what became of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X


def trailers(commits: DataFrame) -> DataFrame:
    """key, commits: trailer keys of commits (hash, trailers as array of (key, value)) under their commonest spelling."""
    each = commits.select("hash", F.explode("trailers").alias("t")).select("hash", F.col("t.key").alias("key")).where(~F.col("key").rlike(r"^[A-Z][A-Z0-9]+-\d+$"))
    spelled = each.groupBy(F.lower("key").alias("low"), "key").agg(F.count("*").alias("n"))
    name = spelled.groupBy("low").agg(F.min_by("key", F.struct((-F.col("n")).alias("n"), "key")).alias("name"))
    return each.groupBy(F.lower("key").alias("low")).agg(F.countDistinct("hash").alias("commits")).join(name, "low").select(F.col("name").alias("key"), "commits")


def cohorts(commits: DataFrame, changes: DataFrame, marked: DataFrame, reverted: DataFrame, days: int = 14) -> DataFrame:
    """marked, commits, fixes, reverted, touches, again: commits with a mark held against the rest."""
    flags = commits.join(marked.select("hash", F.lit(True).alias("m")), "hash", "left").join(reverted.select("hash", F.lit(True).alias("r")), "hash", "left")
    flags = flags.select("hash", F.col("m").isNotNull().alias("marked"), F.col("r").isNotNull().alias("back"), X.is_fix("subject").alias("fix"))
    later = F.lead("date").over(W.partitionBy("path").orderBy("date", "pos"))
    touched = changes.withColumn("again", F.datediff(later, "date") <= days).groupBy("hash").agg(F.count("*").alias("touches"), F.count_if("again").alias("again"))
    return flags.join(touched, "hash", "left").groupBy("marked").agg(F.count("*").alias("commits"), F.count_if("fix").alias("fixes"), F.count_if("back").alias("reverted"), F.sum(F.coalesce("touches", F.lit(0))).alias("touches"), F.sum(F.coalesce("again", F.lit(0))).alias("again"))


def signature_kind(payload: Column | str) -> Column:
    """gpg, ssh, x509 or other, by how a signature begins; null without one."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    return F.when(F.startswith(payload, F.lit("-----BEGIN PGP")), "gpg").when(F.startswith(payload, F.lit("-----BEGIN SSH")), "ssh").when(F.startswith(payload, F.lit("-----BEGIN SIGNED MESSAGE")), "x509").when(F.length(payload) > 0, "other")


def signing_by_year(commits: DataFrame) -> DataFrame:
    """year, commits, signed, share of commits (date, signature)."""
    kind = signature_kind("signature")
    out = commits.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("commits"), F.count(kind).alias("signed"))
    return out.withColumn("share", X.ratio(F.col("signed"), F.col("commits")))


def signing_by_kind(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.coalesce(signature_kind("signature"), F.lit("none")).alias("kind")).agg(F.count("*").alias("commits"))


def commit_shape(commits: DataFrame, gap: str = "10 minutes", least: int = 5) -> DataFrame:
    """commits, burst_share, typed_share, hours: of commits (author, ts, pos, subject)."""
    order = W.partitionBy("author").orderBy("ts", "pos")
    new = F.when(F.lag("ts").over(order).isNull() | (F.col("ts") > F.lag("ts").over(order) + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    runs = commits.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    long = runs.groupBy("author", "run").agg(F.count("*").alias("n")).agg(F.sum(F.when(F.col("n") >= least, F.col("n")).otherwise(0)).alias("burst"))
    heads = commits.agg(F.count("*").alias("commits"), F.count_if(F.col("subject").rlike(X.CONVENTIONAL)).alias("typed"), F.countDistinct(F.hour("ts")).alias("hours"))
    return heads.join(long, how="cross").select("commits", X.ratio(F.col("burst"), F.col("commits")).alias("burst_share"), X.ratio(F.col("typed"), F.col("commits")).alias("typed_share"), "hours")


def convention(commits: DataFrame, floor: float = 0.9) -> DataFrame:
    """typed, n, low, typed_history: whether subjects are typed by convention, by the Wilson bound."""
    held = commits.agg(F.count("*").alias("n"), F.count_if(F.col("subject").rlike(X.CONVENTIONAL)).alias("typed"))
    low = X.wilson(F.col("typed"), F.col("n"), 1.959964)["low"]
    return held.select("typed", "n", low.alias("low"), (low >= floor).alias("typed_history"))


def prefixed(names: DataFrame, name: str, shorts: DataFrame, short: str) -> DataFrame:
    """shorts with the names that begin with them: one equi-join for each length in use, hashes have at most 64."""
    lengths = [r.n for r in shorts.select(F.length(short).alias("n")).where("n > 0").distinct().orderBy("n").limit(64).collect()]
    out = shorts.limit(0).withColumn(name, F.lit(None).cast("string"))
    for n in lengths:
        cut = names.select(name, F.substring(name, 1, n).alias("_cut"))
        out = out.unionByName(shorts.where(F.length(short) == n).join(cut, F.col(short) == F.col("_cut")).drop("_cut"))
    return out


def labelled(commits: DataFrame, changes: DataFrame, labels: DataFrame, start: str, end: str) -> DataFrame:
    """Paths of labelled commits (hash, whole or else cut short; path optional) in [start, end).

    A short hash is joined on its own length, one equi-join a length in use.
    """
    exact = labels.join(commits.select("hash"), "hash", "left_semi")
    cut = labels.join(commits.select("hash"), "hash", "left_anti").withColumnRenamed("hash", "short")
    dated = commits.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))).select("hash")
    out = exact.join(dated, "hash").select("hash", F.col("path").alias("named"))
    out = out.unionByName(prefixed(dated, "hash", cut, "short").select("hash", F.col("path").alias("named")))
    return out.join(changes.select("hash", "path"), "hash").where(F.col("named").isNull() | (F.col("named") == F.col("path"))).select("path").distinct()


def cross_checked(functions: DataFrame, structure: DataFrame, most: float = 2.0) -> DataFrame:
    """functions with the span of a second parser where both have one of the name and start; far spans are corrected and marked suspect."""
    key = ["file", "start"]
    once = structure.groupBy(key).agg(F.count("*").alias("n"), F.first("function").alias("other"), F.first("stop").alias("true_stop")).where("n = 1").drop("n")
    single = functions.groupBy(key).agg(F.count("*").alias("k"))
    both = functions.join(single, key).join(once, key, "left")
    fits = (F.col("k") == 1) & (F.col("other") == F.col("function"))
    own, true = F.col("stop") - F.col("start") + 1, F.col("true_stop") - F.col("start") + 1
    far = fits & ((own > most * true) | (true > most * own))
    return both.select(*[c for c in functions.columns if c != "stop"], F.when(far, F.col("true_stop")).otherwise(F.col("stop")).alias("stop"), F.coalesce(far, F.lit(False)).alias("suspect"))


def remediation(before: DataFrame, after: DataFrame, tree: DataFrame, renames: DataFrame) -> DataFrame:
    """rule, subject, outcome of findings in a later tree: open, moved, gone or resolved."""
    moved = renames.select(F.col("old").alias("subject"), F.col("new").alias("to"))
    held = before.select("rule", "subject").distinct().join(moved, "subject", "left").withColumn("now", F.coalesce("to", "subject"))
    held = held.join(after.select("rule", F.col("subject").alias("now"), F.lit(True).alias("still")).distinct(), ["rule", "now"], "left").join(tree.select(F.col("path").alias("now"), F.lit(True).alias("there")), "now", "left")
    outcome = F.when(F.col("still"), F.when(F.col("to").isNotNull(), "moved").otherwise("open")).when(F.col("there").isNull(), "gone").otherwise("resolved")
    return held.select("rule", "subject", outcome.alias("outcome"))


def pooled(outcomes: DataFrame) -> DataFrame:
    """rule, n, resolved, low, high: shares of resolved findings."""
    n = outcomes.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "resolved").alias("resolved"))
    ci = X.wilson(F.col("resolved"), F.col("n"))
    return n.select("rule", "n", "resolved", ci["low"].alias("low"), ci["high"].alias("high"))


def finding_id(rule: Column, repo: Column, commit: Column, evidence: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0000", rule, repo, commit, evidence), 256), 1, 16)


def carry_over(tops: DataFrame) -> DataFrame:
    """cut, overlap: Jaccard of each cut-off's first rows (cut, path) with those of the one before."""
    order = tops.select("cut").distinct().withColumn("next", F.lead("cut").over(W.orderBy("cut"))).where("next IS NOT NULL")
    pair = tops.join(order, "cut").select(F.col("next").alias("cut"), "path").withColumn("was", F.lit(True))
    both = pair.join(tops.withColumn("is", F.lit(True)), ["cut", "path"], "full").groupBy("cut").agg(F.count_if(F.col("was").isNotNull() & F.col("is").isNotNull()).alias("same"), F.count("*").alias("all"), F.max("was").alias("w"))
    return both.where("w").select("cut", X.ratio(F.col("same"), F.col("all")).alias("overlap"))


def misses(ranked: DataFrame, outcome: DataFrame, k: int = 15) -> DataFrame:
    """path, place of outcomes that a ranking (path, place) has not among its first k; null if not at all."""
    return outcome.select("path").distinct().join(ranked.select("path", "place"), "path", "left").where(F.col("place").isNull() | (F.col("place") > k))


def blame_shares(lines: DataFrame) -> DataFrame:
    """year, person, lines: surviving lines (year, people), each shared evenly by its people."""
    each = lines.select("year", F.size("people").alias("n"), F.explode("people").alias("person"))
    return each.groupBy("year", "person").agg(F.sum(1 / F.col("n")).alias("lines"))
