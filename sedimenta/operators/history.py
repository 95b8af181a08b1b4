"""Aggregates over the change history: one row per path, person, period or commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X

# filters -------------------------------------------------------------------


def in_window(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """since <= date < until, either bound optional."""
    if since is not None:
        df = df.where(F.col("date") >= F.lit(since).cast("date"))
    return df.where(F.col("date") < F.lit(until).cast("date")) if until is not None else df


def totals(changes: DataFrame) -> DataFrame:
    """Files and lines of each commit that has files."""
    return changes.groupBy("hash").agg(F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def nearest_rank(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row, `cut`: the value at rank ceil(p * n), from a histogram of the values.

    Equal values are counted before they are ordered, so what is sorted in one
    place is the distinct values, not the rows.
    """
    counted = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    upto = counted.withColumn("upto", F.sum("k").over(W.orderBy("v"))).withColumn("n", F.sum("k").over(W.partitionBy()))
    return upto.where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n")))).agg(F.min("v").alias("cut"))


def sweeps(changes: DataFrame, min_files: int = 20, percentile: float = 0.99, tolerance: float = 0.1) -> DataFrame:
    """hash of commits as wide as the widest hundredth that delete about what they add."""
    wide = totals(changes)
    cut = nearest_rank(wide, "files", percentile)
    wide = wide.join(F.broadcast(cut), F.col("files") >= F.greatest(F.lit(min_files), "cut"))
    return wide.where(F.abs(F.col("added") - F.col("deleted")) <= F.lit(tolerance) * F.greatest("added", "deleted")).select("hash")


def imports(changes: DataFrame, share: float = 0.05, min_files: int = 100, deleted: float = 0.01) -> DataFrame:
    """hash of commits that bring in a share of all lines at once."""
    wide = totals(changes)
    total = wide.agg(F.sum("added").alias("total"))
    wide = wide.where(F.col("files") >= min_files).join(F.broadcast(total), F.col("added") >= F.lit(share) * F.col("total"))
    return wide.where(F.col("deleted") <= F.lit(deleted) * F.col("added")).select("hash")


def imported_files(changes: DataFrame, brought: DataFrame) -> DataFrame:
    return changes.where("added > 0").join(brought, "hash", "left_semi").select("path").distinct()


def oversized(changes: DataFrame, percentile: float = 0.99, floor: int = 500) -> DataFrame:
    """hash of commits that change more lines than nearly all others."""
    lines = totals(changes).select("hash", (F.col("added") + F.col("deleted")).alias("lines"))
    cut = nearest_rank(lines, "lines", percentile)
    return lines.join(F.broadcast(cut), F.col("lines") >= F.greatest(F.lit(floor), "cut")).select("hash")


def analysed(changes: DataFrame, ignored: DataFrame | None = None, **limits) -> DataFrame:
    """changes without sweeps, imports and ignored commits."""
    wide = {k: v for k, v in limits.items() if k in ("min_files", "percentile", "tolerance")}
    out = changes.join(sweeps(changes, **wide), "hash", "left_anti").join(imports(changes), "hash", "left_anti")
    return out.join(ignored.select("hash"), "hash", "left_anti") if ignored is not None else out


def fix_pool(changes: DataFrame, fix: Column | None = None) -> DataFrame:
    """Changes of commits whose subject is a fix and that are not oversized."""
    return changes.where(X.is_fix("subject") if fix is None else fix).join(oversized(changes), "hash", "left_anti")


def tangled(changes: DataFrame, min_files: int = 10, min_folders: int = 4, min_clauses: int = 2) -> DataFrame:
    """hash, files, folders, clauses of commits that look like several changes in one."""
    spread = changes.groupBy("hash", "subject").agg(F.count("*").alias("files"), F.countDistinct(X.folder("path")).alias("folders")).withColumn("clauses", X.clauses("subject"))
    return spread.where((F.col("files") >= min_files) & (F.col("folders") >= min_folders) & (F.col("clauses") >= min_clauses)).select("hash", "files", "folders", "clauses")


# per path and person ---------------------------------------------------------


def revisions(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.count("*").alias("revs"))


def authors(changes: DataFrame, credits: DataFrame, minor_share: float = 0.05) -> DataFrame:
    """path, authors, revs, minor: people under `minor_share` of a file's commits."""
    each = credits.groupBy("path", "person").agg(F.count("*").alias("n"))
    return each.join(revisions(changes), "path").groupBy("path", "revs").agg(F.count("*").alias("authors"), F.count_if(X.ratio(F.col("n"), F.col("revs")) < minor_share).alias("minor")).select("path", "authors", "revs", "minor")


def ownership(credits: DataFrame, now: DataFrame, recent_months: int = 12) -> DataFrame:
    """path, person, added, deleted, commits, recent: commits on or after `recent_months` before the last date."""
    dated = credits.join(F.broadcast(now.select(F.add_months("now", -recent_months).alias("since"))), how="cross")
    return dated.groupBy("path", "person").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count("*").alias("commits"), F.count_if(F.col("date") >= F.col("since")).alias("recent"))


def author_totals(changes: DataFrame, people: DataFrame) -> DataFrame:
    """person, commits, authored, added, deleted, first, last; lines are shared at the commit's total."""
    shared = people.join(totals(changes), "hash", "left")
    share = lambda c: X.apportioned(F.coalesce(c, F.lit(0)), F.col("people"), F.col("position"))
    return shared.groupBy("person").agg(
        F.count("*").alias("commits"), F.count_if(F.col("position") == 0).alias("authored"), F.sum(share("added")).alias("added"), F.sum(share("deleted")).alias("deleted"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


def file_age(changes: DataFrame, now: DataFrame) -> DataFrame:
    last = changes.groupBy("path").agg(F.max("date").alias("last"))
    return last.join(F.broadcast(now), how="cross").select("path", "last", X.whole_months(F.col("last"), F.col("now")).cast("long").alias("months"))


def arrivals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("path").agg(F.min("date").alias("first"))


def fixes(changes: DataFrame, now: DataFrame, recent_months: int = 6) -> DataFrame:
    """path, fixes, last_fix, recent: fixes under `recent_months` whole months old."""
    pool = fix_pool(changes).join(F.broadcast(now), how="cross")
    return pool.groupBy("path").agg(F.count("*").alias("fixes"), F.max("date").alias("last_fix"), F.count_if(X.whole_months(F.col("date"), F.col("now")) < recent_months).alias("recent"))


def plumbing(changes: DataFrame, min_revs: int = 20, share: float = 0.8, max_lines: int = 3) -> DataFrame:
    """Paths nearly all of whose changes swap a few lines for as many."""
    small = (F.col("added") == F.col("deleted")) & (F.col("added") <= max_lines)
    counted = changes.groupBy("path").agg(F.count("*").alias("revs"), F.count_if(small).alias("small"))
    return counted.where((F.col("revs") >= min_revs) & (X.ratio(F.col("small"), F.col("revs")) >= share))


def test_cochange(sets: DataFrame) -> DataFrame:
    """path, sets, with_tests: changesets of a production path, and those that touch a test too; `test` says which paths are, if `sets` has it."""
    marked = sets if "test" in sets.columns else sets.withColumn("test", X.is_test_path("path"))
    tested = marked.groupBy("key").agg(F.bool_or("test").alias("tested"))
    return marked.where(~F.col("test")).join(tested, "key").groupBy("path").agg(F.count("*").alias("sets"), F.count_if("tested").alias("with_tests"))


def late_night(dated: DataFrame, first: int = 0, last: int = 3) -> DataFrame:
    """entity, revs, late: rows whose recorded hour is in the small hours; `hour` is the author's own."""
    return dated.groupBy("entity").agg(F.count("*").alias("revs"), F.count_if(F.col("hour").between(first, last)).alias("late"))


# authorship ------------------------------------------------------------------


def degree_of_authorship(changes: DataFrame, credits: DataFrame, now: DataFrame | None = None, half_life: float | None = None, floor: float = 3.293, share: float = 0.75) -> DataFrame:
    """path, person, fa, dl, ac, doa, is_author; with a half-life in months, changes fade by their age."""
    if half_life is None:
        weight = F.lit(1.0)
        rows = credits
    else:
        rows = credits.join(F.broadcast(now), how="cross")
        weight = F.pow(F.lit(0.5), F.datediff("now", "date") / F.lit(30.44) / F.lit(half_life))
    own = rows.groupBy("path", "person").agg(F.sum(weight).alias("dl"))
    creator = changes.where("added > 0").groupBy("path").agg(F.min_by("author", F.struct("date", "pos")).alias("creator"))
    path = W.partitionBy("path")
    scored = own.join(creator, "path", "left").withColumn("ac", F.sum("dl").over(path) - F.col("dl")).withColumn("fa", F.coalesce(F.col("person") == F.col("creator"), F.lit(False)).cast("int"))
    scored = scored.withColumn("doa", F.lit(3.293) + F.lit(1.098) * F.col("fa") + F.lit(0.164) * F.col("dl") - F.lit(0.321) * F.ln(1 + F.greatest(F.col("ac"), F.lit(0.0))))
    return scored.select("path", "person", "fa", "dl", "ac", "doa", ((F.col("doa") >= floor) & (F.col("doa") >= share * F.max("doa").over(path))).alias("is_author"))


# entropy ---------------------------------------------------------------------


def month_periods(changes: DataFrame) -> DataFrame:
    """period, month, path, n: changes of a path in a calendar month."""
    month = X.month_number("date")
    return changes.groupBy(month.cast("long").alias("period"), month.cast("long").alias("month"), "path").agg(F.count("*").alias("n"))


def quiet_periods(changes: DataFrame, gap_days: int = 1) -> DataFrame:
    """period, month, path, n: periods end where no commit falls for more than `gap_days`.

    Days are counted once before they are put in order, so the window runs
    over the days of the history and not over its changes.
    """
    days = changes.select("date").distinct().withColumn("gap", F.datediff("date", F.lag("date").over(W.orderBy("date"))))
    numbered = days.withColumn("period", F.sum(F.when(F.col("gap") > gap_days, 1).otherwise(0)).over(W.orderBy("date")))
    starts = numbered.withColumn("month", F.min(X.month_number("date")).over(W.partitionBy("period"))).select("date", F.col("period").cast("long").alias("period"), F.col("month").cast("long").alias("month"))
    return changes.join(starts, "date").groupBy("period", "month", "path").agg(F.count("*").alias("n"))


def change_entropy(periods: DataFrame, now: DataFrame, decay: float = 0.5, hcpf: int = 2, sizing: str = "period", window: int = 6, phi: float | None = None) -> DataFrame:
    """path, periods, hcm: a file's part in each period's entropy, summed with a weight by the period's age."""
    if phi is not None and phi <= 0:
        raise ValueError(f"phi must be positive, not {phi!r}")
    whole = periods.groupBy("period", "month").agg(F.sum("n").alias("total"), F.count("*").alias("files"))
    if sizing == "period":
        sized = whole.withColumn("size", F.col("files"))
    elif sizing == "system":
        new = periods.groupBy("path").agg(F.min("period").alias("period")).groupBy("period").agg(F.count("*").alias("new"))
        sized = whole.join(new, "period", "left").withColumn("size", F.sum(F.coalesce("new", F.lit(0))).over(W.orderBy("period")))
    elif sizing == "adaptive":
        # a path is in the window of every one of the `window` periods from its own on
        order = whole.select("period", F.row_number().over(W.orderBy("period")).alias("slot"))
        spread = periods.select("period", "path").join(F.broadcast(order), "period").select("path", F.explode(F.sequence("slot", F.col("slot") + window - 1)).alias("slot"))
        rolling = spread.distinct().groupBy("slot").agg(F.count("*").alias("size"))
        sized = whole.join(order, "period").join(rolling, "slot").drop("slot")
    else:
        raise ValueError(f"unknown sizing {sizing!r}")
    size = F.greatest("size", "files")
    share = F.col("n") / F.col("total")
    bits = periods.join(sized.select("period", "total", "files", "size"), "period").groupBy("period").agg(F.sum(X.shannon(share)).alias("bits"))
    back = F.greatest(F.lit(0), X.month_number("now") - F.col("month"))
    weight = F.exp(-F.lit(phi) * back / 12) if phi is not None else F.pow(F.lit(decay), back)
    valued = sized.join(bits, "period").join(F.broadcast(now), how="cross")
    valued = valued.withColumn("h", F.when((size > 1) & (F.col("files") > 1), F.col("bits") / F.log2(size)).otherwise(F.lit(0.0)) * weight)
    part = {1: F.lit(1.0), 2: share, 3: 1 / F.col("files")}[hcpf]
    return periods.join(valued.select("period", "total", "files", "h"), "period").groupBy("path").agg(F.count("*").alias("periods"), F.sum(part * F.col("h")).alias("hcm"))


# activity --------------------------------------------------------------------


def by_weekday(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.weekday("date").alias("weekday")).agg(F.count("*").alias("commits"))


def by_month(commits: DataFrame) -> DataFrame:
    return commits.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("commits"))


def by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("events"))


def net_by_year(changes: DataFrame) -> DataFrame:
    return changes.groupBy(F.year("date").alias("year")).agg(F.sum(F.col("added") - F.col("deleted")).alias("net"))


def timeline(commits: DataFrame, months: list[str]) -> DataFrame:
    """author times `months`, commits in each."""
    return commits.withColumn("month", F.date_format("date", "yyyy-MM")).groupBy("author").pivot("month", months).count().na.fill(0)


def reverted_files(changes: DataFrame) -> DataFrame:
    return changes.where(X.is_revert("subject")).groupBy("path").agg(F.count("*").alias("reverts"))


def activity(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """metric, value: the history's counts."""
    heads = commits.agg(
        F.count("*").alias("commits"), F.count_if(X.is_fix("subject")).alias("fixes"), F.count_if(X.is_revert("subject")).alias("reverts"),
        F.count_if(F.col("subject").rlike(r"\(#\d+\)\s*$")).alias("squash"), F.countDistinct("author").alias("authors"),
    )
    lines = changes.agg(F.sum("added").alias("added_total"), F.sum("deleted").alias("deleted_total"))
    both = heads.join(lines, how="cross")
    return both.unpivot([], both.columns, "metric", "value").select("metric", F.col("value").cast("long").alias("value"))
