"""Ordered analytics: percentiles, strata, sessions, bursts, as-of values, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X


def strata(rows: DataFrame, key: str, value: str, n: int = 10) -> DataFrame:
    """key, value, stratum: cuts at the values of rank len * i // n; a row's stratum is how many cuts it reaches.

    Cuts come from a histogram of the values, so ties stay together and no task orders all rows.
    """
    counted = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    upto = counted.withColumn("upto", F.sum("k").over(W.orderBy("v"))).withColumn("n", F.sum("k").over(W.partitionBy()))
    at = upto.select("v", "upto", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.floor(F.col("n") * i / n))).alias("at"))
    cuts = at.where((F.col("at") < F.col("upto"))).groupBy("at").agg(F.min("v").alias("cut"), F.count("*").alias("_"))
    # several cuts may share a rank in a small table; each counts
    wanted = upto.agg(F.max("n").alias("n")).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.floor(F.col("n") * i / n))).alias("at"))
    held = wanted.join(cuts.select("at", "cut"), "at").agg(F.collect_list("cut").alias("cuts"))
    return rows.join(F.broadcast(held), how="cross").select(key, value, F.size(F.filter("cuts", lambda c: c <= F.col(value))).cast("long").alias("stratum"))


def sessions(events: DataFrame, who: str = "user_id", at: str = "ts", tie: str = "event_id", gap: str = "1 hour") -> DataFrame:
    """who, session, events, start, stop: a new session begins after a quiet time longer than `gap`."""
    order = W.partitionBy(who).orderBy(at, tie)
    new = F.when(F.lag(at).over(order).isNull() | (F.col(at) > F.lag(at).over(order) + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long"))
    return numbered.groupBy(who, "session").agg(F.count("*").alias("events"), F.min(at).alias("start"), F.max(at).alias("stop"))


def bursts(events: DataFrame, who: str = "user_id", at: str = "ts", tie: str = "event_id", gap: str = "10 minutes", least: int = 5) -> DataFrame:
    """Sessions of `least` events or more."""
    return sessions(events, who, at, tie, gap).where(F.col("events") >= least)


def next_touch(changes: DataFrame, days: int = 14) -> DataFrame:
    """path, touches, again: changes followed by another of the path within `days`."""
    later = F.lead("date").over(W.partitionBy("path").orderBy("date", "pos"))
    return changes.withColumn("later", later).groupBy("path").agg(F.count("*").alias("touches"), F.count_if(F.datediff("later", "date") <= days).alias("again"))


def year_change(series: DataFrame, now: DataFrame) -> DataFrame:
    """path, before, after: the last value at or before a year ago, and the last of all (path, date, value)."""
    dated = series.join(F.broadcast(now.select(F.add_months("now", -12).alias("cut"))), how="cross")
    out = dated.groupBy("path").agg(F.max_by("value", F.when(F.col("date") <= F.col("cut"), F.col("date"))).alias("before"), F.max_by("value", "date").alias("after"))
    return out.where(F.col("before").isNotNull())


def running_distinct(rows: DataFrame, period: str, item: str) -> DataFrame:
    """period, seen: items seen in any period up to each."""
    new = rows.groupBy(item).agg(F.min(period).alias(period)).groupBy(period).agg(F.count("*").alias("new"))
    all_ = rows.select(period).distinct().join(new, period, "left")
    return all_.select(period, F.sum(F.coalesce("new", F.lit(0))).over(W.orderBy(period)).alias("seen"))


def rolling_distinct(rows: DataFrame, period: str, item: str, width: int = 6) -> DataFrame:
    """period, seen: items in a period or the `width` - 1 before it; periods are whole numbers."""
    spread = rows.select(period, item).distinct().select(F.explode(F.sequence(F.col(period), F.col(period) + width - 1)).alias(period), item).distinct()
    return spread.groupBy(period).agg(F.count("*").alias("seen")).join(rows.select(period).distinct(), period, "left_semi")


def shares(rows: DataFrame, value: str, key: str) -> DataFrame:
    """key, at_most, below: the share of values up to and under each row's, from a histogram."""
    counted = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    upto = counted.withColumn("upto", F.sum("k").over(W.orderBy("v"))).withColumn("n", F.sum("k").over(W.partitionBy()))
    return rows.join(upto, F.col(value) == F.col("v")).select(key, X.ratio(F.col("upto"), F.col("n")).alias("at_most"), X.ratio(F.col("upto") - F.col("k"), F.col("n")).alias("below"))


def moved_lines(changed: DataFrame, days: int = 14) -> DataFrame:
    """path, added, churned: added lines deleted again within `days`, each deletion used once, the oldest addition first.

    Equal lines of a commit are counted first, so a group holds a row or two a
    commit however often a line (blank ones, braces) stands in a file. Per
    (path, text), additions and deletions are matched in time order by a queue
    from which what is too old falls off its end, once.
    """
    from collections import deque

    import pandas as pd

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["date", "pos", "kind"], kind="stable")
        waiting: deque[list] = deque()  # [date, lines]
        added = churned = 0
        for kind, date, n in zip(rows["kind"], rows["date"], rows["n"], strict=True):
            if kind == "+":
                added += n
                waiting.append([date, n])
                continue
            while waiting and (date - waiting[0][0]).days > days:
                waiting.popleft()
            while n and waiting:
                taken = min(n, waiting[0][1])
                churned, n = churned + taken, n - taken
                waiting[0][1] -= taken
                if not waiting[0][1]:
                    waiting.popleft()
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "added": [added], "churned": [churned]})

    counted = changed.groupBy("path", "text", "date", "pos", "kind").agg(F.count("*").alias("n"))
    each = counted.groupBy("path", "text").applyInPandas(match, "path string, added long, churned long")
    return each.groupBy("path").agg(F.sum("added").alias("added"), F.sum("churned").alias("churned"))


def sample_dates(first, last, n: int) -> list:
    """Evenly spaced dates, the last one among them: at most one for each 28 days and two at least."""
    from datetime import timedelta

    span = (last - first).days
    n = max(2, min(n, span // 28 + 1))
    return [first + timedelta(days=span * i // (n - 1)) for i in range(n - 1)] + [last]


def cutoffs(last, windows: int, horizon: int) -> list:
    """`windows` dates, each `horizon` months before the next, the last one `horizon` months before `last`."""
    out = []
    for i in range(windows, 0, -1):
        month = last.year * 12 + last.month - 1 - horizon * i
        day = last.day
        while True:
            try:
                out.append(last.replace(year=month // 12, month=month % 12 + 1, day=day))
                break
            except ValueError:
                day -= 1
    return out
