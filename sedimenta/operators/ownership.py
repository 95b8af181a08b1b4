"""Knowledge: areas and their owners, islands, lost lines and people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X


def areas(owned: DataFrame, dominant: float = 0.8, base: int = 0) -> DataFrame:
    """area, lines, authors, owners (person, lines; most first): top directories, or the next level if one holds `dominant` of all lines."""
    rows = owned.where("added > 0").select(X.area("path", 1, base).alias("top"), X.area("path", 2, base).alias("next"), "person", "added")
    tops = rows.groupBy("top").agg(F.sum("added").alias("lines"))
    deep = tops.agg(F.max_by("top", F.struct("lines", "top")).alias("top"), F.max("lines").alias("most"), F.sum("lines").alias("all")).select(((F.col("top") != "(root files)") & (F.col("most") >= F.lit(dominant) * F.col("all"))).alias("deep"))
    each = rows.join(F.broadcast(deep), how="cross").groupBy(F.when(F.col("deep"), F.col("next")).otherwise(F.col("top")).alias("area"), "person").agg(F.sum("added").alias("lines"))
    owners = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("lines")).alias("order"), "person", "lines"))), lambda x: F.struct(x["person"].alias("person"), x["lines"].alias("lines")))
    return each.groupBy("area").agg(F.sum("lines").alias("lines"), F.count("*").alias("authors"), owners.alias("owners"))


def islands(area: DataFrame, min_lines: int = 200, min_share: float = 0.9) -> DataFrame:
    """area, owner, lines, share (percent, half-even): areas nearly of one hand."""
    first = F.get("owners", F.lit(0))
    share = X.ratio(first["lines"], F.col("lines"))
    return area.where((F.col("lines") >= min_lines) & (share >= min_share)).select("area", first["person"].alias("owner"), "lines", F.bround(100 * share, 0).cast("long").alias("share"))


def tied_owners(area: DataFrame, at: int = 0) -> DataFrame:
    """area, tied: owners with exactly the lines of the one at a position."""
    mark = F.get("owners", F.lit(at))["lines"]
    return area.select("area", F.size(F.filter("owners", lambda x: x["lines"] == mark)).cast("long").alias("tied"))


def gone(totals: DataFrame, now: DataFrame, months: int = 12) -> DataFrame:
    """People whose last commit is older than `months`."""
    return totals.join(F.broadcast(now), how="cross").where(F.col("last") < F.add_months("now", -months)).select("person", "last")


def lost(owned: DataFrame, left: DataFrame, base: int = 0) -> DataFrame:
    """area, lines, lost, share: lines of people who left."""
    marked = owned.where("added > 0").join(left.select("person", F.lit(True).alias("left")), "person", "left")
    out = marked.groupBy(X.area("path", 1, base).alias("area")).agg(F.sum("added").alias("lines"), F.sum(F.when(F.col("left"), F.col("added")).otherwise(0)).alias("lost"))
    return out.withColumn("share", F.col("lost") / F.col("lines"))


def new_areas(arrivals: DataFrame, now: DataFrame, months: int = 12) -> DataFrame:
    """area, first: areas whose first file came in the last months."""
    firsts = arrivals.groupBy(X.area("path", 2).alias("area")).agg(F.min("first").alias("first"))
    return firsts.join(F.broadcast(now), how="cross").where(F.col("first") >= F.add_months("now", -months)).select("area", "first")


def people_bands(totals: DataFrame) -> DataFrame:
    """band, people, commits: how commits spread over people."""
    n = F.col("commits")
    band = F.when(n >= 1000, "1000+").when(n >= 100, "100-999").when(n >= 10, "10-99").when(n >= 2, "2-9").when(n >= 1, "1").otherwise("0")
    return totals.groupBy(band.alias("band")).agg(F.count("*").alias("people"), F.sum("commits").alias("commits"))


def surviving_by_year(lines: DataFrame) -> DataFrame:
    return lines.groupBy("year").agg(F.sum("lines").alias("lines"))


def depth_for(paths: DataFrame, dominant: float = 0.8, base: int = 0) -> DataFrame:
    """One row, depth: 2 if one top directory holds `dominant` of the files, else 1."""
    tops = paths.groupBy(X.area("path", 1, base).alias("top")).agg(F.count("*").alias("n"))
    best = tops.agg(F.max_by("top", F.struct("n", "top")).alias("top"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.select(F.when((F.col("top") != "(root files)") & (F.col("n") >= F.lit(dominant) * F.col("all")), 2).otherwise(1).alias("depth"))


def owners_of(owned: DataFrame) -> DataFrame:
    """path, person, share, place: owners by lines added, names on ties."""
    path = W.partitionBy("path")
    return owned.withColumn("share", X.ratio(F.col("added"), F.sum("added").over(path))).withColumn("place", F.row_number().over(path.orderBy(F.desc("added"), "person"))).select("path", "person", "share", "place")
