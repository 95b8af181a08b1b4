"""Co-change: logical changesets and what changes together.

Pairs come from an equi-join of a changeset with itself, after changesets over
`most` paths are left out, so a set of n paths costs at most most² / 2 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import graph


def changesets(changes: DataFrame) -> DataFrame:
    """key, path, added, deleted, commits: changes under one ticket, else of one author on one day."""
    key = F.coalesce(X.ticket_key("subject"), F.concat_ws("|", "author", F.col("date").cast("string")))
    return changes.groupBy(key.alias("key"), "path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.count("*").alias("commits"))


def small(sets: DataFrame, most: int = 30) -> DataFrame:
    sizes = sets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return sets.join(sizes.select("key"), "key", "left_semi")


def pairs(sets: DataFrame, most: int = 30) -> DataFrame:
    """a, b, shared: paths a < b and the changesets they share.

    Changesets are cut to those of `most` paths before their paths are
    gathered, so a row holds at most that many, and the pairs unfold from it
    without a join.
    """
    few = small(sets, most).groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("p"))
    later = lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return few.select(F.explode(F.flatten(F.transform("p", later))).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("shared"))


def _counted(found: DataFrame, revs: DataFrame) -> DataFrame:
    out = found.join(revs.select(F.col("path").alias("a"), F.col("revs").alias("ra")), "a").join(revs.select(F.col("path").alias("b"), F.col("revs").alias("rb")), "b")
    mean = (F.col("ra") + F.col("rb")) / 2
    return out.withColumn("degree", X.half_up(100 * F.col("shared") / mean)).withColumn("average_revs", X.half_up(mean))


def coupling(sets: DataFrame, min_shared: int = 5, min_degree: int = 30, most: int = 30, found: DataFrame | None = None) -> DataFrame:
    """entity, coupled, degree, average_revs, shared; revisions count in changesets of any size. `found` are the pairs, if held already."""
    revs = sets.groupBy("path").agg(F.count("*").alias("revs"))
    out = _counted((pairs(sets, most) if found is None else found).where(F.col("shared") >= min_shared), revs).where(F.col("degree") >= min_degree)
    return out.select(F.col("a").alias("entity"), F.col("b").alias("coupled"), "degree", "average_revs", "shared")


def companions(sets: DataFrame, min_confidence: int = 70, min_shared: int = 20, most: int = 30, found: DataFrame | None = None) -> DataFrame:
    """entity, companion, confidence, shared: of the entity's small changesets, the share that hold the companion."""
    found = (pairs(sets, most) if found is None else found).where(F.col("shared") >= min_shared)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    revs = small(sets, most).groupBy(F.col("path").alias("a")).agg(F.count("*").alias("revs"))
    out = both.join(revs, "a").withColumn("confidence", X.half_up(100 * F.col("shared") / F.col("revs"))).where(F.col("confidence") >= min_confidence)
    return out.select(F.col("a").alias("entity"), F.col("b").alias("companion"), "confidence", "shared")


def sum_of_coupling(sets: DataFrame, min_shared: int = 5, most: int = 30, found: DataFrame | None = None) -> DataFrame:
    """path, soc, partners: shared changesets over all partners, and partners with enough of them."""
    found = pairs(sets, most) if found is None else found
    both = found.select(F.col("a").alias("path"), "shared").union(found.select("b", "shared"))
    return both.groupBy("path").agg(F.sum("shared").alias("soc"), F.count_if(F.col("shared") >= min_shared).alias("partners"))


def components(sets: DataFrame, min_shared: int = 10, min_degree: int = 20, most: int = 10, base: int = 0) -> DataFrame:
    """Coupling of directories at depths 1 and 2; root files, and pairs of which one holds the other, are left out."""
    out = None
    for depth in (1, 2):
        cut = sets.select("key", X.area("path", depth, base).alias("path")).where("path <> '(root files)'").distinct()
        one = coupling(cut, min_shared, min_degree, most).withColumn("depth", F.lit(depth))
        out = one if out is None else out.unionByName(one)
    nested = F.startswith("coupled", F.concat("entity", F.lit("/"))) | F.startswith("entity", F.concat("coupled", F.lit("/")))
    return out.where(~nested)


def gaps(coupled: DataFrame, touched: DataFrame) -> DataFrame:
    """file, companion, degree: companions of touched paths that are not touched."""
    both = coupled.select("entity", "coupled", "degree").union(coupled.select("coupled", "entity", "degree")).toDF("file", "companion", "degree")
    paths = touched.select("path").distinct()
    return both.join(paths, F.col("file") == F.col("path"), "left_semi").join(paths, F.col("companion") == F.col("path"), "left_anti")


def clusters(coupled: DataFrame, min_files: int = 4, min_density: float = 0.8) -> DataFrame:
    """cluster, files, pairs, density: groups of coupled paths of one directory that are nearly complete."""
    local = coupled.where(X.folder("entity") == X.folder("coupled")).select(F.col("entity").alias("a"), F.col("coupled").alias("b"))
    groups = graph.components(local)
    inner = local.join(groups.withColumnRenamed("node", "a"), "a").groupBy("root").agg(F.count("*").alias("pairs"))
    sized = groups.groupBy("root").agg(F.count("*").alias("files")).join(inner, "root")
    density = F.col("pairs") / (F.col("files") * (F.col("files") - 1) / 2)
    return sized.select(F.col("root").alias("cluster"), "files", "pairs", density.alias("density")).where((F.col("files") >= min_files) & (F.col("density") >= min_density))


def companion_grid(found: DataFrame, revs: DataFrame, grid: DataFrame) -> DataFrame:
    """confidence, shared, rows, files: how many directed pairs each cell of a threshold grid leaves."""
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    rated = both.join(revs.withColumnRenamed("path", "a"), "a").withColumn("c", X.half_up(100 * F.col("shared") / F.col("revs")))
    held = rated.select("a", "c", F.col("shared").alias("s")).join(F.broadcast(grid), (F.col("c") >= F.col("confidence")) & (F.col("s") >= F.col("shared")))
    return held.groupBy("confidence", "shared").agg(F.count("*").alias("rows"), F.countDistinct("a").alias("files"))


def leave_one_out(sets: DataFrame, rules: DataFrame, most: int = 20) -> DataFrame:
    """asked, answered, right: for each changeset and path left out, whether companions of the rest name it."""
    few = small(sets, most).select("key", "path")
    many = few.groupBy("key").agg(F.count("*").alias("n")).where("n >= 2").select("key")
    few = few.join(many, "key", "left_semi")
    told = few.select("key", F.col("path").alias("entity")).join(rules.select("entity", "companion"), "entity")
    asked = few.withColumnRenamed("path", "out")
    named = asked.join(told, "key").where("entity <> out").groupBy("key", "out").agg(F.bool_or(F.col("companion") == F.col("out")).alias("hit"))
    return asked.join(named, ["key", "out"], "left").agg(F.count("*").alias("asked"), F.count("hit").alias("answered"), F.count_if("hit").alias("right"))


def regime(commits: DataFrame, merges: int) -> DataFrame:
    """regime, squash_share: squash with few merges and most subjects numbered; merge from a tenth of merges; else linear."""
    held = commits.agg(F.count("*").alias("n"), F.count_if(F.col("subject").rlike(r"\(#\d+\)\s*$")).alias("s"))
    merge, squash = F.lit(merges) / F.col("n"), F.col("s") / F.col("n")
    return held.select(F.when((merge < 0.02) & (squash >= 0.5), "squash").when(merge >= 0.1, "merge").otherwise("linear").alias("regime"), squash.alias("squash_share"))
