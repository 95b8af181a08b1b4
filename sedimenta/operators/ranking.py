"""Hotspots, the watch list, its variants and the risk of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import metrics as M
from .staging import staged


def hotspots(revs: DataFrame, sizes: DataFrame) -> DataFrame:
    """path, revs, code, complexity, score = revs * code; -1 for a file of no size."""
    out = revs.join(sizes, "path", "left")
    return out.select("path", "revs", "code", "complexity", F.coalesce(F.col("revs") * F.col("code"), F.lit(-1)).cast("long").alias("score"))


#: Floors of the reasons on the watch list; fixed values.
SOLO, MINOR, COMPLEX, GROWN, NESTED, DEBT, TESTED_SETS, TESTED_SHARE, PARTNERS, DEFINITIONS, LATE, LATE_SHARE, MONTHS = 0.9, 3, 10, 25, 5, 3, 5, 0.2, 20, 60, 3, 0.25, 12


def _many(n: Column | str) -> Column:
    return F.format_number(n, 0)


def times(n: str) -> Column:
    """once, twice, 3 times."""
    return F.when(F.col(n) == 1, "once").when(F.col(n) == 2, "twice").otherwise(F.concat(_many(n), F.lit(" times")))


def watch_reasons() -> Column:
    """Why a file is worth a look, the most actionable first: its changes and fixes, its owner, what is complex in it, what its tests do, what it changes with."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    c = F.col
    signed = lambda n: F.concat(F.when(c(n) >= 0, "+").otherwise(""), c(n).cast("string"))
    others = F.size("companions") - 1
    first = F.get("companions", F.lit(0))
    reasons = [
        (F.lit(True), said("changed ", times("revs"))),
        (c("recent_fixes") > 0, said("fixed ", times("recent_fixes"), " in 6 months")),
        ((c("recent_fixes") == 0) & (c("fixes") > 0), said("fixed ", times("fixes"))),
        (c("authors") == 1, F.when(c("owner").isNull(), "one author only").otherwise(said("only ", c("owner"), " has touched it"))),
        ((c("authors") != 1) & (c("owner_share") >= SOLO), said(c("owner"), " wrote ", F.bround(100 * c("owner_share"), 0).cast("long").cast("string"), "% of it")),
        (c("minor") >= MINOR, said(_many("minor"), " of ", _many("authors"), " authors are minor contributors")),
        (c("function.ccn") >= COMPLEX, said(c("function.function"), "() complexity ", _many("function.ccn"))),
        (c("grown") >= GROWN, said(signed("grown"), "% summed complexity in a year", F.when(c("code_grown").isNull(), "").otherwise(said(", code ", signed("code_grown"), "%")))),
        (c("deepest.nesting") >= NESTED, said(c("deepest.name"), "() nested ", c("deepest.nesting").cast("string"), " deep")),
        (c("debt") >= DEBT, said(_many("debt"), " TODO/FIXME comments")),
        ((c("sets") >= TESTED_SETS) & (X.ratio(c("with_tests"), c("sets")) <= TESTED_SHARE), F.when(c("with_tests") == 0, said("no test changed in its ", _many("sets"), " changes")).otherwise(said("a test changed in ", _many("with_tests"), " of its ", _many("sets"), " changes"))),
        (others >= 0, said("changes with ", first["companion"], " (", first["confidence"].cast("string"), "%)", F.when(others == 0, "").otherwise(said(" and ", others.cast("string"), F.when(others == 1, " other").otherwise(" others"))))),
        (c("partners") >= PARTNERS, said("changes alongside ", _many("partners"), " other files")),
        (c("definitions") >= DEFINITIONS, said("defines ", _many("definitions"), " functions and classes")),
        ((c("late") >= LATE) & (X.ratio(c("late"), c("late_revs")) >= LATE_SHARE), said(F.bround(100 * c("late") / c("late_revs"), 0).cast("long").cast("string"), "% of its changes made between midnight and 4 am")),
        (c("periods") >= MONTHS, said("changed in ", c("periods").cast("string"), " different months")),
    ]
    return F.array_compact(F.array(*[F.when(when, text) for when, text in reasons]))


#: Sides of the watch list that not every report has, with what stands for an absent one.
SIDES = {"function": "struct<function:string,ccn:bigint>", "grown": "bigint", "code_grown": "bigint", "deepest": "struct<name:string,nesting:bigint>", "debt": "bigint", "definitions": "bigint", "late": "bigint", "late_revs": "bigint", "companions": "array<struct<companion:string,confidence:bigint>>"}


def watch_pool(revs: DataFrame, sizes: DataFrame, tree: DataFrame, min_revs: int = 2) -> DataFrame:
    """Files (path, revs, code, complexity) that the watch list ranks: of a size, in the tree, changed `min_revs` times, neither tests nor documents.

    Written, so that what joins it doesn't take the patterns over as filters of its own and ask them of every change.
    """
    return staged(revs.where(F.col("revs") >= min_revs).join(sizes, "path").join(tree, "path", "left_semi").where(~X.is_test_path("path") & ~X.is_doc_path("path")))


def watch_list(revs: DataFrame, sizes: DataFrame, tree: DataFrame, fixes: DataFrame, authors: DataFrame, owners: DataFrame, soc: DataFrame, tests: DataFrame, periods: DataFrame, *sides: DataFrame, min_revs: int = 2, solo_share: float = SOLO, pool: DataFrame | None = None) -> DataFrame:
    """Files in use with their share of revisions times code, and the reasons to look at them.

    Every side is one row a path, so all joins hash on `path`. `sides` bring any
    of the columns of SIDES; companions that aren't on the list are left out.
    `pool` is the watch_pool, if held already.
    """
    pool = watch_pool(revs, sizes, tree, min_revs) if pool is None else pool
    top = owners.groupBy("path").agg(F.max_by("person", F.struct("added", F.col("person"))).alias("owner"), F.max("added").alias("own"), F.sum("added").alias("all"))
    rows = pool.join(fixes.select("path", "fixes", F.col("recent").alias("recent_fixes")), "path", "left").join(authors.select("path", "authors", "minor"), "path", "left").join(top, "path", "left")
    rows = rows.join(soc.select("path", "partners"), "path", "left").join(tests, "path", "left").join(periods.select("path", "periods"), "path", "left").na.fill(0, ["fixes", "recent_fixes", "partners", "minor"])
    for side in sides:
        rows = rows.join(side, "path", "left")
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in SIDES.items() if c not in rows.columns})
    rows = rows.withColumn("owner_share", F.coalesce(X.ratio(F.col("own"), F.col("all")), F.lit(0.0)))
    solo = (F.col("authors") == 1) | (F.col("owner_share") >= solo_share)
    rows = staged(rows.withColumn("solo", solo))
    rows = rows.join(F.broadcast(rows.agg(F.sum(F.col("revs") * F.col("code")).alias("mass"))), how="cross")  # one row
    score = X.ratio(100 * F.col("revs") * F.col("code"), F.col("mass"))
    return rows.select("path", "revs", "fixes", "recent_fixes", "authors", "minor", "owner", "owner_share", "partners", "code", "complexity", "solo", score.alias("score"), watch_reasons().alias("reasons"))


def companion_side(companions: DataFrame, pool: DataFrame) -> DataFrame:
    """path, companions of files of the pool (path), the surest first."""
    files = staged(pool.where(~X.is_test_path("path")).select(F.col("path").alias("companion")))  # asked of the pool, not of every pair
    held = companions.join(files, "companion", "left_semi")
    order = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("n"), "companion", F.col("confidence").cast("long").alias("confidence"))))
    return held.groupBy(F.col("entity").alias("path")).agg(F.transform(order, lambda x: F.struct(x["companion"].alias("companion"), x["confidence"].alias("confidence"))).alias("companions"))


def function_side(functions: DataFrame) -> DataFrame:
    """path, function: the most complex function of each file, suspect spans aside."""
    sure = functions.where(~F.coalesce("suspect", F.lit(False)))
    return sure.groupBy(F.col("file").alias("path")).agg(F.max_by(F.struct("function", "ccn"), F.struct("ccn", (-F.col("start")).alias("s"))).alias("function"))


def nesting_side(functions: DataFrame) -> DataFrame:
    """path, deepest: the most deeply nested function of each file."""
    return functions.groupBy(F.col("file").alias("path")).agg(F.max_by(F.struct("name", "nesting"), F.struct("nesting", (-F.col("start")).alias("s"))).alias("deepest"))


def growth_side(trend: DataFrame) -> DataFrame:
    """path, grown, code_grown: percent by which complexity and code grew within a year, of (path, before, after, code_before, code_after)."""
    percent = lambda a, b: F.bround(X.ratio(100 * (F.col(b) - F.col(a)), F.col(a)), 0).cast("long")
    return trend.select("path", percent("before", "after").alias("grown"), percent("code_before", "code_after").alias("code_grown"))


def top(ranked: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by a total order."""
    return ranked.orderBy(*order).limit(k)


def by_component(rows: DataFrame, depth: int = 1, min_share: float = 5.0, files: int = 3, base: int = 0) -> DataFrame:
    """component, share, files: score shares of directories, with their first files."""
    named = rows.withColumn("component", X.area("path", depth, base))
    place = F.row_number().over(W.partitionBy("component").orderBy(F.desc("score"), "path"))
    first = named.withColumn("place", place).where(F.col("place") <= files)
    shares = named.groupBy("component").agg(F.sum("score").alias("share")).where(F.col("share") >= min_share)
    return shares.join(first.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("files")), "component")


def factor_product(rows: DataFrame, scaling: str = "max", solo_weight: float = 1.5) -> DataFrame:
    """path, product: churn * (1 + fixes) * (1 + complexity) * 1.5 if owned by one; factors scaled by their maximum or rank.

    Ranks come from a histogram of each factor's values, so no window orders all rows.
    """

    def scaled(df: DataFrame, column: str, inclusive: bool) -> DataFrame:
        if scaling == "max":
            most = df.agg(F.max(column).alias("m"))
            return df.join(F.broadcast(most), how="cross").withColumn(f"s_{column}", F.coalesce(X.ratio(F.col(column), F.col("m")), F.lit(0.0))).drop("m")
        counted = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
        upto = counted.withColumn("upto", F.sum("k").over(W.orderBy("v"))).withColumn("n", F.sum("k").over(W.partitionBy()))
        share = (F.col("upto") if inclusive else F.col("upto") - F.col("k")) / F.col("n")
        return df.join(upto.select(F.col("v").alias(column), share.alias(f"s_{column}")), column)

    out = rows.select("path", "revs", "recent_fixes", "complexity", "solo")
    for column, inclusive in (("revs", True), ("recent_fixes", False), ("complexity", False)):
        out = scaled(out, column, inclusive)
    product = F.col("s_revs") * (1 + F.col("s_recent_fixes")) * (1 + F.col("s_complexity")) * F.when(F.col("solo"), solo_weight).otherwise(1.0)
    return out.select("path", product.alias("product"))


def variants(rows: DataFrame, entropy: DataFrame) -> DataFrame:
    """variant, path, key: the pool under several orderings, each by key, then revs, then path."""
    held = rows.join(entropy.select("path", "hcm"), "path", "left").na.fill(0.0, ["hcm"])
    keys = {"hotspot": F.col("score"), "churn": F.col("revs"), "size": F.col("code"), "recent fixes": F.col("recent_fixes"), "entropy": F.col("hcm"), "smallest first": -F.col("code")}
    return held.select("path", "revs", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), k.cast("double").alias("key")) for n, k in keys.items()])).alias("v")).select("v.variant", "path", "revs", "v.key")


def placed(ranked: DataFrame, groups: list[str], *order: Column) -> DataFrame:
    return ranked.withColumn("place", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))


def fixed_between(changes: DataFrame, pool: DataFrame, start: str, end: str) -> DataFrame:
    """Paths fixed in [start, end), tests left out."""
    paths = staged(pool.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.lit(end).cast("date"))).select("path").distinct())
    return paths.where(~X.is_test_path("path"))


def backtest(ranked: DataFrame, outcome: DataFrame, k: int = 15) -> DataFrame:
    """variant, pool, positives, hits, expected, best: the first k of each ordering held against what came."""
    marked = M.ranked(ranked, F.desc("key"), F.desc("revs"), F.asc("path"), by=("variant",)).join(outcome.withColumn("hit", F.lit(1)), "path", "left")
    out = marked.groupBy("variant").agg(F.count("*").alias("pool"), F.count("hit").alias("positives"), F.count_if(F.col("hit").isNotNull() & (F.col("place") <= k)).alias("hits"))
    many = F.least(F.lit(k), "pool")
    return out.select("variant", "pool", "positives", "hits", (many * F.col("positives") / F.col("pool")).alias("expected"), F.least(F.lit(k), "pool", "positives").alias("best"))


def change_risk(touched: DataFrame, rows: DataFrame, revs: DataFrame, kinds: DataFrame | None = None, watched: int = 15) -> DataFrame:
    """path, score, place, watched, recent_fixes, fixes, owner, owner_share, minor, reason: a change's files on the watch list, and why others aren't."""
    placed = M.ranked(rows, F.desc("score"), F.desc("revs"), F.asc("path"))
    out = touched.select("path").distinct().join(placed.drop("revs"), "path", "left").join(revs.select("path", "revs"), "path", "left")
    out = out.join(kinds.select("path", F.col("reason").alias("kind")), "path", "left") if kinds is not None else out.withColumn("kind", F.lit(None).cast("string"))
    why = F.when(F.col("score").isNotNull(), None).otherwise(F.coalesce("kind", F.when(F.col("revs") == 1, "changed once").otherwise("no revisions on record")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("path", F.coalesce("score", F.lit(0.0)).alias("score"), "place", F.coalesce(F.col("place") <= watched, F.lit(False)).alias("watched"), zero("recent_fixes"), zero("fixes"), "owner", F.coalesce("owner_share", F.lit(0.0)).alias("owner_share"), zero("minor"), why.alias("reason"))


def change_total(risk: DataFrame, rows: DataFrame) -> DataFrame:
    """total, watched, max_score, pool of a change."""
    most = rows.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"), F.count("*").alias("pool"))
    return risk.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.count_if("watched").alias("watched")).join(most, how="cross")


def running(rows: DataFrame, key: list[str], order: str, **sums: str) -> DataFrame:
    """rows with running sums (name=column) by key in the order of a whole number, each row's own left out.

    The order is cut into ranges: sums of whole ranges first, rows within a
    range after, so a key with any number of rows is never one task's.
    """
    blocked = rows.withColumn("_range", F.shiftright(F.col(order).cast("long"), 14))
    per = blocked.groupBy(*key, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = per.select(*key, "_range", *[(F.sum(f"_{n}").over(W.partitionBy(*key).orderBy("_range")) - F.col(f"_{n}")).alias(f"_{n}") for n in sums])
    own = W.partitionBy(*key, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = blocked.select(*blocked.columns, *[(F.sum(c).over(own) - F.col(c)).alias(f"__{n}") for n, c in sums.items()]).join(before, [*key, "_range"])
    return out.select(*rows.columns, *[(F.col(f"__{n}") + F.col(f"_{n}")).alias(n) for n in sums])


#: Changes of a path from which its history is cut into parts, so that no task holds all of it.
HEAVY = 1 << 20


def _before(changes: DataFrame, heavy: int) -> DataFrame:
    """changes with ndev, nuc, last: people, changes and the last date of a path before each of its changes."""
    hashed = changes.withColumn("_h", F.xxhash64("path"))
    long = staged(hashed.groupBy("_h").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("_h", F.lit(True).alias("_long")))
    key = ["path"]
    if not long.isEmpty():
        key = ["path", "_part"]
        part = F.when(F.col("_long"), F.shiftright(F.col("pos").cast("long"), 20)).otherwise(F.lit(-1).cast("long"))
        hashed = hashed.join(F.broadcast(long), "_h", "left").withColumn("_part", part)  # at most a row for `heavy` changes
        own = hashed.where("_long")
        since = staged(own.groupBy("path", "author").agg(F.min("_part").alias("_since")))
        sums = own.groupBy("path", "_part").agg(F.count("*").alias("n"), F.max("date").alias("d")).join(since.groupBy("path", F.col("_since").alias("_part")).agg(F.count("*").alias("k")), ["path", "_part"], "left")
        earlier = W.partitionBy("path").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        carried = sums.select("path", "_part", F.sum("k").over(earlier).alias("_k"), F.sum("n").over(earlier).alias("_n"), F.max("d").over(earlier).alias("_d"))
        hashed = hashed.join(F.broadcast(since), ["path", "author"], "left").join(F.broadcast(carried), ["path", "_part"], "left")
    else:
        hashed = hashed.withColumns({"_since": F.lit(None).cast("long"), "_part": F.lit(-1).cast("long"), "_k": F.lit(None).cast("long"), "_n": F.lit(None).cast("long"), "_d": F.lit(None).cast("date")})
    new = (F.row_number().over(W.partitionBy(*key, "author").orderBy("pos")) == 1) & ~F.coalesce(F.col("_part") > F.col("_since"), F.lit(False))
    upto = W.partitionBy(*key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = hashed.repartition(*key).withColumn("_new", new.cast("long"))
    return out.select(*changes.columns, (zero(F.sum("_new").over(upto)) + zero(F.col("_k"))).alias("ndev"), (F.count(F.lit(1)).over(upto) + zero(F.col("_n"))).alias("nuc"), F.greatest(F.max("date").over(upto), "_d").alias("last"))


def change_factors(changes: DataFrame, sizes: DataFrame | None = None, heavy: int = HEAVY) -> DataFrame:
    """A commit's size, spread and history: hash, nf, nd, ns, la, ld, lt, fix, entropy, ndev, nuc, age, exp, sexp.

    lt is the lines its files have in `sizes`, ndev the most people who had
    touched one of them, nuc their changes before, age how many were changed in
    the month before, exp and sexp the author's commits before and their changes
    in these subsystems. Changes travel twice: by path, for what came before,
    and by ranges of commits, for all that is counted in a commit.
    """
    changes = staged(changes.select("hash", "pos", "date", "author", X.is_fix("subject").alias("fix"), "path", "added", "deleted"))
    before = _before(changes, heavy)
    before = before.join(sizes.select("path", "code"), "path", "left") if sizes is not None else before.withColumn("code", F.lit(0))
    lines = F.col("added") + F.col("deleted")
    dealt = before.select(
        F.shiftright(F.col("pos").cast("long"), 14).alias("_range"), "hash", "pos", "author", "fix", X.area("path", 1).alias("subsystem"), X.folder("path").alias("folder"), "added", "deleted",
        F.coalesce("code", F.lit(0)).alias("code"), "ndev", "nuc", F.coalesce(F.col("last") > F.add_months("date", -1), F.lit(False)).cast("long").alias("young"),
    ).repartition("_range")
    shared = dealt.withColumn("bits", X.shannon(F.coalesce(X.ratio(lines, F.sum(lines).over(W.partitionBy("_range", "hash"))), F.lit(0.0))))
    commit = ["hash", "pos", "author", "fix"]
    added = {"la": "added", "ld": "deleted", "lt": "code", "bits": "bits", "nuc": "nuc", "age": "young"}
    folders = shared.groupBy("_range", *commit, "subsystem", "folder").agg(F.count("*").alias("nf"), F.max("ndev").alias("ndev"), *[F.sum(c).alias(n) for n, c in added.items()])
    sums = [F.sum("nf").alias("nf"), F.max("ndev").alias("ndev"), *[F.sum(n).alias(n) for n in added]]
    touched = staged(folders.groupBy("_range", *commit, "subsystem").agg(F.count("*").alias("nd"), *sums).drop("_range"))
    told = touched.groupBy("hash").agg(F.first("fix").alias("fix"), F.sum("nd").alias("nd"), F.count("*").alias("ns"), *sums)
    # commits before count as one more subsystem, so that both run in one pass
    work = touched.select("hash", "pos", "author", "subsystem", F.lit(False).alias("whole"), F.col("nf").alias("n"))
    work = work.unionByName(touched.select("hash", "pos", "author").distinct().select("*", F.lit("").alias("subsystem"), F.lit(True).alias("whole"), F.lit(1).cast("long").alias("n")))
    past = running(work, ["author", "whole", "subsystem"], "pos", before="n").groupBy("hash").agg(F.sum(F.when(F.col("whole"), F.col("before"))).alias("exp"), F.sum(F.when(~F.col("whole"), F.col("before"))).alias("sexp"))
    return told.join(past, "hash").select("hash", "nf", "nd", "ns", "la", "ld", F.col("lt").cast("long").alias("lt"), "fix", F.when(F.col("nf") > 1, F.col("bits") / F.log2("nf")).otherwise(0.0).alias("entropy"), "ndev", "nuc", "age", "exp", "sexp")


def amalgamations(functions: DataFrame, min_shared: int = 20, min_sources: int = 2, min_share: float = 0.9) -> DataFrame:
    """file, shared, sources: files nearly all of whose signatures are found in other files."""
    held = functions.select("file", "signature").distinct()
    total = held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= min_shared)
    spread = held.groupBy("signature").agg(F.count("*").alias("files")).where("files > 1")
    shared = held.join(spread, "signature")
    counts = shared.groupBy("file").agg(F.count("*").alias("shared")).join(total, "file").where((F.col("shared") >= min_shared) & (X.ratio(F.col("shared"), F.col("n")) >= min_share))
    # the other files of those that qualify, which are few
    others = shared.join(counts.select("file"), "file", "left_semi").join(held.withColumnRenamed("file", "other"), "signature").where("file <> other")
    sources = others.groupBy("file").agg(F.countDistinct("other").alias("sources")).where(F.col("sources") >= min_sources)
    return counts.join(sources, "file").select("file", "shared", "sources")


def worst_of_group(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The row of each key with the greatest value, the first name on ties."""
    best = rows.groupBy(key).agg(F.max(value).alias(value))
    return rows.join(best, [key, value]).groupBy(key, value).agg(F.min(name).alias(name))
