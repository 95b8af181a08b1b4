"""Registered queries on joins, ownership, order, rankings, metrics, graphs, scans and rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import coupling as C
from ..operators import graph as G
from ..operators import history as H
from ..operators import identity as I
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import ownership as K
from ..operators import provenance as P
from ..operators import ranking as R
from ..operators import rules as U
from ..operators import scan as S
from ..operators.staging import staged
from ..sources.views import History
from .history_queries import FIXES, MONTHLY, PAIRS, SETS, TEST, WIDE, big, entropy_sql, rounded
from .prelude import sql

HOT = "hot AS (SELECT path, revs, code, complexity, coalesce(revs*code, -1) AS score FROM (SELECT path, count(*) AS revs FROM changes GROUP BY path) LEFT JOIN size_files USING (path))"
OWNED = "owned AS (SELECT path, person, CAST(sum(added) AS BIGINT) AS added FROM credits GROUP BY path, person)"
AREA1, AREA2 = "split_part(path, '/', 1)", "split_part(path, '/', 1) || '/' || split_part(path, '/', 2)"
AREAS = f"""{OWNED}, tops AS (SELECT {AREA1} AS top, sum(added) AS lines FROM owned WHERE added > 0 GROUP BY 1), deep AS (SELECT max(lines) >= 0.8 * sum(lines) AS deep FROM tops),
each AS (SELECT CASE WHEN deep THEN {AREA2} ELSE {AREA1} END AS area, person, CAST(sum(added) AS BIGINT) AS lines FROM owned, deep WHERE added > 0 GROUP BY 1, 2)"""
GONE = "gone AS (SELECT person, max(people.date) AS last FROM people GROUP BY person HAVING max(people.date) < (SELECT now FROM ending) - INTERVAL 3 DAY)"
WATCH = f"""{WIDE}, {FIXES}, {SETS}, {big(30)}, {PAIRS}, e AS (SELECT path, person, count(*) AS n FROM credits GROUP BY ALL), r AS (SELECT path, count(*) AS revs FROM changes GROUP BY path),
au AS (SELECT path, count(*) AS authors, count(*) FILTER (n*1e0/revs < 0.05) AS minor FROM e JOIN r USING (path) GROUP BY path), {OWNED},
ow AS (SELECT path, arg_max(person, (added, person)) AS owner, max(added) AS own, sum(added) AS alll FROM owned GROUP BY path),
so AS (SELECT path, count(*) FILTER (shared >= 2) AS partners FROM (SELECT a AS path, shared FROM pr UNION ALL SELECT b, shared FROM pr) GROUP BY path),
pe AS (SELECT path, count(DISTINCT year(date)*12+month(date)) AS periods FROM changes GROUP BY path),
st AS (SELECT key, bool_or({TEST}) AS tested FROM sets GROUP BY key), te AS (SELECT path, count(*) AS sets, count(*) FILTER (tested) AS with_tests FROM sets JOIN st USING (key) WHERE NOT ({TEST}) GROUP BY path),
wl AS (SELECT path, revs, coalesce(fixes, 0) AS fixes, coalesce(recent, 0) AS recent_fixes, authors, owner, coalesce(own*1e0/alll, 0e0) AS owner_share, coalesce(partners, 0) AS partners, code, complexity, coalesce(minor, 0) AS minor, sets, with_tests, periods,
  authors = 1 OR coalesce(own*1e0/alll, 0e0) >= 0.9 AS solo, 100e0*revs*code/sum(revs*code) OVER () AS score
  FROM r JOIN size_files USING (path) LEFT JOIN fx USING (path) LEFT JOIN au USING (path) LEFT JOIN ow USING (path) LEFT JOIN so USING (path) LEFT JOIN te USING (path) LEFT JOIN pe USING (path)
  WHERE revs >= 2 AND path IN (SELECT path FROM tree) AND NOT ({TEST}) AND path NOT LIKE '%.md')"""
COMPANIONS = """nf AS (SELECT path, count(*) AS r FROM few GROUP BY path), cp AS (SELECT a AS path, list(b ORDER BY c DESC, b) AS companions, list(c ORDER BY c DESC, b) AS confidences FROM (SELECT a, b, CAST(floor(100*shared/r+0.5) AS BIGINT) AS c, shared FROM (SELECT a, b, shared FROM pr UNION ALL SELECT b, a, shared FROM pr) JOIN nf ON nf.path = a)
WHERE shared >= 2 AND c >= 5 AND b IN (SELECT path FROM wl) GROUP BY a), wr AS (SELECT wl.*, companions, confidences FROM wl LEFT JOIN cp USING (path))"""
TIMES = "CASE {0} WHEN 1 THEN 'once' WHEN 2 THEN 'twice' ELSE format('{{:,}}', {0}) || ' times' END"
REASONS = f"""list_filter(['changed ' || {TIMES.format('revs')}, CASE WHEN recent_fixes > 0 THEN 'fixed ' || {TIMES.format('recent_fixes')} || ' in 6 months' WHEN fixes > 0 THEN 'fixed ' || {TIMES.format('fixes')} END,
  CASE WHEN authors = 1 THEN 'only ' || owner || ' has touched it' WHEN owner_share >= 0.9 THEN owner || ' wrote ' || CAST(round_even(100*owner_share, 0) AS BIGINT) || '% of it' END,
  CASE WHEN minor >= 3 THEN format('{{:,}} of {{:,}} authors are minor contributors', minor, authors) END,
  CASE WHEN sets >= 5 AND with_tests*1e0/sets <= 0.2 THEN CASE WHEN with_tests = 0 THEN format('no test changed in its {{:,}} changes', sets) ELSE format('a test changed in {{:,}} of its {{:,}} changes', with_tests, sets) END END,
  CASE WHEN len(companions) > 0 THEN 'changes with ' || companions[1] || ' (' || confidences[1] || '%)' || CASE len(companions) WHEN 1 THEN '' WHEN 2 THEN ' and 1 other' ELSE ' and ' || (len(companions) - 1) || ' others' END END,
  CASE WHEN partners >= 20 THEN format('changes alongside {{:,}} other files', partners) END, CASE WHEN periods >= 12 THEN 'changed in ' || periods || ' different months' END], lambda x: x IS NOT NULL)"""
RANKED = "rk AS (SELECT *, row_number() OVER (ORDER BY cost DESC, doc_id) AS place FROM ranked_docs)"
COMPANION = """nexts AS (SELECT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
both_ways AS (SELECT greatest(x, y) AS src, least(x, y) AS dst, count(*) AS n FROM nexts GROUP BY 1, 2), edges AS (SELECT src, min(dst) AS dst FROM both_ways JOIN (SELECT src, max(n) AS n FROM both_ways GROUP BY src) USING (src, n) GROUP BY src)"""
HANDOVER = """passes AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS n FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2),
edges AS (SELECT src, min(dst) AS dst FROM passes JOIN (SELECT src, max(n) AS n FROM passes GROUP BY src) USING (src, n) GROUP BY src)"""
CLOSURE = "WITH RECURSIVE "
AUTHORED = """own AS (SELECT path, person, count(*) AS dl FROM credits GROUP BY 1, 2), cr AS (SELECT path, arg_min(author, (date, pos)) AS creator FROM changes WHERE added > 0 GROUP BY path),
scored AS (SELECT own.path, person, 3.293e0 + 1.098e0*CASE WHEN person = creator THEN 1 ELSE 0 END + 0.164e0*dl - 0.321e0*ln(1 + sum(dl) OVER (PARTITION BY own.path) - dl) AS doa FROM own LEFT JOIN cr ON cr.path = own.path),
held AS (SELECT path, person FROM (SELECT *, max(doa) OVER (PARTITION BY path) AS most FROM scored) WHERE doa >= 3.293e0 AND doa >= 0.75e0*most)"""
LOCAL = "local AS (SELECT a, b FROM pr JOIN revs x ON x.path = a JOIN revs y ON y.path = b WHERE shared >= 1 AND floor(100*shared/((x.r+y.r)/2)+0.5) >= 1 AND regexp_replace(a, '/?[^/]*$', '') = regexp_replace(b, '/?[^/]*$', ''))"
TAIL = "least(1e0, (SELECT sum(exp(lgamma({n}+1) - lgamma(i+1) - lgamma({n}-i+1) + i*ln({p}) + ({n}-i)*ln(1e0-{p}))) FROM range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1) t(i)))"
STRATA = "o AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS i, count(*) OVER () AS n FROM size_files), cuts AS (SELECT code AS cut FROM o, range(1, 10) t(k) WHERE i = (n * k) // 10), strata AS (SELECT path, code, (SELECT count(*) FROM cuts WHERE cut <= code) AS stratum FROM size_files)"


def watch(h: History):
    h = h.held()
    sets = staged(C.changesets(h.changes).select("key", "path").withColumn("test", X.is_test_path("path")))
    revs = staged(H.revisions(h.changes))
    found = staged(C.pairs(sets))
    pool = R.watch_pool(revs, h.size_files, h.tree)
    beside = R.companion_side(C.companions(sets, 5, 2, found=found), pool)
    return R.watch_list(revs, h.size_files, h.tree, H.fixes(h.changes, h.now), H.authors(h.changes, h.credits), owned(h), C.sum_of_coupling(sets, 2, found=found), H.test_cochange(sets), H.change_entropy(H.month_periods(h.changes), h.now), beside, pool=pool)


def backtest(h: History):
    h = h.held()
    entropy = rounded(H.change_entropy(H.month_periods(h.changes), h.now), "hcm")
    return R.backtest(R.variants(watch(h), entropy), R.fixed_between(h.changes, H.fix_pool(h.changes), "2001-01-01", "2001-07-01").join(h.tree, "path", "left_semi"))


def change(h: History):
    """The risk of the first commits' files, and the watch list."""
    h = h.held()
    rows = staged(watch(h))
    return R.change_risk(h.changes.where("pos < 20"), rows, H.revisions(h.changes)), rows


def owned(h: History):
    return H.ownership(h.credits, h.now)


def nexts(h: History, column: str):
    """What stands on neighbouring lines of an order."""
    line = h.table("lineitem").select("l_orderkey", "l_linenumber", F.col(column).alias("x"))
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("x").alias("y"))
    return line.join(after, ["l_orderkey", "l_linenumber"]).where("x <> y")


def commonest_edge(pairs):
    """Of each src, the dst it has most often, the least of equals."""
    n = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.groupBy("src").agg(F.max_by("dst", F.struct("n", -F.col("dst"))).alias("dst"))


def imports(h: History):
    """A graph without loops: each file (part) and the one of a lesser key that stands beside it most often, over all orders."""
    return commonest_edge(nexts(h, "l_partkey").select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst")))


def handovers(h: History):
    """A graph with loops: each supplier and the one that most often comes next in an order, over all orders."""
    return commonest_edge(nexts(h, "l_suppkey").select(F.col("x").alias("src"), F.col("y").alias("dst")))


def docs_ranked(h: History):
    return M.ranked(h.ranked_docs, F.desc("cost"), F.asc("doc_id"))


def series(h: History):
    """path, date, value: running lines of a path after each change."""
    order = W.partitionBy("path").orderBy("date", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return h.changes.select("path", F.struct("date", "pos").alias("date"), F.sum(F.col("added") - F.col("deleted")).over(order).alias("value"))


def findings(h: History):
    h = h.held()
    sets = staged(C.changesets(h.changes))
    area = K.areas(owned(h))
    fx = H.fixes(h.changes, h.now)
    return (
        U.bug_magnets(fx, h.tree, 2, 3).unionByName(U.tight_coupling(C.coupling(sets, 2, 1), 5, 5)).unionByName(U.knowledge_islands(K.islands(area, 200, 0.05), area)).unionByName(U.dormant(h.now, "2003-01-01"))
        .unionByName(U.sweeping_commits(H.sweeps(h.changes, 9, tolerance=0.5))).unionByName(U.tangled_commits(H.tangled(h.changes, 5, 4, 2), h.commits, 0.001)).unionByName(U.bus_factor(owned(h), 0.04))
    )


def events_as_people(h: History):
    return h.table("customer").groupBy(F.concat(F.lit("Person "), F.col("c_nationkey").cast("string"), F.lit(" "), "c_mktsegment").alias("name"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("@mail.org")).alias("email")).agg(F.count("*").alias("commits"))


FINDINGS = f"""WITH {WIDE}, {FIXES}, {SETS}, {big(30)}, {PAIRS}, revs AS (SELECT path, count(*) AS r FROM sets GROUP BY path), {AREAS}, ar AS (SELECT area, sum(lines) AS lines, max(lines) AS top FROM each GROUP BY area), pp AS (SELECT person, sum(added) AS n FROM owned GROUP BY person),
wide AS (SELECT max(files) AS cut FROM (SELECT files, row_number() OVER (ORDER BY files) AS rn, count(*) OVER () AS n FROM totals) WHERE rn = greatest(1, CAST(ceil(0.99e0*n) AS BIGINT))),
tg AS (SELECT hash FROM changes WHERE subject LIKE 'feat%' GROUP BY hash HAVING count(*) >= 5 AND count(DISTINCT regexp_replace(path, '/?[^/]*$', '')) >= 4)
SELECT CASE WHEN recent >= 3 THEN 'warning' ELSE 'info' END AS severity, 'bug_magnets' AS rule, path AS subject FROM fx WHERE recent >= 2 AND NOT ({TEST}) AND path IN (SELECT path FROM tree)
UNION ALL SELECT 'warning', 'tight_coupling', a || ' <> ' || b FROM pr JOIN revs x ON x.path = a JOIN revs y ON y.path = b WHERE shared >= 2 AND floor(100*shared/((x.r+y.r)/2)+0.5) >= 5 AND floor((x.r+y.r)/2+0.5) >= 5 AND NOT regexp_matches(a, '(^|/)test_[^/]*$') AND NOT regexp_matches(b, '(^|/)test_[^/]*$')
UNION ALL SELECT 'info', 'knowledge_islands', area FROM ar WHERE lines >= 200 AND top*1e0/lines >= 0.05 AND lines >= 0.01 * (SELECT sum(lines) FROM ar)
UNION ALL SELECT 'warning', 'dormant', 'history' FROM ending WHERE now <= DATE '2002-01-01'
UNION ALL SELECT 'info', 'sweeping_commits', hash FROM totals, wide WHERE files >= greatest(9, wide.cut) AND abs(added - deleted) <= 0.5 * greatest(added, deleted)
UNION ALL SELECT 'info', 'tangled_commits', 'history' FROM (SELECT count(*) AS n FROM tg) WHERE n >= 5 AND n >= 0.001 * (SELECT count(*) FROM commits)
UNION ALL SELECT 'warning', 'bus_factor', person FROM (SELECT arg_max(person, (n, person)) AS person, max(n) AS top, sum(n) AS total FROM pp) WHERE total >= 200 AND top > 0.04 * total"""


QUERIES: dict[str, tuple] = {
    # joins and rankings
    "hotspots": (lambda h: R.hotspots(H.revisions(h.changes), h.size_files), f"WITH {HOT} SELECT * FROM hot"),
    "hotspots_top": (
        lambda h: R.top(R.hotspots(H.revisions(h.changes), h.size_files), 15, F.desc("score"), F.desc("revs"), F.asc("path")),
        f"WITH {HOT} SELECT * FROM hot ORDER BY score DESC, revs DESC, path LIMIT 15",
    ),
    "watch_list": (
        lambda h: rounded(watch(h), "owner_share", "score").withColumn("reasons", F.array_join("reasons", ", ")),
        f"WITH {WATCH}, {COMPANIONS} SELECT path, revs, fixes, recent_fixes, authors, minor, owner, round(owner_share, 6) AS owner_share, partners, code, complexity, solo, round(score, 6) AS score, array_to_string({REASONS}, ', ') AS reasons FROM wr",
    ),
    "watch_by_component": (
        lambda h: rounded(R.by_component(watch(h), min_share=4.0), "share").withColumn("files", F.array_join("files", ", ")),
        f"WITH {WATCH}, c AS (SELECT {AREA1} AS component, path, score, row_number() OVER (PARTITION BY {AREA1} ORDER BY score DESC, path) AS place FROM wl) SELECT component, round(sum(score), 6) AS share, array_to_string(list(path ORDER BY place) FILTER (place <= 3), ', ') AS files FROM c GROUP BY component HAVING sum(score) >= 4",
    ),
    "factor_product_max": (
        lambda h: rounded(R.factor_product(watch(h), "max"), "product"),
        f"WITH {WATCH} SELECT path, round(revs*1e0/max(revs) OVER () * (1 + coalesce(recent_fixes*1e0/nullif(max(recent_fixes) OVER (), 0), 0)) * (1 + coalesce(complexity*1e0/nullif(max(complexity) OVER (), 0), 0)) * CASE WHEN solo THEN 1.5e0 ELSE 1e0 END, 6) AS product FROM wl",
    ),
    "factor_product_rank": (
        lambda h: rounded(R.factor_product(watch(h), "rank"), "product"),
        f"WITH {WATCH} SELECT path, round(cume_dist() OVER (ORDER BY revs) * (1 + (rank() OVER (ORDER BY recent_fixes) - 1)*1e0/count(*) OVER ()) * (1 + (rank() OVER (ORDER BY complexity) - 1)*1e0/count(*) OVER ()) * CASE WHEN solo THEN 1.5e0 ELSE 1e0 END, 6) AS product FROM wl",
    ),
    "ranking_backtest": (
        lambda h: rounded(backtest(h), "expected"),
        entropy_sql(MONTHLY, "SELECT period, month, total, files, files AS size FROM whole", "power(0.5e0, greatest(0, year(now)*12+month(now) - sized.month))", "(n*1e0/sized.total)").replace("SELECT path, count(*) AS periods", ", en AS (SELECT path, count(*) AS periods", 1).rstrip()
        + f"), {WATCH}, "
        + "v AS (SELECT path, revs, unnest([{'variant': 'hotspot', 'key': score}, {'variant': 'churn', 'key': revs*1e0}, {'variant': 'size', 'key': code*1e0}, {'variant': 'recent fixes', 'key': recent_fixes*1e0}, {'variant': 'entropy', 'key': coalesce(hcm, 0e0)}, {'variant': 'smallest first', 'key': -code*1e0}], recursive := true) FROM wl LEFT JOIN en USING (path)), "
        + f"o AS (SELECT DISTINCT path FROM pool WHERE date >= DATE '2001-01-01' AND date < DATE '2001-07-01' AND NOT ({TEST}) AND path IN (SELECT path FROM tree)), m AS (SELECT variant, v.path, row_number() OVER (PARTITION BY variant ORDER BY key DESC, revs DESC, v.path) AS place, o.path IS NOT NULL AS hit FROM v LEFT JOIN o ON o.path = v.path) "
        + "SELECT variant, count(*) AS pool, count(*) FILTER (hit) AS positives, count(*) FILTER (hit AND place <= 15) AS hits, round(least(15, count(*))*1e0*count(*) FILTER (hit)/count(*), 6) AS expected, least(15, count(*), count(*) FILTER (hit)) AS best FROM m GROUP BY variant",
    ),
    "fixed_between": (lambda h: R.fixed_between(h.changes, H.fix_pool(h.changes), "2000-01-01", "2000-07-01"), f"WITH {WIDE} SELECT DISTINCT path FROM pool WHERE date >= DATE '2000-01-01' AND date < DATE '2000-07-01' AND NOT ({TEST})"),
    "change_risk": (
        lambda h: rounded(change(h)[0], "score", "owner_share").withColumn("place", F.col("place").cast("long")),
        f"WITH {WATCH}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, revs DESC, path) AS place FROM wl) SELECT t.path, round(coalesce(score, 0e0), 6) AS score, place, coalesce(place <= 15, false) AS watched, coalesce(recent_fixes, 0) AS recent_fixes, coalesce(fixes, 0) AS fixes, owner, round(coalesce(owner_share, 0e0), 6) AS owner_share, coalesce(minor, 0) AS minor, CASE WHEN score IS NULL THEN CASE WHEN r.revs = 1 THEN 'changed once' ELSE 'no revisions on record' END END AS reason FROM (SELECT DISTINCT path FROM changes WHERE pos < 20) t LEFT JOIN p USING (path) LEFT JOIN r ON r.path = t.path",
    ),
    "change_total": (
        lambda h: rounded(R.change_total(*change(h)), "total", "max_score"),
        f"WITH {WATCH}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, revs DESC, path) AS place FROM wl) SELECT round(sum(score), 6) AS total, count(*) FILTER (place <= 15) AS watched, round((SELECT max(score) FROM wl), 6) AS max_score, (SELECT count(*) FROM wl) AS pool FROM p WHERE path IN (SELECT path FROM changes WHERE pos < 20)",
    ),
    "change_factors": (
        lambda h: rounded(R.change_factors(h.changes, h.size_files), "entropy"),
        r"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS nucc, CASE WHEN row_number() OVER (PARTITION BY path, author ORDER BY pos) = 1 THEN 1 ELSE 0 END AS f, (added+deleted)*1e0/nullif(sum(added+deleted) OVER (PARTITION BY hash), 0) AS s,
          max(date) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > date - INTERVAL 1 MONTH AS young FROM changes), d AS (SELECT b.*, code, sum(f) OVER (PARTITION BY path ORDER BY pos) - f AS nd0 FROM b JOIN size_files USING (path)),
        p AS (SELECT hash, pos, author, subject, count(*) AS nf, count(DISTINCT regexp_replace(path, '/?[^/]*$', '')) AS nd, count(DISTINCT split_part(path, '/', 1)) AS ns, CAST(sum(added) AS BIGINT) AS la, CAST(sum(deleted) AS BIGINT) AS ld, CAST(sum(code) AS BIGINT) AS lt,
          sum(CASE WHEN s > 0 THEN -s*log2(s) ELSE 0 END) AS bits, CAST(max(nd0) AS BIGINT) AS ndev, CAST(sum(nucc) AS BIGINT) AS nuc, count(*) FILTER (young) AS age FROM d GROUP BY hash, pos, author, subject),
        t AS (SELECT hash, pos, author, split_part(path, '/', 1) AS sub, count(*) AS n FROM changes GROUP BY ALL), x AS (SELECT hash, CAST(sum(before) AS BIGINT) AS sexp FROM (SELECT hash, sum(n) OVER (PARTITION BY author, sub ORDER BY pos) - n AS before FROM t) GROUP BY hash)
        SELECT hash, nf, nd, ns, la, ld, lt, starts_with(subject, 'fix') AS fix, round(CASE WHEN nf > 1 THEN bits/log2(nf) ELSE 0 END, 6) AS entropy, ndev, nuc, age, CAST(row_number() OVER (PARTITION BY author ORDER BY pos) - 1 AS BIGINT) AS exp, sexp FROM p JOIN x USING (hash)""",
    ),
    "worst_of_group": (lambda h: R.worst_of_group(h.table("part"), "p_brand", "p_size", "p_name"), "SELECT p_brand, p_size, min(p_name) AS p_name FROM part WHERE (p_brand, p_size) IN (SELECT p_brand, max(p_size) FROM part GROUP BY p_brand) GROUP BY 1, 2"),
    "prefix_join": (
        lambda h: P.prefixed(h.commits.select("hash"), "hash", h.table("region").select(F.explode(F.array(F.concat(F.lit("o"), F.col("r_regionkey") + 1), F.concat(F.lit("o"), F.col("r_regionkey") + 1, F.lit("1")), F.concat(F.lit("o"), F.col("r_regionkey") + 1, F.lit("12")))).alias("short")), "short").groupBy("short").agg(F.count("*").alias("n")),
        "SELECT short, count(*) AS n FROM commits JOIN (SELECT 'o' || (r_regionkey + 1) || tail AS short FROM region, (VALUES (''), ('1'), ('12')) t(tail)) ON starts_with(hash, short) GROUP BY short",
    ),
    # ownership
    "areas": (
        lambda h: K.areas(owned(h)).withColumn("owners", F.array_join(F.transform("owners", lambda x: F.concat_ws(":", x["person"], x["lines"].cast("string"))), " ")),
        f"WITH {AREAS} SELECT area, CAST(sum(lines) AS BIGINT) AS lines, count(*) AS authors, string_agg(person || ':' || lines, ' ' ORDER BY lines DESC, person) AS owners FROM each GROUP BY area",
    ),
    "islands": (
        lambda h: K.islands(K.areas(owned(h)), 200, 0.05),
        f"WITH {AREAS}, a AS (SELECT area, sum(lines) AS lines, arg_max(person, (lines, -ord)) AS owner, max(lines) AS top FROM (SELECT *, row_number() OVER (ORDER BY person) AS ord FROM each) GROUP BY area) SELECT area, owner, CAST(lines AS BIGINT) AS lines, CAST(round_even(100e0*top/lines, 0) AS BIGINT) AS share FROM a WHERE lines >= 200 AND top*1e0/lines >= 0.05",
    ),
    "tied_owners": (lambda h: K.tied_owners(K.areas(owned(h))), f"WITH {AREAS}, m AS (SELECT area, max(lines) AS top FROM each GROUP BY area) SELECT area, count(*) AS tied FROM each JOIN m USING (area) WHERE lines = top GROUP BY area"),
    "gone_people": (lambda h: K.gone(H.author_totals(h.changes, h.people), h.now, 0), "SELECT person, max(date) AS last FROM people GROUP BY person HAVING max(date) < (SELECT now FROM ending)"),
    "lost_knowledge": (
        lambda h: rounded(K.lost(owned(h), K.gone(H.author_totals(h.changes, h.people), h.now, 0)), "share"),
        f"WITH {OWNED}, g AS (SELECT person FROM people GROUP BY person HAVING max(date) < (SELECT now FROM ending)) SELECT {AREA1} AS area, CAST(sum(added) AS BIGINT) AS lines, CAST(sum(CASE WHEN person IN (SELECT person FROM g) THEN added ELSE 0 END) AS BIGINT) AS lost, round(sum(CASE WHEN person IN (SELECT person FROM g) THEN added ELSE 0 END)*1e0/sum(added), 6) AS share FROM owned WHERE added > 0 GROUP BY 1",
    ),
    "new_areas": (lambda h: K.new_areas(H.arrivals(h.changes), h.now, 80), f"SELECT {AREA2} AS area, min(first) AS first FROM (SELECT path, min(date) AS first FROM changes GROUP BY path) GROUP BY 1 HAVING min(first) >= (SELECT now FROM ending) - INTERVAL 80 MONTH"),
    "people_bands": (lambda h: K.people_bands(H.author_totals(h.changes, h.people)), "SELECT CASE WHEN n >= 1000 THEN '1000+' WHEN n >= 100 THEN '100-999' WHEN n >= 10 THEN '10-99' WHEN n >= 2 THEN '2-9' WHEN n >= 1 THEN '1' ELSE '0' END AS band, count(*) AS people, CAST(sum(n) AS BIGINT) AS commits FROM (SELECT person, count(*) AS n FROM people GROUP BY person) GROUP BY 1"),
    "surviving_by_year": (
        lambda h: K.surviving_by_year(h.table("lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("long").alias("lines"))),
        "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines FROM lineitem GROUP BY 1",
    ),
    "area_depth": (lambda h: K.depth_for(h.tree), f"SELECT CASE WHEN max(n) >= 0.8*sum(n) THEN 2 ELSE 1 END AS depth FROM (SELECT {AREA1} AS top, count(*) AS n FROM tree GROUP BY 1)"),
    "file_owners": (
        lambda h: rounded(K.owners_of(owned(h)), "share").where("place <= 3"),
        f"WITH {OWNED} SELECT * FROM (SELECT path, person, round(added*1e0/nullif(sum(added) OVER (PARTITION BY path), 0), 6) AS share, CAST(row_number() OVER (PARTITION BY path ORDER BY added DESC, person) AS INTEGER) AS place FROM owned) WHERE place <= 3",
    ),
    # order
    "nearest_rank": (lambda h: H.nearest_rank(H.totals(h.changes), "files", 0.99), "SELECT max(files) AS cut FROM (SELECT files, row_number() OVER (ORDER BY files) AS rn, count(*) OVER () AS n FROM (SELECT hash, count(*) AS files FROM changes GROUP BY hash)) WHERE rn = CAST(ceil(0.99e0*n) AS BIGINT)"),
    "size_strata": (
        lambda h: O.strata(h.size_files, "path", "code"),
        "WITH o AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS i, count(*) OVER () AS n FROM size_files), cuts AS (SELECT code AS cut FROM o, range(1, 10) t(k) WHERE i = (n * k) // 10) SELECT path, code, (SELECT count(*) FROM cuts WHERE cut <= code) AS stratum FROM size_files",
    ),
    "value_shares": (
        lambda h: rounded(O.shares(h.size_files, "code", "path"), "at_most", "below"),
        "SELECT path, round(cume_dist() OVER (ORDER BY code), 6) AS at_most, round((rank() OVER (ORDER BY code) - 1)*1e0/count(*) OVER (), 6) AS below FROM size_files",
    ),
    "sessions": (
        lambda h: O.sessions(h.events),
        "WITH e AS (SELECT *, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS start, max(ts) AS stop FROM f GROUP BY 1, 2",
    ),
    "author_bursts": (
        lambda h: O.bursts(h.events, gap="6 hours", least=3),
        "WITH e AS (SELECT *, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS start, max(ts) AS stop FROM f GROUP BY 1, 2 HAVING count(*) >= 3",
    ),
    "next_touch": (
        lambda h: O.next_touch(h.changes),
        "SELECT path, count(*) AS touches, count(*) FILTER (datediff('day', date, later) <= 14) AS again FROM (SELECT path, date, lead(date) OVER (PARTITION BY path ORDER BY date, pos) AS later FROM changes) GROUP BY path",
    ),
    "year_change": (
        lambda h: O.year_change(series(h).select("path", F.col("date.date").alias("date"), "value").groupBy("path", "date").agg(F.max("value").alias("value")), h.now),
        "WITH s AS (SELECT path, date, sum(added-deleted) OVER (PARTITION BY path ORDER BY date, pos ROWS UNBOUNDED PRECEDING) AS value FROM changes), t AS (SELECT path, date, CAST(max(value) AS BIGINT) AS value FROM s GROUP BY 1, 2) SELECT path, arg_max(value, date) FILTER (date <= now - INTERVAL 12 MONTH) AS before, arg_max(value, date) AS after FROM t, ending GROUP BY path HAVING count(*) FILTER (date <= now - INTERVAL 12 MONTH) > 0",
    ),
    "running_distinct": (
        lambda h: O.running_distinct(h.changes.select(X.month_number("date").alias("month"), "path"), "month", "path"),
        "WITH f AS (SELECT m, count(*) AS new FROM (SELECT path, min(year(date)*12+month(date)) AS m FROM changes GROUP BY path) GROUP BY m), a AS (SELECT DISTINCT year(date)*12+month(date) AS m FROM changes) SELECT CAST(a.m AS INTEGER) AS month, CAST(sum(coalesce(new,0)) OVER (ORDER BY a.m) AS BIGINT) AS seen FROM a LEFT JOIN f ON f.m = a.m",
    ),
    "rolling_distinct": (
        lambda h: O.rolling_distinct(h.changes.select(X.month_number("date").alias("month"), "path"), "month", "path"),
        "WITH c AS (SELECT DISTINCT year(date)*12+month(date) AS m, path FROM changes), a AS (SELECT DISTINCT m FROM c) SELECT CAST(a.m AS INTEGER) AS month, count(DISTINCT path) AS seen FROM a JOIN c ON c.m BETWEEN a.m - 5 AND a.m GROUP BY a.m",
    ),
    # measures of rankings
    "headroom": (
        lambda h: rounded(M.headroom(docs_ranked(h)), "expected", "headroom"),
        f"WITH {RANKED}, n AS (SELECT count(*) AS pool, CAST(sum(outcome) AS BIGINT) AS positives, CAST(sum(CASE WHEN place <= 15 THEN outcome ELSE 0 END) AS BIGINT) AS hits FROM rk) SELECT pool, positives, hits, round(least(15,pool)*1e0*positives/pool, 6) AS expected, least(15, pool, positives) AS best, round((hits - least(15,pool)*1e0*positives/pool)/nullif(least(15,pool,positives) - least(15,pool)*1e0*positives/pool, 0), 6) AS headroom FROM n",
    ),
    "auc": (lambda h: rounded(M.auc(docs_ranked(h)), "auc"), f"WITH {RANKED}, w AS (SELECT outcome, sum(1-outcome) OVER (ORDER BY place) AS above FROM rk) SELECT round(1 - sum(outcome*above)*1e0/(sum(outcome)*sum(1-outcome)), 6) AS auc FROM w"),
    "recall_at_effort": (lambda h: rounded(M.recall_at_effort(docs_ranked(h)), "recall"), f"WITH {RANKED}, w AS (SELECT outcome, sum(cost) OVER (ORDER BY place) AS spent, sum(cost) OVER () AS total FROM rk) SELECT round(sum(CASE WHEN spent <= 0.2*total THEN outcome ELSE 0 END)*1e0/sum(outcome), 6) AS recall FROM w"),
    "popt": (
        lambda h: rounded(M.popt(h.ranked_docs, "doc_id", F.desc("cost"), F.asc("doc_id")), "popt"),
        "WITH o AS (SELECT 'own' AS k, *, row_number() OVER (ORDER BY cost DESC, doc_id) AS place FROM ranked_docs UNION ALL SELECT 'best', *, row_number() OVER (ORDER BY outcome DESC, cost, doc_id) FROM ranked_docs UNION ALL SELECT 'worst', *, row_number() OVER (ORDER BY outcome, cost DESC, doc_id DESC) FROM ranked_docs), c AS (SELECT k, cost*1e0/sum(cost) OVER (PARTITION BY k) AS dx, (sum(outcome) OVER (PARTITION BY k ORDER BY place) - outcome/2e0)/sum(outcome) OVER (PARTITION BY k) AS y FROM o), a AS (SELECT k, sum(dx*y) AS area FROM c GROUP BY k) SELECT round(1 - ((SELECT area FROM a WHERE k='best') - (SELECT area FROM a WHERE k='own'))/((SELECT area FROM a WHERE k='best') - (SELECT area FROM a WHERE k='worst')), 6) AS popt",
    ),
    "initial_false_alarms": (lambda h: M.initial_false_alarms(M.ranked(h.ranked_docs.withColumn("outcome", F.col("toxic")), F.asc("cost"), F.asc("doc_id"))), "SELECT CAST(coalesce(min(place) FILTER (toxic = 1) - 1, count(*)) AS BIGINT) AS ifa FROM (SELECT toxic, row_number() OVER (ORDER BY cost, doc_id) AS place FROM ranked_docs)"),
    "spearman": (
        lambda h: rounded(M.spearman(docs_ranked(h).where("lang = 'en'"), M.ranked(h.ranked_docs, F.asc("source"), F.asc("doc_id")), "doc_id"), "rho"),
        f"WITH {RANKED}, s AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS p FROM ranked_docs), b AS (SELECT row_number() OVER (ORDER BY place) AS a, row_number() OVER (ORDER BY p) AS b FROM rk JOIN s USING (doc_id) WHERE lang = 'en') SELECT round(CASE WHEN count(*) >= 3 THEN 1 - 6*sum(power(a-b, 2))/(count(*)*1e0*(count(*)*count(*)-1)) END, 6) AS rho FROM b",
    ),
    "jaccard": (
        lambda h: rounded(M.jaccard(h.ranked_docs.where("outcome = 1"), h.ranked_docs.where("toxic = 1 OR lang = 'en'"), "doc_id"), "jaccard"),
        "SELECT round(count(*) FILTER (outcome = 1 AND (toxic = 1 OR lang = 'en'))*1e0/count(*) FILTER (outcome = 1 OR toxic = 1 OR lang = 'en'), 6) AS jaccard FROM ranked_docs",
    ),
    "wilson_by_source": (
        lambda h: rounded(M.wilson_by(h.ranked_docs, "source", "outcome"), "low", "high"),
        "WITH n AS (SELECT source, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS successes, sum(outcome)*1e0/count(*) AS p FROM ranked_docs GROUP BY source), w AS (SELECT *, greatest(0, (p + 3.8416e0/(2*n) - 1.96e0*sqrt(p*(1-p)/n + 3.8416e0/(4e0*n*n)))/(1+3.8416e0/n)) AS lo, least(1, (p + 3.8416e0/(2*n) + 1.96e0*sqrt(p*(1-p)/n + 3.8416e0/(4e0*n*n)))/(1+3.8416e0/n)) AS hi FROM n) SELECT source, n, successes, round(lo, 6) AS low, round(hi, 6) AS high, CASE WHEN lo >= 0.8 THEN 'sound' WHEN hi < 0.8 THEN 'broken' ELSE 'undecided' END AS verdict FROM w",
    ),
    "kappa": (lambda h: rounded(M.kappa(h.ranked_docs, "outcome", "toxic"), "kappa"), "WITH n AS (SELECT count(*)*1e0 AS n, count(*) FILTER (outcome = toxic) AS same, sum(outcome) AS pa, sum(toxic) AS pb FROM ranked_docs), c AS (SELECT same/n AS agree, (pa*pb + (n-pa)*(n-pb))/(n*n) AS chance FROM n) SELECT round((agree - chance)/nullif(1 - chance, 0), 6) AS kappa FROM c"),
    "median_p90": (lambda h: rounded(M.median_and_p90(h.ranked_docs, "lang", "cost"), "median", "p90"), "SELECT lang, round(quantile_cont(cost, 0.5), 6) AS median, round(quantile_cont(cost, 0.9), 6) AS p90 FROM ranked_docs GROUP BY lang"),
    "benjamini_hochberg": (
        lambda h: M.benjamini_hochberg(h.table("customer").groupBy("c_nationkey").agg((F.try_divide(F.count_if(F.col("c_acctbal") < 0), F.count("*"))).alias("p")), "c_nationkey", "p", 0.3).select("c_nationkey", F.round("p", 6).alias("p")),
        "WITH v AS (SELECT c_nationkey, count(*) FILTER (c_acctbal < 0)*1e0/count(*) AS p FROM customer GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY p, c_nationkey) AS i, count(*) OVER () AS m FROM v) SELECT c_nationkey, round(p, 6) AS p FROM o WHERE i <= (SELECT max(i) FROM o WHERE p <= 0.3e0*i/m)",
    ),
    "decile_outcomes": (lambda h: M.standardised(docs_ranked(h)), f"WITH {RANKED} SELECT CAST(floor((place-1)*10/n) AS BIGINT) AS decile, count(*) AS n, CAST(sum(outcome) AS BIGINT) AS observed FROM (SELECT *, count(*) OVER () AS n FROM rk) GROUP BY 1"),
    "fix_prone": (
        lambda h: rounded(M.fix_prone(H.revisions(h.changes).join(H.fixes(h.changes, h.now).select("path", "fixes"), "path", "left").na.fill(0).join(O.strata(h.size_files, "path", "code").select("path", "stratum"), "path").select("path", "stratum", "fixes", F.col("revs").alias("changes")), q=0.9), "p"),
        f"WITH {WIDE}, {FIXES}, {STRATA}, b AS (SELECT path, stratum, coalesce(fixes, 0) AS k, revs AS n FROM (SELECT path, count(*) AS revs FROM changes GROUP BY path) LEFT JOIN fx USING (path) JOIN strata USING (path)), t AS (SELECT *, sum(k) OVER (PARTITION BY stratum)*1e0/sum(n) OVER (PARTITION BY stratum) AS rate FROM b), v AS (SELECT path, CASE WHEN k <= 0 THEN 1e0 ELSE {TAIL.format(n='n', k='k', p='rate')} END AS p FROM t), w AS (SELECT *, row_number() OVER (ORDER BY p, path) AS i, count(*) OVER () AS m FROM v) SELECT path, round(p, 6) AS p FROM w WHERE i <= (SELECT max(i) FROM w WHERE p <= 0.9e0*i/m)",
    ),
    "binomial_tail": (
        lambda h: rounded(h.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("k")).select("c_nationkey", M.binomial_tail("k", "n", F.lit(0.1)).alias("p")), "p"),
        f"WITH b AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS k FROM customer GROUP BY 1) SELECT c_nationkey, round({TAIL.format(n='n', k='k', p='0.1e0')}, 6) AS p FROM b",
    ),
    "hypergeometric_tail": (
        lambda h: rounded(M.headroom(docs_ranked(h)).select("hits", M.hypergeometric_tail("pool", "positives", F.least(F.lit(15), "pool"), "hits").alias("p")), "p"),
        f"WITH {RANKED}, n AS (SELECT count(*) AS pool, sum(outcome) AS positives, CAST(sum(CASE WHEN place <= 15 THEN outcome ELSE 0 END) AS BIGINT) AS hits FROM rk), c AS (SELECT pool, positives, hits, least(15, pool) AS k FROM n) SELECT hits, round((SELECT sum(exp(lgamma(positives+1) - lgamma(i+1) - lgamma(positives-i+1) + lgamma(pool-positives+1) - lgamma(k-i+1) - lgamma(pool-positives-k+i+1) - lgamma(pool+1) + lgamma(k+1) + lgamma(pool-k+1))) FROM range(hits, CAST(least(positives, k) AS BIGINT) + 1) t(i)), 6) AS p FROM c",
    ),
    # graphs
    "coupled_components": (
        lambda h: G.components(handovers(h).select(F.col("src").alias("a"), F.col("dst").alias("b"))),
        f"{CLOSURE}{HANDOVER}, s AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a) SELECT a AS node, least(a, min(b)) AS root FROM r GROUP BY a",
    ),
    "file_components": (
        lambda h: G.components(imports(h).select(F.col("src").alias("a"), F.col("dst").alias("b"))),
        f"{CLOSURE}{COMPANION}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src), t AS (SELECT src AS node, min(dst) AS root FROM r GROUP BY src) SELECT node, root FROM t UNION SELECT dst, dst FROM edges WHERE dst NOT IN (SELECT src FROM edges)",
    ),
    "dependents": (
        lambda h: G.dependents(imports(h)),
        f"{CLOSURE}{COMPANION}, r AS (SELECT src, dst, 1 AS d FROM edges UNION ALL SELECT r.src, e.dst, d + 1 FROM r JOIN edges e ON r.dst = e.src) SELECT dst AS node, count(*) FILTER (d = 1) AS direct, count(*) AS all FROM r GROUP BY dst",
    ),
    "reachability": (lambda h: G.reachable(imports(h)), f"{CLOSURE}{COMPANION}, r AS (SELECT src, dst, 1 AS depth FROM edges UNION ALL SELECT r.src, e.dst, depth + 1 FROM r JOIN edges e ON r.dst = e.src) SELECT src, dst, depth FROM r"),
    "strong_components": (
        lambda h: G.strong_components(handovers(h)),
        f"{CLOSURE}{HANDOVER}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src) SELECT a.src AS node, least(min(a.src), min(a.dst)) AS root FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src",
    ),
    "shortest_loops": (
        lambda h: G.shortest_loops(handovers(h)),
        f"{CLOSURE}{HANDOVER}, r AS (SELECT src, dst, 1 AS depth FROM edges UNION SELECT r.src, e.dst, depth + 1 FROM r JOIN edges e ON r.dst = e.src WHERE r.src <> r.dst AND depth < 1000) SELECT src AS node, min(depth) AS length FROM r WHERE src = dst GROUP BY src",
    ),
    "truck_factor": (
        lambda h: rounded(G.truck_factor(H.degree_of_authorship(h.changes, h.credits).where("is_author").select("path", "person")), "orphaned"),
        f"WITH {AUTHORED}, n AS (SELECT person, row_number() OVER (ORDER BY count(*) DESC, person) AS step FROM held GROUP BY person), f AS (SELECT path, max(step) AS step FROM held JOIN n USING (person) GROUP BY path), s AS (SELECT n.step, person, (SELECT count(*) FROM f WHERE f.step <= n.step) AS upto, (SELECT count(*) FROM f WHERE f.step < n.step) AS before, (SELECT count(*) FROM f)*1e0 AS total FROM n) SELECT CAST(step AS INTEGER) AS step, person, round(upto/total, 6) AS orphaned FROM s WHERE before/total <= 0.5",
    ),
    "coupling_clusters": (
        lambda h: rounded(C.clusters(C.coupling(C.changesets(h.changes), 1, 1), 3, 0.1), "density"),
        f"{CLOSURE}{SETS}, {big(30)}, {PAIRS}, revs AS (SELECT path, count(*) AS r FROM sets GROUP BY path), {LOCAL}, both_ways AS (SELECT a, b FROM local UNION SELECT b, a FROM local), r AS (SELECT a, b FROM both_ways UNION SELECT r.a, s.b FROM r JOIN both_ways s ON r.b = s.a), g AS (SELECT a AS node, least(a, min(b)) AS root FROM r GROUP BY a), n AS (SELECT root, count(*) AS files FROM g GROUP BY root), i AS (SELECT root, count(*) AS pairs FROM local JOIN g ON node = a GROUP BY root) SELECT root AS cluster, files, pairs, round(pairs/(files*(files-1)/2e0), 6) AS density FROM n JOIN i USING (root) WHERE files >= 3 AND pairs/(files*(files-1)/2e0) >= 0.1",
    ),
    "unreferenced": (
        lambda h: G.unreferenced(h.table("part").select(F.col("p_partkey").alias("path")), imports(h), h.table("part").where("p_size = 1").select(F.col("p_partkey").alias("path"))),
        f"WITH {COMPANION} SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges) AND p_size <> 1",
    ),
    "identity_merge": (lambda h: I.merge(events_as_people(h)), "WITH p AS (SELECT 'Person ' || c_nationkey || ' ' || c_mktsegment AS name, c_mktsegment || c_nationkey || '@mail.org' AS email, count(*) AS commits FROM customer GROUP BY 1, 2) SELECT name, email, commits, arg_max(name, (commits, -o)) OVER (PARTITION BY key) AS head_name, arg_max(email, (commits, -o)) OVER (PARTITION BY key) AS head_email FROM (SELECT *, split_part(name, ' ', 3) AS key, row_number() OVER (ORDER BY name, email) AS o FROM p)"),
    # scans
    "ipv4_literals": (lambda h: S.addresses(h.table("documents"), "doc_id", "text"), r"WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\d.])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?:[^\d.]|$)', 1)) AS address FROM documents), o AS (SELECT *, list_transform(string_split(address, '.'), lambda x: CAST(x AS INTEGER)) AS q FROM a) SELECT doc_id, address, count(*) AS n FROM o WHERE list_max(q) <= 255 AND q[1] NOT IN (0, 127, 255) AND NOT ((q[1]=192 AND q[2]=0 AND q[3]=2) OR (q[1]=198 AND q[2]=51 AND q[3]=100) OR (q[1]=203 AND q[2]=0 AND q[3]=113)) GROUP BY 1, 2"),
    "email_shapes": (lambda h: S.emails(h.table("documents"), "doc_id", "text"), r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1))) AS email FROM documents"),
    "licence_phrases": (lambda h: S.licences(h.table("documents"), "doc_id", "text"), "SELECT * FROM (SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{n}'" for n, p in S.LICENCES) + " END AS licence FROM documents) WHERE licence IS NOT NULL"),
    "line_census": (lambda h: S.lines(h.table("documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.trim("line") == "").alias("blank")), "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS BIGINT) AS blank FROM documents"),
    # rules and what compares findings
    "rule_bug_magnets": (lambda h: U.bug_magnets(H.fixes(h.changes, h.now), h.tree, 2, 3).select("severity", "rule", "subject"), f"WITH {WIDE}, {FIXES} SELECT CASE WHEN recent >= 3 THEN 'warning' ELSE 'info' END AS severity, 'bug_magnets' AS rule, path AS subject FROM fx WHERE recent >= 2 AND NOT ({TEST}) AND path IN (SELECT path FROM tree)"),
    "rule_dormant": (lambda h: U.dormant(h.now, "2003-01-01").select("severity", "rule", "subject"), "SELECT 'warning' AS severity, 'dormant' AS rule, 'history' AS subject FROM ending WHERE now <= DATE '2002-01-01'"),
    "rule_placeholder_identity": (lambda h: U.placeholder_identity(events_as_people(h).withColumn("email", F.when(F.col("commits") % 3 == 0, "root@host").otherwise(F.col("email"))), 0.001).select("severity", "rule", "subject"), "WITH p AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) SELECT 'info' AS severity, 'placeholder_identity' AS rule, 'root@host' AS subject FROM p WHERE n % 3 = 0 AND n >= 0.001 * (SELECT sum(n) FROM p)"),
    "rule_islands": (lambda h: U.knowledge_islands(K.islands(K.areas(owned(h)), 200, 0.05), K.areas(owned(h))).select("severity", "rule", "subject"), f"WITH {AREAS}, a AS (SELECT area, sum(lines) AS lines, max(lines) AS top FROM each GROUP BY area) SELECT 'info' AS severity, 'knowledge_islands' AS rule, area AS subject FROM a WHERE lines >= 200 AND top*1e0/lines >= 0.05 AND lines >= 0.01 * (SELECT sum(lines) FROM a)"),
    "rule_tight_coupling": (
        lambda h: U.tight_coupling(C.coupling(C.changesets(h.changes), 2, 1), 3, 5).select("severity", "rule", "subject"),
        f"WITH {SETS}, {big(30)}, {PAIRS}, revs AS (SELECT path, count(*) AS r FROM sets GROUP BY path) SELECT 'warning' AS severity, 'tight_coupling' AS rule, a || ' <> ' || b AS subject FROM pr JOIN revs x ON x.path = a JOIN revs y ON y.path = b WHERE shared >= 2 AND floor(100*shared/((x.r+y.r)/2)+0.5) >= 3 AND floor((x.r+y.r)/2+0.5) >= 5 AND NOT regexp_matches(a, '(^|/)test_[^/]*$') AND NOT regexp_matches(b, '(^|/)test_[^/]*$')",
    ),
    "findings": (lambda h: findings(h).select("severity", "rule", "subject"), FINDINGS),
    "baseline": (lambda h: U.against_baseline(U.sweeping_commits(h.commits.where("pos % 5 = 0")), U.sweeping_commits(h.commits.where("pos % 3 = 0"))).select("rule", "subject"), "SELECT 'sweeping_commits' AS rule, hash AS subject FROM commits WHERE pos % 5 = 0 AND pos % 3 <> 0"),
    "compare": (
        lambda h: U.compare(U.sweeping_commits(h.commits.where("pos % 7 = 0")), U.sweeping_commits(h.commits.where("pos % 5 = 0"))),
        "SELECT 'sweeping_commits' AS rule, hash AS subject, CASE WHEN pos % 7 <> 0 THEN 'new' WHEN pos % 5 <> 0 THEN 'resolved' ELSE 'persisting' END AS change FROM commits WHERE pos % 7 = 0 OR pos % 5 = 0",
    ),
}
QUERIES = {name: (build, text and (sql(text.replace("WITH RECURSIVE ", "WITH ", 1)).replace("WITH paths", "WITH RECURSIVE paths", 1) if text.startswith(CLOSURE) else sql(text))) for name, (build, text) in QUERIES.items()}
