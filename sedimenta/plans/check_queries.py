"""Registered queries on checks, provenance and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import history as Hi
from ..operators import hygiene as H
from ..operators import metrics as M
from ..operators import provenance as P
from ..operators import ranking as R
from ..operators import rules as U
from .history_queries import FIX, TEST, TOTALS, rounded
from .prelude import sql
from .report_queries import HOT

LATER = "later AS (SELECT hash, date, path, lead(date) OVER (PARTITION BY path ORDER BY date, pos) AS next FROM changes)"


def kinds(h):
    return H.file_kinds(h.paths.select("path"), h.paths.where("p_size = 3").select("path"), h.paths.where("p_size = 4").select("path"), h.tree)


KINDS = f"""kinds AS (SELECT path, list_filter([CASE WHEN {TEST} THEN 'test' END, CASE WHEN path LIKE '%.md' THEN 'doc' END, CASE WHEN path IN (SELECT path FROM paths WHERE p_size = 3) THEN 'vendored' END,
  CASE WHEN path IN (SELECT path FROM paths WHERE p_size = 4) THEN 'generated' END, CASE WHEN path NOT IN (SELECT path FROM tree) THEN 'gone' END], lambda x: x IS NOT NULL) AS reasons FROM (SELECT DISTINCT path FROM paths))"""


def tops(h):
    """The five busiest paths of each year."""
    n = h.changes.groupBy(F.year("date").alias("cut"), "path").agg(F.count("*").alias("n"))
    return R.placed(n, ["cut"], F.desc("n"), F.asc("path")).where("place <= 5").select("cut", "path")


QUERIES: dict[str, tuple] = {
    "file_kinds": (lambda h: kinds(h).withColumn("reasons", F.array_join("reasons", ",")), f"WITH {KINDS} SELECT path, array_to_string(reasons, ',') AS reasons, reasons[1] AS reason FROM kinds"),
    "kind_coverage": (lambda h: H.coverage(kinds(h), h.size_files), f"WITH {KINDS} SELECT coalesce(reasons[1], 'ranked') AS reason, count(*) AS files, CAST(sum(coalesce(code, 0)) AS BIGINT) AS lines FROM kinds LEFT JOIN size_files USING (path) GROUP BY 1"),
    "type_census": (lambda h: H.type_census(h.tree), r"SELECT regexp_extract(path, '\.([^.]+)$', 1) AS type, count(*) AS files FROM tree GROUP BY 1"),
    "cohort_comparison": (
        lambda h: P.cohorts(h.commits, h.changes, h.commits.where("pos % 5 = 0"), h.commits.where("pos % 11 = 0")),
        f"WITH {LATER}, t AS (SELECT hash, count(*) AS touches, count(*) FILTER (datediff('day', date, next) <= 14) AS again FROM later GROUP BY hash) SELECT pos % 5 = 0 AS marked, count(*) AS commits, count(*) FILTER ({FIX}) AS fixes, count(*) FILTER (pos % 11 = 0) AS reverted, CAST(sum(coalesce(touches, 0)) AS BIGINT) AS touches, CAST(sum(coalesce(again, 0)) AS BIGINT) AS again FROM commits LEFT JOIN t USING (hash) GROUP BY 1",
    ),
    "commit_shape": (
        lambda h: rounded(P.commit_shape(h.events.select(F.col("user_id").alias("author"), "ts", F.col("event_id").alias("pos"), F.concat("event_type", F.lit(": x")).alias("subject")), "12 hours", 3), "burst_share", "typed_share"),
        "WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), f AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e), r AS (SELECT user_id, run, count(*) AS n FROM f GROUP BY 1, 2) SELECT (SELECT count(*) FROM events) AS commits, round(sum(CASE WHEN n >= 3 THEN n ELSE 0 END)*1e0/sum(n), 6) AS burst_share, 0e0 AS typed_share, (SELECT count(DISTINCT hour(ts)) FROM events) AS hours FROM r",
    ),
    "convention": (
        lambda h: rounded(P.convention(h.commits), "low"),
        r"WITH n AS (SELECT count(*)*1e0 AS n, count(*) FILTER (regexp_matches(subject, '^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(\([^)]*\))?!?:')) AS typed FROM commits), w AS (SELECT *, typed/n AS p, 1.959964e0*1.959964e0 AS zz FROM n), l AS (SELECT *, greatest(0, (p + zz/(2*n) - 1.959964e0*sqrt(p*(1-p)/n + zz/(4*n*n)))/(1+zz/n)) AS lo FROM w) SELECT typed, CAST(n AS BIGINT) AS n, round(lo, 6) AS low, lo >= 0.9 AS typed_history FROM l",
    ),
    "labelled_paths": (
        lambda h: P.labelled(h.commits, h.changes, h.commits.where("pos % 40 = 0").select("hash", F.lit(None).cast("string").alias("path")).unionByName(h.changes.where("pos = 7").select(F.lit("o7").alias("hash"), "path")).unionByName(h.spark.createDataFrame([("o99", None)], "hash string, path string")), "1996-01-01", "1998-01-01"),
        "WITH named AS (SELECT DISTINCT path FROM changes WHERE pos = 7), dated AS (SELECT * FROM changes WHERE date >= DATE '1996-01-01' AND date < DATE '1998-01-01'), whole AS (SELECT hash FROM commits) SELECT path FROM dated WHERE pos % 40 = 0 UNION SELECT path FROM dated WHERE path IN (SELECT path FROM named) AND CASE WHEN 'o7' IN (SELECT hash FROM whole) THEN hash = 'o7' ELSE starts_with(hash, 'o7') END UNION SELECT path FROM dated WHERE CASE WHEN 'o99' IN (SELECT hash FROM whole) THEN hash = 'o99' ELSE starts_with(hash, 'o99') END",
    ),
    "carry_over": (
        lambda h: rounded(P.carry_over(tops(h)), "overlap"),
        "WITH n AS (SELECT year(date) AS cut, path, count(*) AS n FROM changes GROUP BY 1, 2), t AS (SELECT cut, path FROM (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY n DESC, path) AS place FROM n) WHERE place <= 5), o AS (SELECT cut, lead(cut) OVER (ORDER BY cut) AS nxt FROM (SELECT DISTINCT cut FROM t)), b AS (SELECT nxt AS cut, path FROM t JOIN o USING (cut) WHERE nxt IS NOT NULL), u AS (SELECT cut, path FROM b UNION SELECT cut, path FROM t WHERE cut IN (SELECT cut FROM b)), s AS (SELECT cut, path FROM b INTERSECT SELECT cut, path FROM t) SELECT CAST(cut AS INTEGER) AS cut, round((SELECT count(*) FROM s WHERE s.cut = u.cut)*1e0/count(*), 6) AS overlap FROM u GROUP BY cut",
    ),
    "ranking_misses": (
        lambda h: P.misses(R.placed(R.hotspots(Hi.revisions(h.changes), h.size_files), [], F.desc("score"), F.desc("revs"), F.asc("path")), h.tree.where(F.startswith("path", F.lit("brand_1/")))),
        f"WITH {HOT}, r AS (SELECT path, CAST(row_number() OVER (ORDER BY score DESC, revs DESC, path) AS INTEGER) AS place FROM hot) SELECT t.path, place FROM tree t LEFT JOIN r USING (path) WHERE starts_with(t.path, 'brand_1/') AND (place IS NULL OR place > 15)",
    ),
    "remediation": (
        lambda h: rounded(P.pooled(P.remediation(U.sweeping_commits(h.paths.select(F.col("path").alias("hash"))), U.sweeping_commits(h.paths.where("p_size % 4 = 0").select(F.col("path").alias("hash"))), h.tree, h.spark.createDataFrame([], "old string, new string"))), "low", "high"),
        "WITH b AS (SELECT DISTINCT path FROM paths), n AS (SELECT count(*)*1e0 AS n, count(*) FILTER (path NOT IN (SELECT path FROM paths WHERE p_size % 4 = 0) AND path IN (SELECT path FROM tree)) AS resolved FROM b), w AS (SELECT *, resolved/n AS p FROM n) SELECT 'sweeping_commits' AS rule, CAST(n AS BIGINT) AS n, resolved, round(greatest(0, (p + 3.8416e0/(2*n) - 1.96e0*sqrt(p*(1-p)/n + 3.8416e0/(4*n*n)))/(1+3.8416e0/n)), 6) AS low, round(least(1, (p + 3.8416e0/(2*n) + 1.96e0*sqrt(p*(1-p)/n + 3.8416e0/(4*n*n)))/(1+3.8416e0/n)), 6) AS high FROM w",
    ),
    "blame_shares": (
        lambda h: rounded(P.blame_shares(h.people.groupBy("hash", F.year("date").alias("year")).agg(F.collect_list("person").alias("people"))), "lines"),
        "SELECT CAST(year(date) AS INTEGER) AS year, person, round(sum(1e0/people), 6) AS lines FROM people GROUP BY 1, 2",
    ),
    "commit_totals": (lambda h: Hi.totals(h.changes), f"WITH {TOTALS} SELECT * FROM totals"),
    "version_order": (
        lambda h: h.table("part").select("p_partkey", F.concat((F.col("p_size") % 7).cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), F.lit("-rc"), "p_size").alias("version")).groupBy(F.get(X.version_key("version"), F.lit(0)).alias("major")).agg(F.max_by("version", X.version_key("version")).alias("latest")),
        "SELECT CAST(p_size % 7 AS BIGINT) AS major, arg_max((p_size % 7) || '.' || (p_partkey % 13) || '-rc' || p_size, [p_size % 7, p_partkey % 13, p_size]) AS latest FROM part GROUP BY 1",
    ),
}
QUERIES = {name: (build, sql(text)) for name, (build, text) in QUERIES.items()}
