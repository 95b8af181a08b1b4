"""Registered queries on the change history, each with its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import coupling as C
from ..operators import history as H
from ..sources.views import History
from .prelude import sql

FIX = r"regexp_matches(subject, '^(fix|hotfix|bugfix)(\([^)]*\))?!?:', 'i') OR regexp_matches(subject, '\b(fix|fixes|fixed|fixing|bugfix|hotfix|bug|bugs|regression|crash|crashes)\b', 'i')"
CLAUSES = r"list_sum(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(subject, '^\w+(\([^)]*\))?!?:\s*', ''), '\s*\(#\d+\)\s*$', ''), '\s*[;,&+]\s*'), lambda x: 1 + len(list_filter(regexp_split_to_array(x, '\s+and\s+')[2:], lambda y: len(regexp_split_to_array(trim(y), '\s+')) >= 2))))"
TEST = r"regexp_matches(path, '(^|/)test_[^/]*$')"
TOTALS = "totals AS (SELECT hash, count(*) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM changes GROUP BY hash)"
MONTHS = "greatest(0, (year({b})-year({a}))*12 + month({b}) - month({a}) - CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)"
TICKET = r"""coalesce('#' || nullif(regexp_extract(subject, '\(#(\d+)\)\s*$', 1), ''), nullif(regexp_extract(subject, '^\s*[\[(]?([A-Z][A-Z0-9]+-\d+)\b', 1), ''),
  '#' || nullif(regexp_extract(subject, '(?i)\b(?:fixes|fixed|closes|closed|refs|resolves|resolved)\s+#?(\d+)\b', 1), ''))"""
SETS = f"sets AS (SELECT coalesce({TICKET}, author || '|' || CAST(date AS VARCHAR)) AS key, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(*) AS commits FROM changes GROUP BY 1, 2)"
DAYSETS = "sets AS (SELECT author || '|' || CAST(date AS VARCHAR) AS key, path FROM changes GROUP BY 1, 2)"


def big(most: int) -> str:
    return f"few AS (SELECT key, path FROM sets WHERE key IN (SELECT key FROM sets GROUP BY key HAVING count(*) <= {most}))"


PAIRS = "pr AS (SELECT a.path AS a, b.path AS b, count(*) AS shared FROM few a JOIN few b ON a.key = b.key AND a.path < b.path GROUP BY 1, 2)"
REVS = "revs AS (SELECT path, count(*) AS r FROM sets GROUP BY path)"
WIDE = f"""{TOTALS}, lined AS (SELECT hash, added + deleted AS lines FROM totals),
cut AS (SELECT greatest(500, max(lines)) AS cut FROM (SELECT lines, row_number() OVER (ORDER BY lines) AS rn, count(*) OVER () AS n FROM lined) WHERE rn = greatest(1, CAST(ceil(0.99e0*n) AS BIGINT))),
pool AS (SELECT changes.* FROM changes WHERE ({FIX}) AND hash NOT IN (SELECT hash FROM lined, cut WHERE lines >= cut))"""
FIXES = f"fx AS (SELECT path, count(*) AS fixes, max(date) AS last_fix, count(*) FILTER ({MONTHS.format(a='date', b='now')} < 6) AS recent FROM pool, ending GROUP BY path)"


def entropy_sql(periods: str, size: str, weight: str, part: str) -> str:
    return f"""WITH c AS ({periods}), whole AS (SELECT period, min(month) AS month, CAST(sum(n) AS BIGINT) AS total, count(*) AS files FROM c GROUP BY period), sized AS ({size}),
h AS (SELECT c.period, CASE WHEN max(size) > 1 AND max(sized.files) > 1 THEN -sum((n*1e0/sized.total)*log2(n*1e0/sized.total))/log2(max(size)) ELSE 0e0 END AS h FROM c JOIN sized ON c.period = sized.period GROUP BY c.period)
SELECT path, count(*) AS periods, round(sum({part} * h.h * {weight}), 6) AS hcm FROM c JOIN sized ON c.period = sized.period JOIN h ON c.period = h.period, ending GROUP BY path"""


MONTHLY = "SELECT year(date)*12+month(date) AS period, year(date)*12+month(date) AS month, path, count(*) AS n FROM changes GROUP BY 1, 2, 3"
QUIET = """SELECT period, min(pm) AS month, path, count(*) AS n FROM changes JOIN (SELECT date, period, min(year(date)*12+month(date)) OVER (PARTITION BY period) AS pm FROM (
  SELECT date, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (ORDER BY date) AS period FROM (SELECT date, datediff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM (SELECT DISTINCT date FROM changes)))) d USING (date) GROUP BY period, path"""
BACK = "greatest(0, year(now)*12+month(now) - sized.month)"
OWN = "SELECT period, month, total, files, files AS size FROM whole"
SYSTEM = "SELECT whole.period, month, total, files, greatest(files, sum(coalesce(new, 0)) OVER (ORDER BY whole.period)) AS size FROM whole LEFT JOIN (SELECT first AS period, count(*) AS new FROM (SELECT path, min(period) AS first FROM c GROUP BY path) GROUP BY first) f ON f.period = whole.period"
ADAPTIVE = "SELECT period, month, total, files, greatest(files, n) AS size FROM (SELECT o.period, o.month, o.total, o.files, count(DISTINCT c.path) AS n FROM (SELECT *, row_number() OVER (ORDER BY period) AS slot FROM whole) o JOIN (SELECT period, row_number() OVER (ORDER BY period) AS slot FROM whole) p ON p.slot BETWEEN o.slot - 5 AND o.slot JOIN c ON c.period = p.period GROUP BY 1, 2, 3, 4)"


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def sets_by_day(h: History):
    return h.changes.select(F.concat_ws("|", "author", F.col("date").cast("string")).alias("key"), "path").distinct()


QUERIES: dict[str, tuple] = {
    "window_filter": (lambda h: H.in_window(h.commits, "1996-01-01", "1997-01-01"), "SELECT * FROM commits WHERE date >= DATE '1996-01-01' AND date < DATE '1997-01-01'"),
    "subject_predicates": (
        lambda h: h.commits.select("hash", X.is_fix("subject").alias("fix"), X.is_revert("subject").alias("revert"), X.ticket_key("subject").alias("ticket"), F.col("subject").rlike(X.CONVENTIONAL).alias("typed"), X.clauses("subject").cast("long").alias("clauses")),
        rf"SELECT hash, ({FIX}) AS fix, starts_with(subject, 'Revert ') AS revert, {TICKET} AS ticket, regexp_matches(subject, '^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(\([^)]*\))?!?:') AS typed, CAST(1 + CASE WHEN subject LIKE '%, totals and tax lines%' THEN 2 ELSE 0 END AS BIGINT) AS clauses FROM commits",
    ),
    "path_classes": (
        lambda h: h.paths.select("path").distinct().select("path", X.path_kinds("path").alias("k")).select("path", "k.test", "k.doc", "k.vendor", "k.credential", X.area("path", 1).alias("area1"), X.area("path", 2).alias("area2")),
        f"SELECT DISTINCT path, {TEST} AS test, path LIKE '%.md' AS doc, false AS vendor, false AS credential, split_part(path, '/', 1) AS area1, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS area2 FROM paths",
    ),
    "file_types": (
        lambda h: h.paths.select("path").distinct().groupBy(F.regexp_extract("path", r"\.([^.]+)$", 1).alias("type")).agg(F.count("*").alias("files")),
        r"SELECT regexp_extract(path, '\.([^.]+)$', 1) AS type, count(*) AS files FROM (SELECT DISTINCT path FROM paths) GROUP BY 1",
    ),
    "scope_filter": (lambda h: h.changes.where(F.startswith("path", F.lit("brand_1/")) | F.startswith("path", F.lit("brand_2/economy/"))).groupBy("path").agg(F.count("*").alias("n")), "SELECT path, count(*) AS n FROM changes WHERE path LIKE 'brand\\_1/%' ESCAPE '\\' OR path LIKE 'brand\\_2/economy/%' ESCAPE '\\' GROUP BY path"),
    "sweeps": (
        lambda h: H.sweeps(h.changes, min_files=9, tolerance=0.5),
        f"WITH {TOTALS}, cut AS (SELECT max(files) AS cut FROM (SELECT files, row_number() OVER (ORDER BY files) AS rn, count(*) OVER () AS n FROM totals) WHERE rn = greatest(1, CAST(ceil(0.99e0*n) AS BIGINT))) SELECT hash FROM totals, cut WHERE files >= greatest(9, cut) AND abs(added - deleted) <= 0.5 * greatest(added, deleted)",
    ),
    "imports": (
        lambda h: H.imports(h.changes, share=0.00001, min_files=5, deleted=0.3),
        f"WITH {TOTALS} SELECT hash FROM totals WHERE files >= 5 AND added >= 0.00001 * (SELECT sum(added) FROM totals) AND deleted <= 0.3 * added",
    ),
    "imported_files": (
        lambda h: H.imported_files(h.changes, H.imports(h.changes, share=0.00001, min_files=8, deleted=0.3)),
        f"WITH {TOTALS} SELECT DISTINCT path FROM changes WHERE added > 0 AND hash IN (SELECT hash FROM totals WHERE files >= 8 AND added >= 0.00001 * (SELECT sum(added) FROM totals) AND deleted <= 0.3 * added)",
    ),
    "oversized": (lambda h: H.oversized(h.changes), f"WITH {WIDE} SELECT hash FROM lined, cut WHERE lines >= cut"),
    "analysed_changes": (
        lambda h: H.analysed(h.changes, min_files=9, tolerance=0.5).groupBy("path").agg(F.count("*").alias("n")),
        f"WITH {TOTALS}, cut AS (SELECT max(files) AS cut FROM (SELECT files, row_number() OVER (ORDER BY files) AS rn, count(*) OVER () AS n FROM totals) WHERE rn = greatest(1, CAST(ceil(0.99e0*n) AS BIGINT))) SELECT path, count(*) AS n FROM changes WHERE hash NOT IN (SELECT hash FROM totals, cut WHERE files >= greatest(9, cut) AND abs(added - deleted) <= 0.5 * greatest(added, deleted)) GROUP BY path",
    ),
    "tangled_commits": (
        lambda h: H.tangled(h.changes, min_files=5, min_folders=4, min_clauses=2),
        f"WITH t AS (SELECT hash, count(*) AS files, count(DISTINCT regexp_replace(path, '/?[^/]*$', '')) AS folders, CAST({CLAUSES} AS INTEGER) AS clauses FROM changes GROUP BY hash, subject) SELECT * FROM t WHERE files >= 5 AND folders >= 4 AND clauses >= 2",
    ),
    "revisions": (lambda h: H.revisions(h.changes), "SELECT path, count(*) AS revs FROM changes GROUP BY path"),
    "authors_minor": (
        lambda h: H.authors(h.changes, h.credits),
        "WITH e AS (SELECT path, person, count(*) AS n FROM credits GROUP BY ALL), r AS (SELECT path, count(*) AS revs FROM changes GROUP BY path) SELECT path, revs, count(*) AS authors, count(*) FILTER (n*1e0/revs < 0.05) AS minor FROM e JOIN r USING (path) GROUP BY path, revs",
    ),
    "ownership": (
        lambda h: H.ownership(h.credits, h.now),
        "SELECT path, person, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(*) AS commits, count(*) FILTER (date >= now - INTERVAL 12 MONTH) AS recent FROM credits, ending GROUP BY path, person",
    ),
    "author_totals": (
        lambda h: H.author_totals(h.changes, h.people),
        f"WITH {TOTALS} SELECT person, count(*) AS commits, count(*) FILTER (position = 0) AS authored, CAST(sum(coalesce(added,0) // people + CASE WHEN position < coalesce(added,0) % people THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(coalesce(deleted,0) // people + CASE WHEN position < coalesce(deleted,0) % people THEN 1 ELSE 0 END) AS BIGINT) AS deleted, min(date) AS first, max(date) AS last FROM people LEFT JOIN totals USING (hash) GROUP BY person",
    ),
    "file_age": (lambda h: H.file_age(h.changes, h.now), f"SELECT path, last, CAST({MONTHS.format(a='last', b='now')} AS BIGINT) AS months FROM (SELECT path, max(date) AS last FROM changes GROUP BY path), ending"),
    "arrivals": (lambda h: H.arrivals(h.changes), "SELECT path, min(date) AS first FROM changes GROUP BY path"),
    "fixes_per_file": (lambda h: H.fixes(h.changes, h.now), f"WITH {WIDE}, {FIXES} SELECT * FROM fx"),
    "plumbing": (lambda h: H.plumbing(h.changes, min_revs=5, share=0.02), "SELECT path, count(*) AS revs, count(*) FILTER (added = deleted AND added <= 3) AS small FROM changes GROUP BY path HAVING count(*) >= 5 AND count(*) FILTER (added = deleted AND added <= 3)*1e0/count(*) >= 0.02"),
    "test_cochange": (lambda h: H.test_cochange(C.changesets(h.changes)), f"WITH {SETS}, t AS (SELECT key, bool_or({TEST}) AS tested FROM sets GROUP BY key) SELECT path, count(*) AS sets, count(*) FILTER (tested) AS with_tests FROM sets JOIN t USING (key) WHERE NOT ({TEST}) GROUP BY path"),
    "late_night": (lambda h: H.late_night(h.events.select(F.col("user_id").alias("entity"), F.hour("ts").alias("hour"))), "SELECT user_id AS entity, count(*) AS revs, count(*) FILTER (hour(ts) BETWEEN 0 AND 3) AS late FROM events GROUP BY user_id"),
    "degree_of_authorship": (
        lambda h: rounded(H.degree_of_authorship(h.changes, h.credits), "doa", digits=4).select("path", "person", "fa", F.col("dl").cast("long").alias("dl"), F.col("ac").cast("long").alias("ac"), "doa", "is_author"),
        "WITH p AS (SELECT path, person, count(*) AS dl FROM credits GROUP BY path, person), c AS (SELECT path, arg_min(author, (date, pos)) AS creator FROM changes WHERE added > 0 GROUP BY path), s AS (SELECT path, person, CASE WHEN person = creator THEN 1 ELSE 0 END AS fa, dl, CAST(sum(dl) OVER (PARTITION BY path) - dl AS BIGINT) AS ac FROM p LEFT JOIN c USING (path)), d AS (SELECT *, 3.293e0 + 1.098e0*fa + 0.164e0*dl - 0.321e0*ln(1e0+ac) AS raw FROM s) SELECT path, person, fa, dl, ac, round(raw, 4) AS doa, raw >= 3.293e0 AND raw >= 0.75e0 * max(raw) OVER (PARTITION BY path) AS is_author FROM d",
    ),
    "degree_of_authorship_decayed": (
        lambda h: rounded(H.degree_of_authorship(h.changes, h.credits, h.now, half_life=5), "dl", "doa", digits=4).select("path", "person", "fa", "dl", "doa"),
        "WITH p AS (SELECT path, person, sum(power(0.5e0, datediff('day', date, now)/30.44e0/5)) AS dl FROM credits, ending GROUP BY path, person), c AS (SELECT path, arg_min(author, (date, pos)) AS creator FROM changes WHERE added > 0 GROUP BY path), s AS (SELECT path, person, CASE WHEN person = creator THEN 1 ELSE 0 END AS fa, dl, sum(dl) OVER (PARTITION BY path) - dl AS ac FROM p LEFT JOIN c USING (path)) SELECT path, person, fa, round(dl, 4) AS dl, round(3.293e0 + 1.098e0*fa + 0.164e0*dl - 0.321e0*ln(1e0+greatest(ac, 0e0)), 4) AS doa FROM s",
    ),
    "entropy_month": (lambda h: rounded(H.change_entropy(H.month_periods(h.changes), h.now), "hcm"), entropy_sql(MONTHLY, OWN, f"power(0.5e0, {BACK})", "(n*1e0/sized.total)")),
    "entropy_hcm3s": (lambda h: rounded(H.change_entropy(H.quiet_periods(h.changes), h.now, decay=1.0, hcpf=3, sizing="system"), "hcm"), entropy_sql(QUIET, SYSTEM, "1e0", "(1e0/sized.files)")),
    "entropy_hcm1d": (lambda h: rounded(H.change_entropy(H.quiet_periods(h.changes), h.now, hcpf=1, sizing="system", phi=1.0), "hcm"), entropy_sql(QUIET, SYSTEM, f"exp(-1e0*{BACK}/12)", "1e0")),
    "entropy_adaptive": (lambda h: rounded(H.change_entropy(H.month_periods(h.changes), h.now, sizing="adaptive"), "hcm"), entropy_sql(MONTHLY, ADAPTIVE, f"power(0.5e0, {BACK})", "(n*1e0/sized.total)")),
    "activity_counts": (
        lambda h: H.activity(h.commits, h.changes),
        rf"SELECT * FROM (SELECT 'commits' AS metric, count(*) AS value FROM commits UNION ALL SELECT 'fixes', count(*) FILTER ({FIX}) FROM commits UNION ALL SELECT 'reverts', count(*) FILTER (starts_with(subject, 'Revert ')) FROM commits UNION ALL SELECT 'squash', count(*) FILTER (regexp_matches(subject, '\(#\d+\)\s*$')) FROM commits UNION ALL SELECT 'authors', count(DISTINCT author) FROM commits UNION ALL SELECT 'added_total', CAST(sum(added) AS BIGINT) FROM changes UNION ALL SELECT 'deleted_total', CAST(sum(deleted) AS BIGINT) FROM changes)",
    ),
    "activity_weekday": (lambda h: H.by_weekday(h.commits), "SELECT CAST(isodow(date) - 1 AS INTEGER) AS weekday, count(*) AS commits FROM commits GROUP BY 1"),
    "activity_month": (lambda h: H.by_month(h.commits), "SELECT strftime(date, '%Y-%m') AS month, count(*) AS commits FROM commits GROUP BY 1"),
    "activity_hour": (lambda h: H.by_hour(h.events), "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS events FROM events GROUP BY 1"),
    "net_by_year": (lambda h: H.net_by_year(h.changes), "SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(added - deleted) AS BIGINT) AS net FROM changes GROUP BY 1"),
    "timeline_pivot": (
        lambda h: H.timeline(h.commits, [f"2000-{m:02d}" for m in range(1, 13)]),
        "SELECT author, " + ", ".join(f"count(*) FILTER (strftime(date, '%Y-%m') = '2000-{m:02d}') AS \"2000-{m:02d}\"" for m in range(1, 13)) + " FROM commits GROUP BY author",
    ),
    "reverted_files": (lambda h: H.reverted_files(h.changes), "SELECT path, count(*) AS reverts FROM changes WHERE starts_with(subject, 'Revert ') GROUP BY path"),
    "squash_share": (lambda h: C.regime(h.commits, 0), r"SELECT CASE WHEN s*1e0/n >= 0.5 THEN 'squash' ELSE 'linear' END AS regime, s*1e0/n AS squash_share FROM (SELECT count(*) AS n, count(*) FILTER (regexp_matches(subject, '\(#\d+\)\s*$')) AS s FROM commits)"),
    "trailer_case_fold": (
        lambda h: h.events.groupBy(F.lower("event_type").alias("key"), F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n")),
        "SELECT lower(event_type) AS key, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    # co-change
    "changesets": (lambda h: C.changesets(h.changes), f"WITH {SETS} SELECT * FROM sets"),
    "coupling": (
        lambda h: C.coupling(C.changesets(h.changes), min_shared=3, min_degree=1),
        f"WITH {SETS}, {big(30)}, {PAIRS}, {REVS} SELECT a AS entity, b AS coupled, CAST(floor(100*shared/((x.r+y.r)/2)+0.5) AS BIGINT) AS degree, CAST(floor((x.r+y.r)/2+0.5) AS BIGINT) AS average_revs, shared FROM pr JOIN revs x ON x.path = a JOIN revs y ON y.path = b WHERE shared >= 3 AND floor(100*shared/((x.r+y.r)/2)+0.5) >= 1",
    ),
    "companions": (
        lambda h: C.companions(C.changesets(h.changes), min_confidence=5, min_shared=3),
        f"WITH {SETS}, {big(30)}, {PAIRS}, rs AS (SELECT path, count(*) AS r FROM few GROUP BY path) SELECT a AS entity, b AS companion, CAST(floor(100*shared/r+0.5) AS BIGINT) AS confidence, shared FROM (SELECT a, b, shared FROM pr UNION ALL SELECT b, a, shared FROM pr) JOIN rs ON rs.path = a WHERE shared >= 3 AND floor(100*shared/r+0.5) >= 5",
    ),
    "sum_of_coupling": (
        lambda h: C.sum_of_coupling(C.changesets(h.changes), min_shared=2),
        f"WITH {SETS}, {big(30)}, {PAIRS} SELECT path, CAST(sum(shared) AS BIGINT) AS soc, count(*) FILTER (shared >= 2) AS partners FROM (SELECT a AS path, shared FROM pr UNION ALL SELECT b, shared FROM pr) GROUP BY path",
    ),
    "component_coupling": (
        lambda h: C.components(C.changesets(h.changes), min_shared=10, min_degree=1),
        "WITH "
        + SETS
        + ", "
        + ", ".join(
            f"d{n} AS (SELECT DISTINCT key, {e} AS path FROM sets), f{n} AS (SELECT * FROM d{n} WHERE key IN (SELECT key FROM d{n} GROUP BY key HAVING count(*) <= 10)), r{n} AS (SELECT path, count(*) AS r FROM d{n} GROUP BY path), q{n} AS (SELECT a.path AS a, b.path AS b, count(*) AS shared FROM f{n} a JOIN f{n} b ON a.key = b.key AND a.path < b.path GROUP BY 1, 2), o{n} AS (SELECT a AS entity, b AS coupled, CAST(floor(100*shared/((x.r+y.r)/2)+0.5) AS BIGINT) AS degree, CAST(floor((x.r+y.r)/2+0.5) AS BIGINT) AS average_revs, shared, {n} AS depth FROM q{n} JOIN r{n} x ON x.path = a JOIN r{n} y ON y.path = b WHERE shared >= 10)"
            for n, e in ((1, "split_part(path, '/', 1)"), (2, "split_part(path, '/', 1) || '/' || split_part(path, '/', 2)"))
        )
        + " SELECT * FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) WHERE degree >= 1",
    ),
    "coupling_gaps": (
        lambda h: C.gaps(C.coupling(C.changesets(h.changes), min_shared=2, min_degree=1), h.changes.where("pos < 50")),
        f"WITH {SETS}, {big(30)}, {PAIRS}, {REVS}, c AS (SELECT a AS entity, b AS coupled, CAST(floor(100*shared/((x.r+y.r)/2)+0.5) AS BIGINT) AS degree FROM pr JOIN revs x ON x.path = a JOIN revs y ON y.path = b WHERE shared >= 2 AND floor(100*shared/((x.r+y.r)/2)+0.5) >= 1), t AS (SELECT DISTINCT path FROM changes WHERE pos < 50) SELECT file, companion, degree FROM (SELECT entity AS file, coupled AS companion, degree FROM c UNION ALL SELECT coupled, entity, degree FROM c) WHERE file IN (SELECT path FROM t) AND companion NOT IN (SELECT path FROM t)",
    ),
    "companion_grid": (
        lambda h: C.companion_grid(C.pairs(C.changesets(h.changes)), C.small(C.changesets(h.changes)).groupBy("path").agg(F.count("*").alias("revs")), h.spark.createDataFrame([(c, s) for c in (2, 5, 10) for s in (2, 3)], "confidence int, shared int")),
        f"WITH {SETS}, {big(30)}, {PAIRS}, rs AS (SELECT path, count(*) AS r FROM few GROUP BY path), d AS (SELECT a, floor(100*shared/r+0.5) AS c, shared AS s FROM (SELECT a, b, shared FROM pr UNION ALL SELECT b, a, shared FROM pr) JOIN rs ON rs.path = a), g AS (SELECT CAST(c AS INTEGER) AS confidence, CAST(s AS INTEGER) AS shared FROM (VALUES (2),(5),(10)) a(c), (VALUES (2),(3)) b(s)) SELECT confidence, shared, count(*) AS rows, count(DISTINCT a) AS files FROM d JOIN g ON c >= confidence AND s >= shared GROUP BY 1, 2",
    ),
    "leave_one_out": (
        lambda h: C.leave_one_out(C.changesets(h.changes), C.companions(C.changesets(h.changes), 5, 2)),
        f"WITH {SETS}, {big(30)}, {PAIRS}, rs AS (SELECT path, count(*) AS r FROM few GROUP BY path), rl AS (SELECT a AS entity, b AS companion FROM (SELECT a, b, shared FROM pr UNION ALL SELECT b, a, shared FROM pr) JOIN rs ON rs.path = a WHERE shared >= 2 AND floor(100*shared/r+0.5) >= 5), k AS (SELECT key FROM sets GROUP BY key HAVING count(*) BETWEEN 2 AND 20), s AS (SELECT key, path FROM sets WHERE key IN (SELECT key FROM k)), told AS (SELECT key, entity, companion FROM s JOIN rl ON entity = path), n AS (SELECT s.key, s.path, bool_or(companion = s.path) AS hit FROM s JOIN told ON told.key = s.key AND entity <> s.path GROUP BY 1, 2) SELECT (SELECT count(*) FROM s) AS asked, count(*) AS answered, count(*) FILTER (hit) AS \"right\" FROM n",
    ),
}
QUERIES = {name: (build, sql(text)) for name, (build, text) in QUERIES.items()}
