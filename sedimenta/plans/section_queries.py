"""Registered queries on the tables of a report, over the history and over fixtures."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from ..operators import history as Hi
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import sections as S
from .check_queries import KINDS, kinds
from .fixture_queries import FIXTURES, _findings, frame, told, values
from .history_queries import FIX, FIXES, TEST, WIDE, rounded
from .prelude import sql

day = dt.date
stamp = dt.datetime
LOCK = {"packages": {
    "": {"dependencies": {"a": "^1", "@s/b": "2"}, "devDependencies": {"t": "3"}}, "node_modules/a": {"version": "1.2.0"}, "node_modules/@s/b": {"version": "2.0.1"},
    "node_modules/a/node_modules/c": {"version": "0.9.0"}, "node_modules/c": {"version": "1.0.0"}, "node_modules/t": {"version": "3.1.0", "dev": True}, "node_modules/a/node_modules/t": {"version": "2.0.0"},
}}
YARN = '# yarn lockfile v1\n\n"@s/p@^1.0.0":\n  version "1.2.3"\n  resolved "https://r/p"\n\nleft-pad@^1, left-pad@^1.1:\n  version "1.3.0"\n\nzed@npm:2:\n  version: 2.5.0\n'
FIXTURES |= {
    "asked": ("spec string", [("2y",), ("18m",), ("90d",), ("2023-02-28",), ("3m",), ("13m",)]),
    "trunk": ("hash string, time date, pos long", [("a", day(2024, 1, 1), 1), ("b", day(2024, 1, 5), 2), ("c", day(2024, 1, 5), 3), ("d", day(2024, 2, 1), 4)]),
    "blamed": ("fix string, path string, commit string, time date", [("f1", "a.py", "c1", day(2023, 1, 5)), ("f1", "b.py", "c2", day(2023, 3, 1)), ("f1", "c.py", "c2", day(2023, 3, 1)), ("f1", "tests/test_a.py", "c9", day(2023, 12, 1)), ("f2", "a.py", "c3", day(2024, 2, 2)), ("f3", "z.py", "c1", day(2023, 1, 5)), ("f3", "z.py", "c0", day(2022, 1, 5))]),
    "fixed": ("hash string, date date", [("f1", day(2024, 1, 10)), ("f2", day(2024, 3, 1)), ("f3", day(2024, 5, 30)), ("f4", day(2024, 1, 11))]),
    "merges": ("date date, name string, email string", [(day(2024, 1, 1), "Ada", "a@x"), (day(2024, 2, 1), "Ada", "a@x"), (day(2022, 2, 1), "Ada", "a@x"), (day(2024, 2, 1), "Bob", "b@x")]),
    "surviving": ("path string, time long", [("a", 5), ("a", 9), ("b", 2), ("c", 11), ("d", 1), ("d", 30)]),
    "walks": ("time long", [(1,), (2,), (2,), (5,), (7,), (9,), (9,), (11,), (12,)]),
    "measured": ("file string, function string, start long, ccn long, nloc long, suspect boolean", [("a.py", "f", 1, 12, 50, False), ("a.py", "g", 60, 30, 40, True), ("b.py", "h", 1, 12, 70, False), ("b.py", "i", 90, 3, 300, False), ("c.py", "j", 5, 44, 90, False), ("d.py", "k", 5, 12, 50, None)]),
    "nested": ("file string, name string, start long, nesting long, bumps long, cognitive long", [("a.py", "f", 1, 6, 1, 40), ("a.py", "g", 60, 6, 0, 20), ("b.py", "h", 1, 2, 3, 15), ("c.py", "j", 5, 4, 2, 9)]),
    "hot": ("path string", [("b.py",), ("q.py",)]),
    "handlers": ("path string, empty long", [("a.py", 3), ("b.py", 2), ("c.py", 0), ("d.py", 1)]),
    "places": ("rule string, confidence string, value string, commit string, file string, line long, at_head boolean, placeholder boolean", [("key", "high", "v1", "c1", "b.py", 1, True, False), ("key", "high", "v1", "c1", "b.py", 1, False, False), ("key", "high", "v2", "c2", "a.py", 2, False, False), ("tok", "low", "v3", "c1", "z.py", 3, False, False), ("tok", "low", "v4", "c1", "y.py", 3, False, True), ("key", "medium", "v5", "c3", "m.py", 7, True, False)]),
    "pip": ("source string, text string", [("requirements.txt", "# top\nDjango>=4 # web\nrequests[socks] == 2.31.0 ; python_version > '3'\n-r base.txt\nflask\nNumPy==1.*\nzope.interface===5.0\n"), ("src/app.txt", "nothing==1\n"), ("dev-constraints.in", "pip ==23.1\n")]),
    "advisories": ("id string, affected string", [("A", '[{"database_specific": {"informational": "unmaintained"}}]'), ("B", "[]"), ("C", '[{"database_specific": {}}, {"database_specific": {"informational": "unsound"}}]'), ("D", None)]),
    "installed": ("source string, name string, score double, fixed string, malicious boolean, runtime boolean, imported boolean, deploys boolean, pinned boolean", [("lock", "p", 9.8, "2.0", False, True, True, True, None), ("lock", "q", 9.9, None, False, True, False, False, None), ("lock", "r", 5.0, "1.1", True, None, None, False, None), ("requirements.txt", "s", 9.5, "3", False, True, True, True, False), ("requirements.txt", "t", 7.0, "4", False, False, True, True, True), ("lock2", "u", None, None, False, None, None, None, None)]),
    "npm_locks": ("source string, text string", [("package-lock.json", json.dumps(LOCK))]),
    "yarn_locks": ("source string, text string", [("yarn.lock", YARN)]),
    "drifts": ("manifest string, commit string, date date", [("a", "s1", day(2024, 3, 1)), ("a", "c1", day(2024, 1, 1)), ("a", "c2", day(2024, 2, 1)), ("b", "s1", day(2024, 3, 1)), ("c", "c1", day(2024, 1, 1))]),
    "swept": ("hash string", [("s1",)]),
    "steps": ("uses string, ref string, secrets boolean, pos long", [("actions/checkout@v4", "release", False, 1), ("x/y@main", "branch", False, 2), ("x/z@v1", "release", True, 3), ("own/a@main", "branch", True, 4), ("x/w@main", "branch", True, 5), ("github/q@v1", None, None, 6)]),
    "instructions": ("path string, date date, behind long", [("AGENTS.md", day(2023, 6, 30), 300), ("a/AGENTS.md", day(2024, 1, 30), 500), ("b/AGENTS.md", day(2023, 1, 1), 20), ("c/AGENTS.md", day(2023, 7, 1), 100)]),
    "signers": ("hash string, email string", [("a", "x@t"), ("b", "x@t"), ("b", "y@t"), ("c", "ada@x"), ("d", "ada@x"), ("c", "y@t"), ("c", "z@t")]),
    "writers": ("email string", [("ada@x",), ("bob@x",)]),
    "checks": ("measure string, skipped string", [("a", None), ("b", None), ("never", None), ("truck_factor", "under 10 files")]),
    "base_lists": ("cut long, path string, place long", [(c, f"p{i}", i) for c in (1, 2) for i in range(1, 21)]),
    "cand_lists": ("cut long, path string, place long", [(1, f"p{21 - i}", i) for i in range(1, 19)] + [(2, f"p{i + 1}", i) for i in range(1, 22)]),
    "outcomes": ("cut long, path string", [(1, "p1"), (1, "p20"), (1, "p19"), (1, "gone"), *((2, f"p{i}") for i in range(5, 18))]),
    "effects_of_cuts": ("repo string, d long", [("a", 1), ("a", 2), ("b", 0), ("b", 0), ("c", -1), ("d", 3), ("d", -1)]),
    "cut_offs": ("repo string, cut date, label_end date", [("a", day(2018, 6, 30), day(2019, 12, 31)), ("a", day(2019, 6, 30), day(2019, 12, 31)), ("a", day(2018, 12, 31), day(2019, 12, 31)), ("b", day(2019, 6, 30), None)]),
    "scores": ("variant string, hits long, auc double, recall double", [("x", 3, 0.7, 0.2), ("x", 5, 0.8, None), ("x", 1, 0.6, 0.5), ("y", 2, None, 0.1), ("y", 0, 0.5, 0.3)]),
    "refs": ("subject string, on_head boolean", [("fix: a", True), ("b", True), ("fixes c", False), ("d", False), ("bug in e", True)]),
    "watched": ("path string, revs long, code long", [("a.py", 7, 100), ("b.py", 2, 50), ("c.py", 1, 900), ("d.py", 3, 10), ("tests/e.py", 9, 9)]),
    "wrote": ("path string, person string, added long", [("a.py", "ada", 95), ("a.py", "bob", 5), ("b.py", "bob", 10), ("d.py", "eve", 1), ("d.py", "ada", 1)]),
    "shaped": ("path string, debt long, definitions long", [("a.py", 3, 60), ("b.py", 2, 59), ("d.py", 1200, None)]),
    "nights": ("path string, late long, late_revs long", [("a.py", 3, 7), ("b.py", 2, 2), ("d.py", 3, 12)]),
    "trended": ("path string, before double, after double, code_before double, code_after double", [("a.py", 10.0, 13.0, 100.0, 90.0), ("b.py", 10.0, 11.0, 5.0, 9.0), ("d.py", 4.0, 8.0, 0.0, 9.0)]),
    "findings_left": ("id string, code_lines long", [("a.py", 12), ("b.py", 9), ("c.py", 10)]),
}
RANKED = "rk AS (SELECT *, row_number() OVER (ORDER BY cost DESC, doc_id) AS place FROM ranked_docs)"


def ranked_docs(h):
    return M.ranked(h.ranked_docs, F.desc("cost"), F.asc("doc_id"))


def watched(h):
    """Every side of the watch list, on fixtures."""
    files, owners = frame(h, "watched"), frame(h, "wrote")
    none = lambda schema: h.spark.createDataFrame([], schema)
    rows = R.watch_list(
        files.select("path", "revs"), files.select("path", "code", F.lit(0).cast("long").alias("complexity")), files.select("path"), none("path string, fixes long, recent long"), owners.groupBy("path").agg(F.count("*").alias("authors"), F.lit(0).cast("long").alias("minor")), owners,
        none("path string, partners long"), none("path string, sets long, with_tests long"), none("path string, periods long"),
        R.function_side(frame(h, "measured")), R.nesting_side(frame(h, "nested")), frame(h, "shaped"), frame(h, "nights"), R.growth_side(frame(h, "trended")),
    )
    return rounded(rows, "score").select("path", "score", F.array_join("reasons", "; ").alias("reasons"))


WATCHED = (
    "WITH " + values("watched", "wrote", "measured", "nested", "shaped", "nights", "trended") + """, w AS (SELECT * FROM watched WHERE revs >= 2 AND path NOT LIKE 'tests/%'), o AS (SELECT path, count(*) AS authors, arg_max(person, (added, person)) AS owner, max(added)*1e0/sum(added) AS share FROM wrote GROUP BY path),
f AS (SELECT file AS path, arg_max(function, (ccn, -start)) AS fn, max(ccn) AS ccn FROM measured WHERE NOT coalesce(suspect, false) GROUP BY 1), d AS (SELECT file AS path, arg_max(name, (nesting, -start)) AS name, max(nesting) AS nesting FROM nested GROUP BY 1),
g AS (SELECT path, CAST(round_even(100*(after-before)/before, 0) AS BIGINT) AS grown, CAST(round_even(100*(code_after-code_before)/nullif(code_before, 0), 0) AS BIGINT) AS code_grown FROM trended)
SELECT path, round(100e0*revs*code/sum(revs*code) OVER (), 6) AS score, array_to_string(list_filter(['changed ' || CASE revs WHEN 2 THEN 'twice' ELSE revs || ' times' END, CASE WHEN authors = 1 THEN 'only ' || owner || ' has touched it' WHEN share >= 0.9 THEN owner || ' wrote ' || CAST(round_even(100*share, 0) AS BIGINT) || '% of it' END,
  CASE WHEN ccn >= 10 THEN fn || '() complexity ' || ccn END, CASE WHEN grown >= 25 THEN printf('%+d', grown) || '% summed complexity in a year' || coalesce(', code ' || printf('%+d', code_grown) || '%', '') END, CASE WHEN nesting >= 5 THEN name || '() nested ' || nesting || ' deep' END, CASE WHEN debt >= 3 THEN format('{:,} TODO/FIXME comments', debt) END,
  CASE WHEN definitions >= 60 THEN format('defines {:,} functions and classes', definitions) END, CASE WHEN late >= 3 AND late*1e0/late_revs >= 0.25 THEN CAST(round_even(100e0*late/late_revs, 0) AS BIGINT) || '% of its changes made between midnight and 4 am' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM w LEFT JOIN o USING (path) LEFT JOIN f USING (path) LEFT JOIN d USING (path) LEFT JOIN g USING (path) LEFT JOIN shaped USING (path) LEFT JOIN nights USING (path)"""
)

QUERIES: dict[str, tuple] = {
    # over the history
    "why_empty": (
        lambda h: S.why_empty(Hi.revisions(h.changes), kinds(h)),
        f"WITH {KINDS}, r AS (SELECT path, count(*) AS revs FROM changes GROUP BY path) SELECT coalesce(reasons[1], 'ranked') AS reason, count(*) AS files FROM r LEFT JOIN kinds USING (path) WHERE revs >= 2 GROUP BY 1",
    ),
    "documents_changed": (
        lambda h: S.documents(Hi.revisions(h.changes), kinds(h)),
        f"WITH {KINDS} SELECT path, count(*) AS revs FROM changes WHERE path IN (SELECT path FROM kinds WHERE reasons[1] = 'doc') GROUP BY path HAVING count(*) >= 2 ORDER BY revs DESC, path LIMIT 15",
    ),
    "unscored_commits": (
        lambda h: S.unscored(h.commits, h.changes, kinds(h).where("reason IS NULL")),
        f"WITH {KINDS}, m AS (SELECT hash, bool_and(path NOT IN (SELECT path FROM kinds WHERE len(reasons) = 0)) AS outside FROM changes GROUP BY hash) SELECT count(*) AS commits, count(*) FILTER ({FIX}) AS fixes, count(*) FILTER (outside) AS outside, count(*) FILTER (outside AND ({FIX})) AS fixes_outside FROM commits LEFT JOIN m USING (hash)",
    ),
    "own_sources": (lambda h: S.own_sources(h.size_files, kinds(h)), f"WITH {KINDS} SELECT size_files.* FROM size_files WHERE path NOT IN (SELECT path FROM kinds WHERE list_has_any(reasons, ['test', 'sample', 'doc', 'vendored', 'generated']))"),
    "report_at": (
        lambda h: Hi.revisions(Hi.in_window(h.changes, until="1998-01-01")).join(Hi.fixes(Hi.in_window(h.changes, until="1998-01-01"), Hi.in_window(h.commits, until="1998-01-01").agg(F.max("date").alias("now"))).select("path", "fixes", "recent"), "path", "left").na.fill(0),
        "WITH earlier AS (SELECT * FROM changes WHERE date < DATE '1998-01-01'), final AS (SELECT max(date) AS now FROM commits WHERE date < DATE '1998-01-01'), " + WIDE.replace("changes", "earlier") + ", " + FIXES.replace("ending", "final") + ", r AS (SELECT path, count(*) AS revs FROM earlier GROUP BY path) SELECT path, revs, coalesce(fixes, 0) AS fixes, coalesce(recent, 0) AS recent FROM r LEFT JOIN fx USING (path)",
    ),
    "cut_off_score": (
        lambda h: rounded(S.cut_off_score(ranked_docs(h), "doc_id"), "expected", "headroom", "auc", "recall", "popt"),
        f"WITH {RANKED}, n AS (SELECT count(*) AS pool, CAST(sum(outcome) AS BIGINT) AS positives, CAST(sum(CASE WHEN place <= 15 THEN outcome ELSE 0 END) AS BIGINT) AS hits FROM rk), w AS (SELECT outcome, place, cost, sum(1-outcome) OVER o AS above, sum(cost) OVER o AS spent, sum(cost) OVER () AS total FROM rk WINDOW o AS (ORDER BY place)), "
        "q AS (SELECT 'own' AS k, outcome, cost, place FROM rk UNION ALL SELECT 'best', outcome, cost, row_number() OVER (ORDER BY outcome DESC, cost, doc_id) FROM rk UNION ALL SELECT 'worst', outcome, cost, row_number() OVER (ORDER BY outcome, cost DESC, doc_id DESC) FROM rk), c AS (SELECT k, cost*1e0/sum(cost) OVER (PARTITION BY k) AS dx, (sum(outcome) OVER (PARTITION BY k ORDER BY place) - outcome/2e0)/sum(outcome) OVER (PARTITION BY k) AS y FROM q), a AS (SELECT sum(dx*y) FILTER (k = 'own') AS own, sum(dx*y) FILTER (k = 'best') AS best, sum(dx*y) FILTER (k = 'worst') AS worst FROM c) "
        "SELECT pool, positives, hits, round(least(15,pool)*1e0*positives/pool, 6) AS expected, least(15, pool, positives) AS best, round((hits - least(15,pool)*1e0*positives/pool)/nullif(least(15,pool,positives) - least(15,pool)*1e0*positives/pool, 0), 6) AS headroom, (SELECT round(1 - sum(outcome*above)*1e0/(sum(outcome)*sum(1-outcome)), 6) FROM w) AS auc, (SELECT round(sum(CASE WHEN spent <= 0.2*total THEN outcome ELSE 0 END)*1e0/sum(outcome), 6) FROM w) AS recall, (SELECT round(1 - (best - own)/(best - worst), 6) FROM a) AS popt, "
        "(SELECT CAST(coalesce(min(place) FILTER (outcome = 1) - 1, count(*)) AS BIGINT) FROM rk WHERE place <= 15) AS ifa FROM n",
    ),
    # over fixtures
    "watch_reasons": (watched, WATCHED),
    "since_dates": (
        lambda h: h.spark.createDataFrame([(r.spec, S.since_date(r.spec, day(2024, 5, 31))) for r in frame(h, "asked").collect()], "spec string, date date"),
        "WITH " + values("asked") + " SELECT spec, CAST(CASE WHEN spec LIKE '%y' THEN DATE '2024-05-31' - to_years(CAST(rtrim(spec, 'y') AS INTEGER)) WHEN spec LIKE '%m' THEN DATE '2024-05-31' - to_months(CAST(rtrim(spec, 'm') AS INTEGER)) WHEN spec LIKE '%d' THEN DATE '2024-05-31' - to_days(CAST(rtrim(spec, 'd') AS INTEGER)) ELSE CAST(spec AS DATE) END AS DATE) AS date FROM asked",
    ),
    "commit_as_of": (
        lambda h: S.as_of(frame(h, "trunk").withColumn("time", F.col("time").cast("timestamp")), "2024-01-05").unionByName(S.as_of(frame(h, "trunk").withColumn("time", F.col("time").cast("timestamp")), "2024-01-04", False)),
        "WITH " + values("trunk") + " SELECT arg_max(hash, (time, pos)) AS hash FROM trunk WHERE time < DATE '2024-01-06' UNION ALL SELECT arg_max(hash, (time, pos)) FROM trunk WHERE time <= DATE '2024-01-04'",
    ),
    "ref_spread": (lambda h: S.ref_spread(frame(h, "refs")), "WITH " + values("refs") + r", f AS (SELECT *, regexp_matches(lower(subject), '\b(fix|fixes|bug)\b') AS fix FROM refs) SELECT count(*) AS all, count(*) FILTER (on_head) AS head, count(*) FILTER (fix) AS fix_all, count(*) FILTER (fix AND on_head) AS fix_head FROM f"),
    "bug_inducing": (
        lambda h: S.inducing(frame(h, "blamed")).withColumn("files", F.array_join("files", ",")),
        "WITH " + values("blamed") + ", c AS (SELECT fix, commit, max(time) AS time, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM blamed WHERE path NOT LIKE 'tests/%' GROUP BY 1, 2) SELECT fix, commit, time AS date, files FROM c QUALIFY row_number() OVER (PARTITION BY fix ORDER BY time DESC, commit DESC) = 1",
    ),
    "induced_between": (
        lambda h: S.induced_between(frame(h, "fixed"), S.inducing(frame(h, "blamed")), "2024-01-01", "2024-06-01"),
        "WITH " + values("blamed", "fixed") + ", c AS (SELECT fix, commit, max(time) AS time FROM blamed WHERE path NOT LIKE 'tests/%' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY fix ORDER BY max(time) DESC, commit DESC) = 1) SELECT DISTINCT path FROM c JOIN fixed ON hash = fix JOIN blamed USING (fix, commit) WHERE c.time < DATE '2024-01-01' AND date >= DATE '2024-01-01' AND date < DATE '2024-06-01' AND path NOT LIKE 'tests/%'",
    ),
    "merges_by_identity": (lambda h: S.merges_by_identity(frame(h, "merges"), "2023-01-01"), "WITH " + values("merges") + " SELECT name, email, count(*) AS merges FROM merges WHERE date >= DATE '2023-01-01' GROUP BY 1, 2"),
    "blame_cost": (lambda h: S.commits_walked(frame(h, "surviving"), frame(h, "walks")), "WITH " + values("surviving", "walks") + ", o AS (SELECT path, min(time) AS oldest FROM surviving GROUP BY path) SELECT path, count(walks.time) AS walked FROM o LEFT JOIN walks ON walks.time >= oldest GROUP BY path"),
    "complex_functions": (
        lambda h: S.complex_functions(frame(h, "measured")).select("file", "function", "ccn", "nloc").limit(3),
        "WITH " + values("measured") + " SELECT file, function, ccn, nloc FROM measured WHERE ccn >= 10 ORDER BY coalesce(suspect, false), ccn DESC, nloc DESC, file, function, start LIMIT 3",
    ),
    "first_look": (
        lambda h: S.first_look(frame(h, "measured"), frame(h, "nested")),
        "WITH " + values("measured", "nested") + ", d AS (SELECT file, arg_max(name || '() nesting ' || nesting, (nesting, -start)) AS look FROM nested WHERE nesting >= 5 GROUP BY file), c AS (SELECT file, arg_max(function || '() complexity ' || ccn, (ccn, -start)) AS look FROM measured WHERE ccn >= 10 AND NOT coalesce(suspect, false) GROUP BY file) SELECT coalesce(d.file, c.file) AS path, coalesce(d.look, c.look) AS look FROM d FULL JOIN c ON d.file = c.file",
    ),
    "secrets_by_rule": (
        lambda h: S.secrets_by_rule(frame(h, "places")).withColumn("grade", S.grade("confidence").cast("long")),
        "WITH " + values("places") + ", p AS (SELECT rule, confidence, value, commit, file, line, bool_or(at_head) AS h FROM places WHERE NOT placeholder GROUP BY ALL) SELECT rule, confidence, count(*) FILTER (h) AS at_head, count(*) FILTER (NOT h) AS history, coalesce(min(file) FILTER (h), min(file)) AS first, CAST(coalesce(list_position(['high', 'medium', 'low'], confidence), 4) AS BIGINT) AS grade FROM p GROUP BY rule, confidence",
    ),
    "pip_requirements": (
        lambda h: S.requirements(frame(h, "pip")),
        "WITH " + values("pip") + r""", l AS (SELECT source, trim(regexp_replace(unnest(string_split(text, chr(10))), '(^|\s)#.*$', '')) AS line FROM pip WHERE regexp_matches(source, '(requirements|constraints)[^/]*\.(txt|in)$')), n AS (SELECT source, lower(regexp_replace(regexp_extract(line, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1), '[-_.]+', '-', 'g')) AS name,
        regexp_replace(regexp_extract(line, '^[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?\s*([^;]*)', 1), '\s+', '', 'g') AS requirement FROM l WHERE line <> '' AND line NOT LIKE '-%') SELECT source, name, requirement, regexp_matches(requirement, '^===?[^,*]+$') AS pinned FROM n WHERE name <> ''""",
    ),
    "informational_advisories": (
        lambda h: S.informational(frame(h, "advisories")),
        "WITH " + values("advisories") + ", k AS (SELECT id, json_extract_string(affected::JSON, '$[*].database_specific.informational') AS k FROM advisories WHERE affected IS NOT NULL) SELECT id, list_filter(k, lambda x: x <> '')[1] AS kind FROM k WHERE len(list_filter(k, lambda x: x <> '')) > 0",
    ),
    "vulnerable_ranked": (
        lambda h: S.vulnerable_ranked(frame(h, "installed")).select("source", "name", F.col("reach").cast("long").alias("reach"), "critical"),
        "WITH " + values("installed") + " SELECT source, name, CAST(CASE WHEN NOT coalesce(runtime, true) THEN 2 WHEN coalesce(imported, false) THEN 0 ELSE 1 END AS BIGINT) AS reach, coalesce(malicious, false) OR (coalesce(score >= 9, false) AND coalesce(deploys, false) AND NOT (source LIKE '%requirements%' AND NOT coalesce(pinned, false))) AS critical FROM installed",
    ),
    "vulnerable_first": (
        lambda h: S.vulnerable_first(S.vulnerable_ranked(frame(h, "installed"))),
        "WITH " + values("installed") + ", r AS (SELECT *, coalesce(malicious, false) OR (coalesce(score >= 9, false) AND coalesce(deploys, false) AND NOT (source LIKE '%requirements%' AND NOT coalesce(pinned, false))) AS critical FROM installed), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(malicious, false) DESC, critical DESC, fixed IS NULL, coalesce(score, -1) DESC, name) AS n FROM r) SELECT source, max(name) FILTER (n = 1) AS name, count(*) AS packages, max(score) AS score FROM o GROUP BY source",
    ),
    "npm_lock": (
        lambda h: S.npm_lock(frame(h, "npm_locks")),
        "WITH " + values("npm_locks") + ", p AS (SELECT source, text::JSON->'packages' AS p FROM npm_locks), k AS (SELECT source, p, unnest(json_keys(p)) AS path FROM p), n AS (SELECT source, path, regexp_extract(path, 'node_modules/((?:@[^/]+/)?[^/]+)$', 1) AS name, p->path AS x, list_concat(json_keys((CAST(p AS MAP(VARCHAR, JSON)))['']->'dependencies'), json_keys((CAST(p AS MAP(VARCHAR, JSON)))['']->'devDependencies')) AS asked FROM k WHERE path <> '') SELECT source, path, name, x->>'version' AS version, coalesce(CAST(x->>'dev' AS BOOLEAN), false) AS dev, list_contains(asked, name) AND path = 'node_modules/' || name AS direct FROM n",
    ),
    "yarn_lock": (
        lambda h: S.yarn_lock(frame(h, "yarn_locks")),
        "WITH " + values("yarn_locks") + r""", e AS (SELECT source, unnest(string_split(text, chr(10) || chr(10))) AS e FROM yarn_locks) SELECT DISTINCT source, regexp_extract(e, '^\x22?(@?[^@\x22\s]+)@', 1) AS name, regexp_extract(e, '\n\s+version:?\s+\x22?([^\x22\s]+)', 1) AS version FROM e WHERE regexp_matches(e, '^\x22?@?[^@\x22\s#]+@')""",
    ),
    "drift_past_sweeps": (lambda h: S.drift_past_sweeps(frame(h, "drifts"), frame(h, "swept")), "WITH " + values("drifts", "swept") + " SELECT manifest, max(date) AS date FROM drifts WHERE commit NOT IN (SELECT hash FROM swept) GROUP BY manifest"),
    "action_order": (
        lambda h: S.action_order(frame(h, "steps"), "Own").select(F.col("place").cast("long").alias("place"), "uses"),
        "WITH " + values("steps") + " SELECT row_number() OVER (ORDER BY CASE WHEN split_part(uses, '/', 1) IN ('actions', 'github') THEN 2 WHEN split_part(uses, '/', 1) = 'own' THEN 1 ELSE 0 END, coalesce(ref <> 'branch', true), NOT coalesce(secrets, false), pos) AS place, uses FROM steps",
    ),
    "rule_deep_nesting": (
        lambda h: told(S.deep_nesting(frame(h, "nested"), frame(h, "hot"))),
        "WITH " + values("nested", "hot") + ", d AS (SELECT * FROM nested WHERE nesting >= 5 OR bumps >= 3) SELECT CASE WHEN bool_or(file IN (SELECT path FROM hot)) THEN 'warning' ELSE 'info' END AS severity, 'deep_nesting' AS rule, arg_max(file || ':' || name, (cognitive, nesting, file)) AS subject FROM d",
    ),
    "rule_swallowed_errors": (
        lambda h: told(S.swallowed_errors(frame(h, "handlers"), frame(h, "hot"))),
        "WITH " + values("handlers", "hot") + " SELECT CASE WHEN bool_or(path IN (SELECT path FROM hot)) THEN 'warning' ELSE 'info' END AS severity, 'swallowed_errors' AS rule, arg_max(path, (path IN (SELECT path FROM hot), empty)) AS subject FROM handlers WHERE empty > 0 HAVING sum(empty) >= 5",
    ),
    "rule_commented_out": (lambda h: told(S.commented_out(frame(h, "findings_left"), "id")), "WITH " + values("findings_left") + " " + _findings("commented_out_code", "'info'", "id", "findings_left WHERE code_lines >= 10")),
    "rule_instructions_drift": (
        lambda h: told(S.instructions_drift(frame(h, "instructions"), "2024-01-15")),
        "WITH " + values("instructions") + " " + _findings("agent_instructions_drift", "'info'", "path", "instructions WHERE date <= DATE '2024-01-15' - INTERVAL 6 MONTH AND behind >= 100"),
    ),
    "rule_signoff_by_co_author": (
        lambda h: told(S.signoff_by_co_author(frame(h, "signers"), frame(h, "writers"))),
        "WITH " + values("signers", "writers") + " SELECT 'info' AS severity, 'signoff_by_co_author' AS rule, email AS subject FROM signers WHERE email NOT IN (SELECT email FROM writers) GROUP BY email HAVING count(DISTINCT hash) >= 2",
    ),
    "checks_run": (
        lambda h: S.checks_run(frame(h, "report"), frame(h, "checks")),
        "WITH " + values("report", "checks") + ", n AS (SELECT rule, count(*) AS n FROM report GROUP BY rule) SELECT measure, CASE WHEN skipped IS NOT NULL THEN 'not computed: ' || skipped WHEN n IS NULL THEN 'clean' ELSE n || ' found' END AS result FROM checks LEFT JOIN n ON rule = measure",
    ),
    "candidate_paired": (
        lambda h: S.paired(frame(h, "base_lists"), frame(h, "cand_lists"), frame(h, "outcomes")),
        "WITH " + values("base_lists", "cand_lists", "outcomes") + ", p AS (SELECT b.cut, b.path, b.place AS bp, c.place AS cp, (b.cut, b.path) IN (SELECT (cut, path) FROM outcomes) AS hit, row_number() OVER (PARTITION BY b.cut ORDER BY c.place NULLS LAST, b.place) AS place FROM base_lists b LEFT JOIN cand_lists c ON c.cut = b.cut AND c.path = b.path) SELECT cut, count(*) AS pool, count(*) FILTER (hit) AS positives, count(*) FILTER (hit AND bp <= 15) AS base_hits, count(*) FILTER (hit AND place <= 15) AS cand_hits, count(*) FILTER (hit AND place <= 15) - count(*) FILTER (hit AND bp <= 15) AS d, count(*) FILTER (hit) >= 0.5 * count(*) AS saturated, (SELECT count(*) FROM cand_lists c WHERE c.cut = p.cut AND (c.cut, c.path) NOT IN (SELECT (cut, path) FROM base_lists)) AS added, count(*) FILTER (cp IS NULL) AS dropped FROM p GROUP BY cut",
    ),
    "candidate_decided": (
        lambda h: S.decided(frame(h, "effects_of_cuts")),
        "WITH " + values("effects_of_cuts") + ", e AS (SELECT repo, avg(d) AS effect, row_number() OVER (ORDER BY repo) - 1 AS i FROM effects_of_cuts GROUP BY repo), m AS (SELECT mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -effect ELSE effect END) AS total FROM e, range(16) t(mask) GROUP BY mask) SELECT (SELECT avg(effect) FROM e) AS mean, count(*) FILTER (total >= (SELECT sum(effect) FROM e))/16e0 AS p, (SELECT count(*) FROM e WHERE effect > 0) AS wins, (SELECT count(*) FROM e WHERE effect < 0) AS losses, (SELECT count(*) FROM e WHERE effect = 0) AS ties FROM m",
    ),
    "snoring_cuts": (lambda h: S.snoring(frame(h, "cut_offs")).select("repo", "cut", "exposed"), "WITH " + values("cut_offs") + " SELECT repo, cut, coalesce(cut + INTERVAL 12 MONTH > label_end, false) AS exposed FROM cut_offs"),
    "signals_summed": (lambda h: S.signals(frame(h, "scores")), "WITH " + values("scores") + " SELECT variant, CAST(sum(hits) AS BIGINT) AS hits, median(auc) AS auc, median(recall) AS recall FROM scores GROUP BY variant"),
}
QUERIES = {name: (build, sql(text)) for name, (build, text) in QUERIES.items()}
