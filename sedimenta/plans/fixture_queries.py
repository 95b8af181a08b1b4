"""Registered queries on operators whose inputs the driver's tables don't hold: small tables, the same for both engines.

A fixture is a schema and rows; `frame` makes a DataFrame of it and `values`
the same rows as SQL, so that the second engine computes from the same input.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import graph as G
from ..operators import hygiene as H
from ..operators import identity as I
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import provenance as P
from ..operators import ranking as R
from ..operators import rules as U
from ..operators import scan as S
from ..operators.staging import shared_folder
from ..sources import changelog as L

day = dt.date
KEY = b"report key"
INNER, OUTER = (bytes(x ^ pad for x in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
LOG = [
    "a1--2024-01-03T10:00:00+02:00--Ada--fix(core): totals -- again (#12)\n3\t1\tsrc/{old => new}/a.py\n-\t-\tlogo.png",
    "b2--2024-01-02T23:30:00+02:00--Bob B--Merge work",
    "c3--2024-01-01T03:10:00-05:00--Ada--PROJ-7 start, and add tests\n10\t0\tsrc/old/a.py\n2\t2\tdocs/x.md\n5\t0\ttests/test_a.py",
]
SCAN = {"results": [
    {"source": "lock", "packages": [{"name": "p", "version": "1.9.0", "ecosystem": "npm", "vulnerabilities": [{"id": "A", "score": 9.1, "fixed": ["1.10.0", "1.8"]}, {"id": "B", "score": 3.0, "fixed": ["2.0"]}]}]},
    {"source": "lock2", "packages": [{"name": "q", "version": "0.1", "ecosystem": "PyPI", "vulnerabilities": [{"id": "C", "score": 7.5, "fixed": []}]}, {"name": "r", "version": "3", "ecosystem": "Go", "vulnerabilities": [{"id": "D", "score": 4.0, "fixed": ["3.1"]}]}]},
]}
SCAN_SCHEMA = "results array<struct<source string, packages array<struct<name string, version string, ecosystem string, vulnerabilities array<struct<id string, score double, fixed array<string>>>>>>>"
COUNTER = [
    {"Name": "Python", "Files": [{"Location": "a.py", "Code": 10, "Comment": 2, "Blank": 1, "Complexity": 3}, {"Location": "b/c.py", "Code": 5, "Comment": 0, "Blank": 2, "Complexity": 0}]},
    {"Name": "C", "Files": [{"Location": "x.c", "Code": 40, "Comment": 9, "Blank": 4, "Complexity": 12}]},
]

FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "moves": ("path string", [("src/{old => new}/a.py",), ("{ => lib}/b.py",), ("a/{b => }/c.py",), ("x.py => y/z.py",), ("plain.py",)]),
    "log": ("record string", [(r,) for r in LOG]),
    "bodies": ("hash string, body string", [("a", "Revert it\n\nThis reverts commit 0123abcd."), ("b", "This reverts commit fedcba9876543210fedcba9876543210fedcba98\nand\nThis reverts commit 7654321."), ("c", "He said: This reverts commit 1111111."), ("d", "This reverts commit 12345.")]),
    "revs": ("line string", [("# formatting",), ("0123456789abcdef # sweep",), ("fedcba9",), ("",), ("not a hash",), ("0123456789abcdef",)]),
    "listing": ("path string", [("a.py",), ("dir with space/b.py",), ("docs/ü.md",)]),
    "authors": ("line string", [("Ada\tada@x.org",), ("Ada\tada@x.org",), ("Bob\tbob@x.org",), ("no tab",), ("Ada\tother@x.org",)]),
    "csv": ("line string", [('12,16,80,2,14,"f@1","a.py","f","f()",1,14',), ('12,16,80,2,14,"f@1","a.py","f","f()",1,14',), ('130,21,900,1,130,"g@20","a.py","g","g()",20,150',), ('5,2,30,0,5,"x@9","b.js","(anonymous)","x",9,13',)]),
    "toml": ("path string, text string", [("a/Cargo.toml", '[package]\nname = "x"\nlicense = "MIT"\n[dependencies]\nserde = "1"\nlog-x = { version = "2" }\n[dev-dependencies]\ny = "1"\n'), ("b/Cargo.toml", '[lib]\nlicense = "no"\n[package]\nname = \'z\'\n[target.x.dependencies]\nwin = "3"\n'), ("c/Cargo.toml", "")]),
    "npm": ("path string, text string", [("package.json", '{"dependencies": {"left-pad": "1", "@s/p": "^2", "chalk": "5"}, "devDependencies": {"jest": "29"}, "scripts": {"postinstall": "node x", "test": "y", "prepare": "tsc"}}'), ("b/package.json", '{"scripts": {"install": "make"}}'), ("c/package.json", "{}")]),
    "gomod": ("path string, text string", [("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\nrequire gopkg.in/x.v2 v2.4.0\n")]),
    "heads": ("path string, text string", [("a.py", "# Code generated by tool\nx"), ("b.min.js", "x"), ("c.py", "#!/usr/bin/env -S FOO=1 python3.12\n"), ("d", "#!/bin/sh -e\n"), ("e.py", "\n" * 8 + "# do not edit"), ("f.py", "# maintained and not auto-generated\n"), ("dist/g.js", "y"), ("h", "#!/usr/bin/env ruby\nputs 1")]),
    "people": ("name string, email string, commits long, trailers long", [("Ada Byron", "ada@x.org", 5, 0), ("Byron Ada", "12+ada-b@users.noreply.host.com", 2, 0), ("dependabot[bot]", "49+dependabot[bot]@users.noreply.host.com", 30, 0), ("Release CI", "ci@x.org", 3, 0), ("Bob", "noreply@z.org", 3, 0), ("Eve", "noreply@z.org", 3, 3), ("Tool", "no-reply@t.org", 10, 10), ("Zed", "", 1, 0), ("Ada Lovelace", "al@x.org", 1, 0)]),
    "sightings": ("value string, rule string, file string, commit string, line long, confidence string, at_head boolean, test_code boolean, local boolean", [("v1", "key", "a.py", "c1", 1, "low", True, False, False), ("v1", "key", "b.py", "c2", 2, "high", False, True, False), ("v2", "key", "t.py", "c1", 1, "medium", True, True, False), ("v3", "tok", "l.env", "c1", 1, "medium", True, False, True), ("v4", "tok", "m.py", "c3", 9, "medium", False, False, False)]),
    "found": ("rule string, file string, commit string, line long, secret string", [("generic-key", "f", "c", 1, v) for v in ("xxxxxxxx", "changeme", "${KEY}", "abcdefgh", "aaaaaaaa", "q8Zr" + "T1mK9sLp", "lettersOnlyHere")] + [("cloud-key", "g", "d", 2, "Zx9" + "kLm42pQ7rT")]),
    "packages": ("ecosystem string, name string, version string", [("PyPI", "A_b", "1.0"), ("npm", "@s/p", "2"), ("Go", "github.com/a/b", "v1.2.3"), ("crates.io", "serde", None), ("Maven", "g:a", "1"), ("other", "x", "0")]),
    "flows": ("path string, text string", [("p.yml", "on: pull_request_target\n - uses: actions/checkout@v4\n   with:\n    ref: ${{ github.event.pull_request.head.sha }}\n"), ("i.yml", " - run: echo ${{ github.event.issue.title }}\n - uses: './local'\n"), ("ok.yml", " - run: echo hi\n - uses: c/d@" + "0" * 40 + " # v3\n - uses: \"e/f@main\"\n")]),
    "manifests": ("path string, time long", [("a/b/package.json", 9), ("c/package.json", 1), ("d/go.mod", 4)]),
    "locks": ("path string, time long", [("a/package-lock.json", 5), ("package-lock.json", 3), ("d/go.sum", 4)]),
    "tree": ("path string", [("README.md",), ("LICENSE",), ("a/package.json",), ("a/yarn.lock",), ("c/package.json",), ("go.mod",), ("go.sum",), ("b/Cargo.toml",), ("CLAUDE.md",), (".github/workflows/ci.yml",), (".env",), (".env.example",), ("keys/id_rsa",), ("docs/security.md",)]),
    "updaters": ("ecosystem string", [("npm",), ("docker",)]),
    "declared": ("name string, registry string", [("@s/p", "npm.x.org"), ("@s/q", "npm.x.org")]),
    "locked": ("name string, url string", [("@s/p", "https://registry.npmjs.org/p.tgz"), ("@s/q", "https://npm.x.org/q.tgz"), ("z", "https://registry.npmjs.org/z.tgz")]),
    "licensed": ("name string, licence string", [("a", "MIT"), ("b", "GPL-3.0-only"), ("c", "MIT OR GPL-2.0"), ("d", "LGPL-2.1+"), ("e", "SSPL-1.0"), ("f", "Own-1.0"), ("g", "MIT AND MPL-2.0"), ("h", "GPL-2.0 WITH Classpath-exception-2.0"), ("i", "Own-1.0 OR MPL-2.0"), ("j", None), ("k", "CDDL-1.0"), ("l", "MIT/X11")]),
    "modules": ("text string", [('[submodule "a"]\n path = a\n url = http://h/a\n[submodule "b"]\n url = https://u:p@h/b\n[submodule "c"]\n url = https://h/c\n[submodule "d"]\n url = ../d\n',)]),
    "links": ("path string, target string", [("a/b", "../c"), ("a/d", "../../e"), ("f", "/etc/x"), ("g/h/i", "../../j"), ("k", "./l/../../m")]),
    "bytes": ("path string, hex string", [("x", "7f454c460201"), ("y", "74657874"), ("z", "504b030414"), ("w", "4d5a9000"), ("v", "1f8b08"), ("u", "cafebabe0000")]),
    "owner_lines": ("line string", [("# note",), ("*.md @x",), ("/a/ @y",), ("go.* @w",), ("nothing.txt @z",)]),
    "agents": ("path string, text string", [(".x/settings.local.json", '{"enableAllProjectMcpServers": true, "mcpServers": {"a": {"env": {"K": "0123456789abcdef"}}, "b": {"env": {"K": "$KEY"}}}}'), (".x/settings.json", '{"permissions": {"defaultMode": "bypassPermissions"}}'), (".y.json", '{"mcpServers": {"b": {"env": {"K": "$KEY_OF_SOMETHING"}}}}')]),
    "facts": ("a boolean, b boolean, c boolean", [(True, False, None)]),
    "trailers": ("hash string, key string", [("a", "Signed-off-by"), ("a", "PROJ-1"), ("b", "signed-off-by"), ("c", "Signed-off-by"), ("c", "Reviewed-by"), ("c", "Reviewed-by"), ("d", "REVIEWED-BY"), ("e", "reviewed-by")]),
    "signed": ("date date, signature string", [(day(2023, 5, 1), "-----BEGIN PGP SIGNATURE"), (day(2023, 6, 2), None), (day(2024, 1, 1), "-----BEGIN SSH SIGNATURE"), (day(2024, 1, 2), "-----BEGIN SIGNED MESSAGE-----"), (day(2024, 1, 3), ""), (day(2024, 1, 4), "odd")]),
    "signatures": ("file string, signature string", [("one.c", f"f{i}()") for i in range(25)] + [("p.c", f"f{i}()") for i in range(12)] + [("q.c", f"f{i}()") for i in range(12, 24)] + [("r.c", f"h{i}()") for i in range(30)]),
    "first_parser": ("file string, function string, start long, stop long", [("f", "a", 1, 100), ("f", "b", 200, 210), ("f", "c", 300, 305), ("f", "c2", 300, 306), ("g", "d", 1, 3)]),
    "second_parser": ("file string, function string, start long, stop long", [("f", "a", 1, 10), ("f", "b", 200, 212), ("f", "c", 300, 350), ("g", "e", 1, 90)]),
    "functions": ("file string, function string, ccn long, nloc long", [("a.py", "f", 16, 120), ("a.py", "g", 30, 40), ("b.py", "h", 15, 100), ("b.py", "i", 2, 300)]),
    "grown": ("path string, before double, after double", [("a", 10.0, 13.0), ("b", 8.0, 10.0), ("c", 4.0, 8.0), ("d", 5.0, 5.5)]),
    "texts": ("id string, text string", [("d", "see 10.20.30.40 and 127.0.0.1, 192.0.2.9\n# TODO later\n# x = 1\n# y = f(x)\n# return y\nsafe‮ line\npаypal ok"), ("e", "HACK and FIXME and FIXME\nnothing"), ("f", "TODOS are words, 8.8.8.8:53 and 1.2.3.4.5 and 999.1.1.1"), ("g", "⁦x\nαb")]),
    "sources": ("path string, text string", [("a.py", "import os\nfrom os.path import join\nimport left_pad\n"), ("b.js", "const x = require('jest');\nimport y from '@s/p/sub';\n"), ("c.py", "x = 1\n")]),
    "renames": ("old string, new string", [("a", "b"), ("b", "c"), ("x", "y")]),
    "edges": ("src string, dst string", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("x", "y"), ("y", "x"), ("d", "f"), ("f", "d"), ("f", "g")]),
    "coupled": ("entity string, coupled string, degree long, average_revs long", [("a", "b", 90, 9), ("a", "z", 85, 6), ("k", "m", 61, 5), ("k", "n", 59, 50), ("p", "q", 70, 4)]),
    "pvalues": ("path string, p double", [("a", 0.001), ("b", 0.012), ("c", 0.02), ("d", 0.039), ("e", 0.2), ("f", 0.9), ("g", 0.012)]),
    "effects": ("repo string, effect double", [("a", 1.0), ("b", 2.0), ("c", -1.0), ("d", 0.5), ("e", 0.0)]),
    "owned": ("path string, person string, added long", [("a", "ada", 900), ("b", "ada", 300), ("b", "bob", 100), ("c", "eve", 40)]),
    "report": ("severity string, rule string, subject string, evidence string", [("info", "b", "x", "{}"), ("critical", "a", "y", "{}"), ("warning", "c", "z", "{}"), ("info", "a", "w", "{}")]),
    "later_report": ("severity string, rule string, subject string, evidence string", [("info", "b", "x", "{}"), ("critical", "a", "new", "{}"), ("info", "a", "w", "{}")]),
    "old_names": ("old string, new string", [("y", "new")]),
    "present": ("path string", [("x",), ("w",), ("new",), ("z",)]),
}
KINDS = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def frame(h, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    return h.spark.createDataFrame(rows, schema)


def _literal(x: object) -> str:
    if x is None or isinstance(x, bool):
        return {None: "NULL", True: "true", False: "false"}[x]
    if isinstance(x, str):
        parts = ["'" + p.replace("'", "''") + "'" for p in x.split("\n")]
        return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"
    return f"DATE '{x}'" if isinstance(x, day) else repr(x)


def values(*names: str) -> str:
    """Fixtures as common tables of SQL."""
    out = []
    for name in names:
        schema, rows = FIXTURES[name]
        columns = [c.split() for c in schema.split(", ")]
        told = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in rows)
        cast = ", ".join(f"CAST({c} AS {KINDS[k]}) AS {c}" for c, k in columns)
        out.append(f"{name} AS (SELECT {cast} FROM (VALUES {told}) t({', '.join(c for c, _ in columns)}))")
    return ", ".join(out)


def written(h, name: str, lines: list[str], end: str = "\n") -> str:
    """A file of lines in the shared folder, for readers of files."""
    path = f"{shared_folder(h.spark)}/{name}-{uuid.uuid4().hex}"
    h.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.option("lineSep", end).text(path)
    return path


def lines_of(name: str) -> list[str]:
    return [r[0] for r in FIXTURES[name][1]]


def commits(h) -> DataFrame:
    return L.read(h.spark, written(h, "log", [f"--{r}\n" for r in LOG]))


def scanned(h) -> DataFrame:
    found = h.spark.createDataFrame([(json.dumps(SCAN),)], "j string").select(F.from_json("j", SCAN_SCHEMA).alias("x")).select("x.results")
    return S.vulnerable_packages(found)


HEADER = "h AS (SELECT split_part(record, chr(10), 1) AS head, string_split(record, chr(10))[2:] AS rest FROM log), c AS (SELECT split_part(head, '--', 1) AS hash, split_part(head, '--', 2) AS time, split_part(head, '--', 3) AS author, substr(head, length(split_part(head, '--', 1)) + length(split_part(head, '--', 2)) + length(split_part(head, '--', 3)) + 7) AS subject, rest FROM h)"
TOLD = f"scan AS (SELECT '{json.dumps(SCAN)}'::JSON AS j), r AS (SELECT unnest(json_extract(j, '$.results[*]')) AS r FROM scan), p AS (SELECT r->>'source' AS source, unnest(json_extract(r, '$.packages[*]')) AS p FROM r), v AS (SELECT source, p->>'name' AS name, p->>'version' AS version, p->>'ecosystem' AS ecosystem, unnest(json_extract(p, '$.vulnerabilities[*]')) AS v FROM p)"
NUMBERS = "list_transform(regexp_extract_all({}, '\\d+'), lambda x: CAST(x AS BIGINT))"
PACKAGES = f"{TOLD}, f AS (SELECT source, name, version, ecosystem, v->>'id' AS id, CAST(v->>'score' AS DOUBLE) AS score, list_filter(CAST(v->'fixed' AS VARCHAR[]), lambda y: {NUMBERS.format('y')} > {NUMBERS.format('version')}) AS higher FROM v), g AS (SELECT *, (SELECT arg_min(u, {NUMBERS.format('u')}) FROM (SELECT unnest(higher) AS u)) AS fix FROM f), pk AS (SELECT name, version, ecosystem, source, count(*) AS advisories, string_agg(id, ',' ORDER BY id) AS ids, max(score) AS score, arg_min(fix, {NUMBERS.format('fix')}) AS fixed FROM g GROUP BY ALL)"
BAD_SHAPE = r"regexp_matches(lower(secret), '^(x{3,}|\*{3,}|\.{3,}|changeme|change[-_ ]me|your[-_ ].*|example.*|placeholder|dummy|test(ing)?|secret|password|none|null|todo|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$') OR len(list_distinct(string_split(lower(secret), ''))) <= 2 OR contains('abcdefghijklmnopqrstuvwxyz0123456789', lower(secret)) OR contains('0123456789012345678901234567890', lower(secret))"
MARKER = r"regexp_matches(array_to_string(list_filter(string_split(replace(lower(text), 'not auto-generated', ''), chr(10)), lambda x, i: i <= 5), chr(10)), 'auto[- ]?generated|generated (by|from|file|code|automatically|with)|do not (edit|modify)|@generated|code generated')"
CODE = r"regexp_matches(line, '^\s*(#|//)\s*(return\b|import\b|from\b|if\b.*[:{]|for\b.*[:{]|while\b.*[:{]|def\b|[\w.\[\]]+\s*(=|\+=|-=)\s*\S|[\w.]+\(.*\)\s*;?$|.*[;{}]\s*$)')"
LINES = "lines AS (SELECT id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS number, unnest(string_split(text, chr(10))) AS line FROM texts)"
PUBLIC = r"a AS (SELECT id, unnest(regexp_extract_all(text, '(?:^|[^\d.])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?:[^\d.]|$)', 1)) AS address FROM texts), o AS (SELECT *, list_transform(string_split(address, '.'), lambda x: CAST(x AS INTEGER)) AS q FROM a), pub AS (SELECT id, address, count(*) AS n FROM o WHERE list_max(q) <= 255 AND q[1] NOT IN (0, 127, 255) AND NOT (q[1]=192 AND q[2]=0 AND q[3]=2) GROUP BY 1, 2)"
REACH = "r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src), scc AS (SELECT a.src AS node, least(min(a.src), min(a.dst)) AS root FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src)"
FOLDERS = "list_distinct(list_transform(range(0, len(parts) + 1), lambda n: array_to_string(parts[1:n], '/')))"


def told(df: DataFrame) -> DataFrame:
    return df.select("severity", "rule", "subject")


def _findings(rule: str, severity: str, subject: str, source: str) -> str:
    return f"SELECT {severity} AS severity, '{rule}' AS rule, {subject} AS subject FROM {source}"


QUERIES: dict[str, tuple] = {
    # readers
    "renames_of_log": (
        lambda h: frame(h, "moves").select("path", X.renamed_to("path").alias("now"), X.renamed_from("path").alias("was")),
        rf"WITH {values('moves')} SELECT path, CASE WHEN regexp_matches(path, '\{{[^{{}}]* => [^{{}}]*\}}') THEN replace(regexp_replace(path, '\{{[^{{}}]*? => ([^{{}}]*)\}}', '\1', 'g'), '//', '/') ELSE list_last(string_split(path, ' => ')) END AS now, CASE WHEN regexp_matches(path, '\{{[^{{}}]* => [^{{}}]*\}}') THEN regexp_replace(replace(regexp_replace(path, '\{{([^{{}}]*?) => [^{{}}]*\}}', '\1', 'g'), '//', '/'), '^/', '') ELSE string_split(path, ' => ')[1] END AS was FROM moves",
    ),
    "log_scan": (
        lambda h: commits(h).select("hash", "date", "author", "subject", "hour", F.size("files").alias("n_files")),
        f"WITH {values('log')}, {HEADER} SELECT hash, CAST(substr(time, 1, 10) AS DATE) AS date, author, subject, CAST(substr(time, 12, 2) AS INTEGER) AS hour, CAST(len(rest) AS INTEGER) AS n_files FROM c",
    ),
    "log_changes": (
        lambda h: L.changes(commits(h)).select("hash", "path", "renamed", "added", "deleted"),
        rf"WITH {values('log')}, {HEADER}, f AS (SELECT hash, string_split(unnest(rest), chr(9)) AS x FROM c) SELECT hash, replace(regexp_replace(x[3], '\{{[^{{}}]*? => ([^{{}}]*)\}}', '\1', 'g'), '//', '/') AS path, contains(x[3], ' => ') AS renamed, coalesce(try_cast(x[1] AS BIGINT), 0) AS added, coalesce(try_cast(x[2] AS BIGINT), 0) AS deleted FROM f",
    ),
    "log_people": (lambda h: L.people(commits(h)).select("hash", "date", "people", "position", "person"), f"WITH {values('log')}, {HEADER} SELECT hash, CAST(substr(time, 1, 10) AS DATE) AS date, 1 AS people, 0 AS position, author AS person FROM c"),
    "revert_scan": (lambda h: L.reverts(frame(h, "bodies")), rf"WITH {values('bodies')} SELECT hash, unnest(regexp_extract_all(body, '(?m)^This reverts commit ([0-9a-f]{{7,40}})\b', 1)) AS reverted FROM bodies"),
    "ignored_revisions": (lambda h: L.ignored(h.spark, written(h, "revs", lines_of("revs"))), f"WITH {values('revs')}, t AS (SELECT DISTINCT trim(regexp_replace(line, '#.*$', '')) AS hash FROM revs) SELECT hash FROM t WHERE regexp_full_match(hash, '[0-9a-f]{{7,64}}')"),
    "tree_listing": (lambda h: L.tree(h.spark, written(h, "tree", lines_of("listing"), "\0")), f"WITH {values('listing')} SELECT path FROM listing"),
    "author_log": (lambda h: L.author_log(h.spark, written(h, "authors", lines_of("authors"))), f"WITH {values('authors')} SELECT split_part(line, chr(9), 1) AS name, split_part(line, chr(9), 2) AS email, count(*) AS commits FROM authors WHERE contains(line, chr(9)) GROUP BY 1, 2"),
    "function_metrics": (
        lambda h: L.functions(h.spark, written(h, "csv", lines_of("csv"))).select("file", "function", "anonymous", "ccn", "nloc", "start"),
        f"WITH {values('csv')}, d AS (SELECT DISTINCT string_split(replace(line, '\"', ''), ',') AS x FROM csv) SELECT x[7] AS file, CASE WHEN x[8] IN ('', '(anonymous)') THEN 'anonymous at ' || x[10] ELSE x[8] END AS function, x[8] IN ('', '(anonymous)') AS anonymous, CAST(x[2] AS BIGINT) AS ccn, CAST(x[1] AS BIGINT) AS nloc, CAST(x[10] AS BIGINT) AS start FROM d",
    ),
    "language_sizes": (
        lambda h: L.languages(L.sizes(h.spark, written(h, "counter", [json.dumps(COUNTER)]))),
        f"WITH s AS (SELECT unnest(json_extract('{json.dumps(COUNTER)}'::JSON, '$[*]')) AS l), f AS (SELECT l->>'Name' AS language, unnest(json_extract(l, '$.Files[*]')) AS f FROM s) SELECT language, count(*) AS files, " + ", ".join(f"CAST(sum(CAST(f->>'{c.capitalize()}' AS BIGINT)) AS BIGINT) AS {c}" for c in ("code", "comment", "blank", "complexity")) + " FROM f GROUP BY language",
    ),
    "toml_licence": (
        lambda h: frame(h, "toml").select("path", L.toml_value(F.col("text"), "package", "license").alias("licence")),
        rf"WITH {values('toml')} SELECT path, nullif(regexp_extract(list_filter(string_split(chr(10) || text, chr(10) || '['), lambda x: starts_with(x, 'package]'))[1], '(?m)^\s*license\s*=\s*[\x22'']([^\x22'']*)', 1), '') AS licence FROM toml",
    ),
    "cargo_manifest": (
        lambda h: L.cargo_packages(frame(h, "toml")),
        rf"WITH {values('toml')}, s AS (SELECT path, unnest(string_split(chr(10) || text, chr(10) || '[')) AS x FROM toml), l AS (SELECT path, unnest(string_split(x, chr(10))) AS line FROM s WHERE regexp_matches(x, '^(target\..*\.)?dependencies\]')) SELECT path, regexp_extract(line, '^\s*([A-Za-z0-9_-]+)\s*=', 1) AS name FROM l WHERE regexp_matches(line, '^\s*[A-Za-z0-9_-]+\s*=')",
    ),
    "npm_manifest": (
        lambda h: L.npm_packages(frame(h, "npm")),
        "WITH " + values("npm") + ", k AS (SELECT path, s AS scope, text::JSON->s AS d FROM npm, (VALUES ('dependencies'), ('devDependencies')) t(s)), n AS (SELECT path, scope, d, unnest(json_keys(d)) AS name FROM k WHERE d IS NOT NULL) SELECT path, name, (CAST(d AS MAP(VARCHAR, VARCHAR)))[name] AS version, scope FROM n",
    ),
    "go_manifest": (
        lambda h: L.go_modules(frame(h, "gomod")),
        rf"WITH {values('gomod')}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line FROM gomod) SELECT path, regexp_extract(line, '^\s*(?:require\s+)?([\w.\-/~]+\.[\w.\-/~]+)\s+(v\S+)', 1) AS name, regexp_extract(line, '^\s*(?:require\s+)?([\w.\-/~]+\.[\w.\-/~]+)\s+(v\S+)', 2) AS version FROM l WHERE NOT contains(line, '// indirect') AND regexp_matches(line, '^\s*(?:require\s+)?([\w.\-/~]+\.[\w.\-/~]+)\s+(v\S+)')",
    ),
    # files
    "generated_files": (lambda h: frame(h, "heads").select("path", H.says_generated("text", "path").alias("generated")), rf"WITH {values('heads')} SELECT path, {MARKER} OR regexp_matches(lower(path), '\.(min\.js|min\.css|bundle\.js|map)$|(^|/)dist/') AS generated FROM heads"),
    "shebang_types": (
        lambda h: frame(h, "heads").select("path", H.interpreter("text").alias("program")).where("program IS NOT NULL"),
        rf"WITH {values('heads')}, l AS (SELECT path, regexp_replace(regexp_replace(regexp_extract(text, '^#!\s*([^\n]*)', 1), '^\S*/env\s+(-\S+\s+)*', ''), '^([A-Za-z_][A-Za-z0-9_]*=\S*\s+)+', '') AS rest FROM heads WHERE starts_with(text, '#!')) SELECT path, regexp_replace(regexp_replace(split_part(rest, ' ', 1), '^.*/', ''), '[\d.]+$', '') AS program FROM l",
    ),
    "binary_files": (
        lambda h: H.binaries(frame(h, "bytes").select("path", F.unhex("hex").alias("content"))),
        f"WITH {values('bytes')} SELECT path, kind FROM bytes JOIN (VALUES " + ", ".join(f"('{k}', '{m}')" for k, m in H.MAGIC) + ") t(kind, magic) ON starts_with(hex, magic)",
    ),
    "submodule_risks": (
        lambda h: H.submodules(frame(h, "modules")),
        rf"WITH {values('modules')}, s AS (SELECT unnest(string_split(text, '[submodule ')) AS x FROM modules), u AS (SELECT regexp_extract(x, '^\x22([^\x22]+)', 1) AS name, regexp_extract(x, 'url\s*=\s*(\S+)', 1) AS url FROM s WHERE contains(x, 'url')) SELECT name, url, CASE WHEN regexp_matches(url, '^[a-z+]+://[^/@]*:[^/@]+@') THEN 'credentials' WHEN regexp_matches(url, '^(http|git)://') THEN 'plain transport' WHEN regexp_matches(url, '^(\.\./|/|file:)') THEN 'local' END AS problem FROM u",
    ),
    "symlink_targets": (
        lambda h: H.symlinks(frame(h, "links")),
        f"WITH {values('links')}, p AS (SELECT *, list_concat(list_filter(string_split(path, '/')[:-2], lambda x: x <> ''), list_filter(string_split(target, '/'), lambda x: x NOT IN ('', '.'))) AS parts FROM links), d AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END))) AS depth FROM p) SELECT path, target, starts_with(target, '/') OR coalesce(list_min(depth) < 0, false) AS outside FROM d",
    ),
    "policies_held": (
        lambda h: H.presence(frame(h, "tree")),
        "WITH " + values("tree") + r", p AS (SELECT * FROM (VALUES ('readme', '^readme(\.|$)'), ('licence', '^(licen[cs]e|copying)(\.|-|_|$)'), ('contributing', '^(\.github/|docs/)?contributing(\.|$)'), ('security', '^(\.github/|docs/)?security(\.|$)'), ('codeowners', '^(\.github/|docs/|\.gitlab/)?codeowners$'), ('changelog', '^(changelog|changes|history|news)(\.|$)')) t(policy, pattern)) SELECT policy, bool_or(regexp_matches(lower(path), pattern)) AS present FROM p, tree GROUP BY policy",
    ),
    "owner_patterns": (
        lambda h: H.owner_patterns(frame(h, "owner_lines"), frame(h, "tree")),
        "WITH " + values("owner_lines", "tree") + ", o AS (SELECT split_part(line, ' ', 1) AS pattern FROM owner_lines WHERE line NOT LIKE '#%') SELECT pattern, count(path) AS matched FROM o LEFT JOIN tree ON CASE WHEN starts_with(pattern, '/') THEN starts_with('/' || path, pattern) ELSE list_last(string_split(path, '/')) GLOB pattern END GROUP BY pattern",
    ),
    "missing_updaters": (
        lambda h: H.missing_updates(frame(h, "tree"), frame(h, "updaters")),
        "WITH " + values("tree", "updaters") + r", e AS (SELECT * FROM (VALUES ('npm', '(^|/)package\.json$'), ('pip', '(^|/)(requirements[^/]*\.txt|pyproject\.toml|setup\.py)$'), ('gomod', '(^|/)go\.mod$'), ('cargo', '(^|/)Cargo\.toml$'), ('github-actions', '^\.github/workflows/[^/]+\.ya?ml$'), ('docker', '(^|/)Dockerfile$')) t(ecosystem, pattern)) SELECT DISTINCT ecosystem FROM e JOIN tree ON regexp_matches(path, pattern) WHERE ecosystem NOT IN (SELECT ecosystem FROM updaters)",
    ),
    "missing_locks": (
        lambda h: H.missing_locks(frame(h, "tree")),
        "WITH " + values("tree") + f", w AS (SELECT * FROM (VALUES ('package.json', 'package-lock.json'), ('package.json', 'yarn.lock'), ('package.json', 'pnpm-lock.yaml'), ('Cargo.toml', 'Cargo.lock'), ('go.mod', 'go.sum')) t(name, lock)), m AS (SELECT path AS manifest, list_last(string_split(path, '/')) AS name, string_split(path, '/')[:-2] AS parts FROM tree WHERE list_last(string_split(path, '/')) IN (SELECT name FROM w)), a AS (SELECT manifest, name, unnest({FOLDERS}) AS folder FROM m) SELECT manifest FROM m WHERE manifest NOT IN (SELECT manifest FROM a JOIN w USING (name) JOIN tree ON tree.path = CASE WHEN folder = '' THEN lock ELSE folder || '/' || lock END)",
    ),
    "lock_drift": (
        lambda h: S.lock_drift(frame(h, "manifests"), frame(h, "locks")),
        "WITH " + values("manifests", "locks") + f", m AS (SELECT path AS manifest, time, string_split(path, '/')[:-2] AS parts FROM manifests), a AS (SELECT manifest, time, unnest({FOLDERS}) AS folder FROM m), l AS (SELECT path AS lock, time AS lt, array_to_string(string_split(path, '/')[:-2], '/') AS folder FROM locks) SELECT manifest, arg_max(lock, length(folder)) AS lock, arg_max(time > lt, length(folder)) AS drifted FROM a JOIN l USING (folder) GROUP BY manifest",
    ),
    "install_scripts": (
        lambda h: H.install_scripts(frame(h, "npm")),
        "WITH " + values("npm") + ", s AS (SELECT path, text::JSON->'scripts' AS s FROM npm), k AS (SELECT path, s, unnest(json_keys(s)) AS script FROM s WHERE s IS NOT NULL) SELECT path, script, (CAST(s AS MAP(VARCHAR, VARCHAR)))[script] AS command FROM k WHERE script IN ('preinstall', 'install', 'postinstall', 'prepare')",
    ),
    "workflow_risks": (
        lambda h: H.workflow_risks(frame(h, "flows")),
        "WITH " + values("flows") + " SELECT path, 'pwn request' AS risk FROM flows WHERE contains(text, 'pull_request_target') AND contains(text, 'actions/checkout') AND contains(text, 'github.event.pull_request.head') UNION ALL SELECT path, 'injection' FROM flows WHERE regexp_matches(text, 'run:[^\\n]*\\$\\{\\{\\s*github\\.event\\.issue\\.title')",
    ),
    "action_pins": (
        lambda h: S.action_pins(frame(h, "flows"), "path", "text"),
        "WITH " + values("flows") + r", l AS (SELECT path, unnest(string_split(text, chr(10))) AS line FROM flows), u AS (SELECT path, regexp_extract(line, '^\s*-?\s*uses:\s*[\x22'']?([^\x22''\s#]+)', 1) AS uses FROM l) SELECT path, uses, regexp_matches(uses, '@[0-9a-f]{40}$') AS pinned FROM u WHERE uses <> '' AND uses NOT LIKE './%'",
    ),
    "rule_unpinned_actions": (
        lambda h: told(U.unpinned_actions(S.action_pins(frame(h, "flows"), "path", "text"), "path")),
        "WITH " + values("flows") + r", l AS (SELECT path, unnest(string_split(text, chr(10))) AS line FROM flows), u AS (SELECT path, regexp_extract(line, '^\s*-?\s*uses:\s*[\x22'']?([^\x22''\s#]+)', 1) AS uses FROM l) " + _findings("hygiene_actions", "'info'", "path || ' ' || uses", "u WHERE uses <> '' AND uses NOT LIKE './%' AND NOT regexp_matches(uses, '@[0-9a-f]{40}$')"),
    ),
    "dependency_confusion": (lambda h: H.confusion(frame(h, "declared"), frame(h, "locked")), "WITH " + values("declared", "locked") + " SELECT name, registry, split_part(split_part(url, '://', 2), '/', 1) AS host FROM declared JOIN locked USING (name) WHERE registry <> split_part(split_part(url, '://', 2), '/', 1)"),
    "licence_strength": (
        lambda h: frame(h, "licensed").select("name", H.licence_strength("licence").alias("strength")),
        "WITH " + values("licensed") + r""", t AS (SELECT name, licence, CASE WHEN contains(licence, ' OR ') OR contains(licence, '/') THEN 'or' ELSE 'and' END AS op, unnest(regexp_split_to_array(regexp_replace(licence, ' WITH .*', ''), ' OR | AND |/')) AS id FROM licensed WHERE licence IS NOT NULL),
        f AS (SELECT name, op, CASE WHEN upper(id) IN ('MIT', 'X11') THEN 0 WHEN regexp_matches(id, '^(LGPL|MPL|EPL|CDDL|CPL)-') THEN 1 WHEN regexp_matches(id, '^(GPL|AGPL|SSPL|EUPL|OSL)-') THEN CASE WHEN contains(licence, ' WITH ') THEN 1 ELSE 2 END END AS rank FROM t),
        g AS (SELECT name, CASE WHEN op = 'and' THEN max(rank) WHEN min(rank) = 0 THEN 0 WHEN count(*) > count(rank) THEN NULL ELSE min(rank) END AS rank FROM f GROUP BY name, op) SELECT name, CASE rank WHEN 0 THEN 'permissive' WHEN 1 THEN 'weak copyleft' WHEN 2 THEN 'strong copyleft' END AS strength FROM licensed LEFT JOIN g USING (name)""",
    ),
    "agent_risks": (
        lambda h: H.agent_risks(frame(h, "agents")),
        "WITH " + values("agents") + ", j AS (SELECT path, text::JSON AS j FROM agents) SELECT path, 'agent_approval_disabled' AS risk FROM j WHERE lower(coalesce(j->'permissions'->>'defaultMode', '')) IN ('bypasspermissions', 'dontask') OR (j->>'enableAllProjectMcpServers') = 'true' UNION ALL SELECT path, 'agent_local_settings' FROM j WHERE regexp_matches(path, '(^|/)settings\\.local\\.json$') UNION ALL SELECT DISTINCT path, 'mcp_literal_env' FROM (SELECT path, unnest(CAST(json_extract_string(j, '$.mcpServers.*.env.*') AS VARCHAR[])) AS v FROM j) WHERE length(v) >= 12 AND NOT starts_with(v, '$')",
    ),
    "agent_files": (lambda h: H.agent_files(frame(h, "tree")), "WITH " + values("tree") + r" SELECT path FROM tree WHERE regexp_matches(path, '(^|/)(CLAUDE|AGENTS|GEMINI)\.md$')"),
    "control_coverage": (lambda h: H.control_coverage(frame(h, "facts")), "WITH " + values("facts") + " SELECT control, CASE met WHEN true THEN 'met' WHEN false THEN 'gap' ELSE 'unknown' END AS result FROM (SELECT 'a' AS control, a AS met FROM facts UNION ALL SELECT 'b', b FROM facts UNION ALL SELECT 'c', c FROM facts)"),
    # people, commits
    "bots_and_mailboxes": (
        lambda h: frame(h, "people").select("name", "email", I.is_bot("name", "email").alias("bot"), I.shared_mailbox("email").alias("shared"), I.forge_login(F.col("email")).alias("login"), F.array_join(I.tokens(F.col("name")), " ").alias("words")),
        "WITH " + values("people") + r" SELECT name, email, ends_with(name, '[bot]') OR regexp_matches(lower(name), '\bbot\b|\bci\b|deploy|automation|releaser') OR contains(email, '[bot]@') AS bot, email = '' OR regexp_matches(lower(split_part(email, '@', 1)), 'no[-_.]?reply') AS shared, nullif(regexp_extract(lower(email), '^(?:\d+\+)?([a-z0-9-]+)@users\.noreply\.', 1), '') AS login, array_to_string(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: length(x) >= 3), ' ') AS words FROM people",
    ),
    "tool_mailboxes": (lambda h: I.tools(frame(h, "people")), "WITH " + values("people") + " SELECT email FROM people WHERE regexp_matches(lower(email), '^(no-?reply|donotreply|do-not-reply)@') GROUP BY email HAVING count(DISTINCT name) >= 2 OR sum(trailers) >= 0.9 * sum(commits)"),
    "ambiguous_words": (lambda h: I.shared_words(frame(h, "people")), "WITH " + values("people") + ", t AS (SELECT DISTINCT name, list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: length(x) >= 3)) AS t FROM people), w AS (SELECT name, unnest(t) AS word FROM t WHERE len(t) >= 2) SELECT word, count(DISTINCT name) AS names FROM w GROUP BY word HAVING count(DISTINCT name) > 1"),
    "trailer_inventory": (
        lambda h: P.trailers(frame(h, "trailers").groupBy("hash").agg(F.collect_list(F.struct("key", F.lit("v").alias("value"))).alias("trailers"))),
        "WITH " + values("trailers") + ", t AS (SELECT hash, key, lower(key) AS low FROM trailers WHERE NOT regexp_matches(key, '^[A-Z][A-Z0-9]+-\\d+$')), s AS (SELECT low, key, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT low, key FROM s QUALIFY row_number() OVER (PARTITION BY low ORDER BY n DESC, key) = 1) SELECT b.key, count(DISTINCT hash) AS commits FROM t JOIN b USING (low) GROUP BY b.key",
    ),
    "signing_by_year": (
        lambda h: P.signing_by_year(frame(h, "signed")),
        "WITH " + values("signed") + " SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS commits, count(nullif(signature, '')) AS signed, count(nullif(signature, ''))*1e0/count(*) AS share FROM signed GROUP BY 1",
    ),
    "signing_by_kind": (
        lambda h: P.signing_by_kind(frame(h, "signed")),
        "WITH " + values("signed") + " SELECT CASE WHEN starts_with(signature, '-----BEGIN PGP') THEN 'gpg' WHEN starts_with(signature, '-----BEGIN SSH') THEN 'ssh' WHEN starts_with(signature, '-----BEGIN SIGNED MESSAGE') THEN 'x509' WHEN signature <> '' THEN 'other' ELSE 'none' END AS kind, count(*) AS commits FROM signed GROUP BY 1",
    ),
    "rename_lineage": (lambda h: G.lineage(frame(h, "renames")), "WITH RECURSIVE " + values("renames") + ", r AS (SELECT new AS name, old AS origin, 1 AS steps FROM renames UNION ALL SELECT name, old, steps + 1 FROM r JOIN renames ON new = origin) SELECT name, arg_max(origin, steps) AS origin, max(steps) AS steps FROM r GROUP BY name"),
    # secrets, packages
    "secret_groups": (
        lambda h: S.secret_groups(frame(h, "sightings")).withColumn("files", F.array_join("files", ",")),
        "WITH " + values("sightings") + " SELECT value, arg_min(rule, (file, commit, line)) AS rule, string_agg(DISTINCT file, ',' ORDER BY file) AS files, count(DISTINCT commit) AS commits, count(DISTINCT (file, line)) AS places, arg_max(confidence, list_position(['low', 'medium', 'high'], confidence)) AS confidence, bool_or(at_head) AS at_head, bool_and(test_code) AS test_only, bool_and(local) AS local_only FROM sightings GROUP BY value",
    ),
    "rule_secrets": (
        lambda h: told(U.secrets(S.secret_groups(frame(h, "sightings")))),
        "WITH " + values("sightings") + ", g AS (SELECT value, max(list_position(['low', 'medium', 'high'], confidence)) AS c, bool_or(at_head) AS at_head FROM sightings GROUP BY value HAVING NOT bool_and(test_code) AND NOT bool_and(local)) " + _findings("secrets_found", "CASE WHEN at_head AND c = 3 THEN 'critical' ELSE 'warning' END", "value", "g"),
    ),
    "secrets_sanitised": (
        lambda h: H.sanitised(frame(h, "found"), KEY),
        "WITH " + values("found") + f", p AS (SELECT *, {BAD_SHAPE} AS placeholder FROM found) SELECT rule, file, commit, line, substr(sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(secret)))), 1, 12) AS value, placeholder, CASE WHEN placeholder OR starts_with(rule, 'generic') AND regexp_full_match(secret, '[A-Za-z]+') THEN 'low' WHEN starts_with(rule, 'generic') THEN 'medium' ELSE 'high' END AS confidence FROM p",
    ),
    "vulnerable_packages": (lambda h: scanned(h).withColumn("ids", F.array_join("ids", ",")), f"WITH {PACKAGES} SELECT * FROM pk"),
    "rule_vulnerable": (lambda h: told(U.vulnerable(scanned(h))), f"WITH {PACKAGES} " + _findings("vulnerable_dependencies", "CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'warning' ELSE 'info' END", "name || '@' || version", "pk")),
    "package_urls": (
        lambda h: frame(h, "packages").select("name", S.package_url(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl")),
        "WITH " + values("packages") + ", k AS (SELECT *, CASE ecosystem WHEN 'PyPI' THEN 'pypi' WHEN 'npm' THEN 'npm' WHEN 'Go' THEN 'golang' WHEN 'crates.io' THEN 'cargo' WHEN 'Maven' THEN 'maven' ELSE 'generic' END AS kind, replace(replace(replace(name, '@', '%40'), ':', '/'), ' ', '%20') AS e FROM packages) SELECT name, 'pkg:' || kind || '/' || CASE WHEN kind = 'pypi' THEN replace(lower(e), '_', '-') ELSE e END || CASE WHEN version IS NULL THEN '' ELSE '@' || version END AS purl FROM k",
    ),
    # functions, texts
    "amalgamations": (
        lambda h: R.amalgamations(frame(h, "signatures")),
        "WITH " + values("signatures") + ", s AS (SELECT a.file, a.signature, b.file AS other FROM signatures a JOIN signatures b ON a.signature = b.signature AND a.file <> b.file), n AS (SELECT file, count(*) AS n FROM signatures GROUP BY file) SELECT file, count(DISTINCT signature) AS shared, count(DISTINCT other) AS sources FROM s JOIN n USING (file) GROUP BY file, n HAVING count(DISTINCT signature) >= 20 AND count(DISTINCT other) >= 2 AND count(DISTINCT signature) >= 0.9 * n",
    ),
    "spans_cross_checked": (
        lambda h: P.cross_checked(frame(h, "first_parser"), frame(h, "second_parser")),
        "WITH " + values("first_parser", "second_parser") + ", k AS (SELECT *, count(*) OVER (PARTITION BY file, start) AS k FROM first_parser), o AS (SELECT file, start, any_value(function) AS other, any_value(stop) AS s2 FROM second_parser GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT k.*, s2, coalesce(k = 1 AND other = function AND (stop - k.start + 1 > 2 * (s2 - k.start + 1) OR s2 - k.start + 1 > 2 * (stop - k.start + 1)), false) AS suspect FROM k LEFT JOIN o ON o.file = k.file AND o.start = k.start) SELECT file, function, start, CASE WHEN suspect THEN s2 ELSE stop END AS stop, suspect FROM b",
    ),
    "rule_brain_methods": (lambda h: told(U.brain_methods(frame(h, "functions"))), "WITH " + values("functions") + " " + _findings("brain_methods", "'warning'", "file || ':' || function", "functions WHERE ccn >= 15 AND nloc >= 100")),
    "rule_complexity_growth": (lambda h: U.complexity_growth(frame(h, "grown")).select("rule", "subject", F.get_json_object("evidence", "$.growers").alias("growers")), "WITH " + values("grown") + " SELECT 'complexity_growth' AS rule, 'hotspots' AS subject, CAST(count(*) AS VARCHAR) AS growers FROM grown WHERE after >= 1.25 * before HAVING count(*) >= 3"),
    "debt_markers": (lambda h: S.debt(frame(h, "texts"), "id", "text"), rf"WITH {values('texts')} SELECT * FROM (SELECT id, CAST(len(regexp_extract_all(text, '\b(TODO|FIXME|XXX|HACK)\b')) AS BIGINT) AS markers FROM texts) WHERE markers > 0"),
    "rule_debt": (lambda h: told(U.debt_in_hotspots(S.debt(frame(h, "texts"), "id", "text"))), rf"WITH {values('texts')}, d AS (SELECT len(regexp_extract_all(text, '\b(TODO|FIXME|XXX|HACK)\b')) AS n FROM texts) " + _findings("debt_in_hotspots", "'info'", "'hotspots'", "d WHERE n > 0 HAVING max(n) >= 3 OR count(*) >= 2")),
    "trojan_source": (
        lambda h: S.trojan_source(frame(h, "texts"), "id", "text"),
        rf"WITH {values('texts')}, {LINES} SELECT id, number, CASE WHEN regexp_matches(line, '[\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]') THEN 'bidi' ELSE 'mixed script' END AS kind FROM lines WHERE regexp_matches(line, '[\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]') OR regexp_matches(line, '[A-Za-z][\p{{L}}\p{{N}}_]*[\p{{Cyrillic}}\p{{Greek}}]|[\p{{Cyrillic}}\p{{Greek}}][\p{{L}}\p{{N}}_]*[A-Za-z]')",
    ),
    "commented_code": (
        lambda h: S.commented_code(frame(h, "texts"), "id", "text", share=0.7),
        rf"WITH {values('texts')}, {LINES}, c AS (SELECT id, number - row_number() OVER (PARTITION BY id ORDER BY number) AS block, {CODE} AS code FROM lines WHERE regexp_matches(line, '^\s*(#|//)')), b AS (SELECT id, block, count(*) AS n, count(*) FILTER (code) AS k FROM c GROUP BY 1, 2) SELECT id, CAST(sum(n) AS BIGINT) AS code_lines FROM b WHERE n >= 3 AND k >= 0.7 * n GROUP BY id",
    ),
    "rule_addresses": (lambda h: told(U.hardcoded_addresses(S.addresses(frame(h, "texts"), "id", "text"), "id")), f"WITH {values('texts')}, {PUBLIC} " + _findings("hardcoded_addresses", "'info'", "id || ':' || address", "pub")),
    "imports_of_files": (
        lambda h: S.imports_of(frame(h, "sources"), "path", "text"),
        rf"WITH {values('sources')} SELECT path, unnest(list_distinct(CASE WHEN path LIKE '%.py' THEN regexp_extract_all(text, '(?m)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)', 1) ELSE regexp_extract_all(text, '(?:require\(|from\s+|import\s+)[\x22'']([^\x22'']+)[\x22'']', 1) END)) AS module FROM sources",
    ),
    "unused_packages": (
        lambda h: S.unused_packages(L.npm_packages(frame(h, "npm")).select("name"), S.imports_of(frame(h, "sources"), "path", "text")),
        rf"WITH {values('npm', 'sources')}, d AS (SELECT unnest(list_concat(coalesce(json_keys(text::JSON->'dependencies'), []), coalesce(json_keys(text::JSON->'devDependencies'), []))) AS name FROM npm), m AS (SELECT unnest(CASE WHEN path LIKE '%.py' THEN regexp_extract_all(text, '(?m)^\s*(?:from|import)\s+([A-Za-z_][\w.]*)', 1) ELSE regexp_extract_all(text, '(?:require\(|from\s+|import\s+)[\x22'']([^\x22'']+)[\x22'']', 1) END) AS module FROM sources) SELECT name FROM d WHERE lower(replace(name, '_', '-')) NOT IN (SELECT lower(replace(regexp_extract(module, '^(@[^/]+/[^/]+|[^./]+)', 1), '_', '-')) FROM m)",
    ),
    # rules and graphs
    "rule_credential_files": (lambda h: told(U.credential_files(frame(h, "tree"))), "WITH " + values("tree") + r" " + _findings("credential_files", "'critical'", "path", r"tree WHERE regexp_matches(path, '(^|/)(\.env(\..+)?|id_rsa)$') AND NOT regexp_matches(path, '(^|/)\.env\.(.+\.)?(example|sample|template|dist)$')")),
    "rule_hidden_coupling": (
        lambda h: told(U.hidden_coupling(frame(h, "coupled"), frame(h, "edges"))),
        "WITH " + values("coupled", "edges") + " " + _findings("hidden_coupling", "'info'", "entity || ' <> ' || coupled", "coupled WHERE degree >= 60 AND average_revs >= 5 AND (entity, coupled) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM edges)"),
    ),
    "strong_components_of_files": (lambda h: G.strong_components(frame(h, "edges")), "WITH RECURSIVE " + values("edges") + f", {REACH} SELECT * FROM scc"),
    "rule_import_cycles": (lambda h: told(U.import_cycles(G.strong_components(frame(h, "edges")))), "WITH RECURSIVE " + values("edges") + f", {REACH} " + _findings("import_cycles", "'warning'", "root", "(SELECT DISTINCT root FROM scc)")),
    "rule_bus_factor": (
        lambda h: told(U.bus_factor(frame(h, "owned"))),
        "WITH " + values("owned") + ", p AS (SELECT person, sum(added) AS n FROM owned GROUP BY person) " + _findings("bus_factor", "'warning'", "person", "p WHERE n > 0.7 * (SELECT sum(n) FROM p) AND (SELECT sum(n) FROM p) >= 200"),
    ),
    "rule_import_commits": (lambda h: told(U.import_commits(frame(h, "bodies").where("hash < 'c'"))), "WITH " + values("bodies") + " " + _findings("import_commits", "'info'", "hash", "bodies WHERE hash < 'c'")),
    "findings_ordered": (
        lambda h: U.ordered(frame(h, "report")).select("rule", "subject", F.monotonically_increasing_id().alias("at")).withColumn("at", F.col("at") + 1).coalesce(1),
        "WITH " + values("report") + " SELECT rule, subject, row_number() OVER (ORDER BY list_position(['critical', 'warning', 'info'], severity), rule, subject) AS at FROM report",
    ),
    "gate_levels": (
        lambda h: U.tripped(frame(h, "report"), "critical").select(F.lit("all").alias("what"), "tripped").unionByName(U.tripped(frame(h, "report").where("severity = 'info'"), "warning").select(F.lit("info").alias("what"), "tripped")),
        "WITH " + values("report") + " SELECT 'all' AS what, bool_or(severity = 'critical') AS tripped FROM report UNION ALL SELECT 'info', coalesce(bool_or(severity IN ('critical', 'warning')), false) FROM report WHERE severity = 'info'",
    ),
    "reports_compared": (
        lambda h: U.compare(frame(h, "report"), frame(h, "later_report")),
        "WITH " + values("report", "later_report") + " SELECT coalesce(a.rule, b.rule) AS rule, coalesce(a.subject, b.subject) AS subject, CASE WHEN b.rule IS NULL THEN 'new' WHEN a.rule IS NULL THEN 'resolved' ELSE 'persisting' END AS change FROM later_report a FULL JOIN report b ON a.rule = b.rule AND a.subject = b.subject",
    ),
    "remediated_by_rename": (
        lambda h: P.remediation(frame(h, "report"), frame(h, "later_report"), frame(h, "present"), frame(h, "old_names")),
        "WITH " + values("report", "later_report", "present", "old_names") + ", m AS (SELECT rule, subject, new, coalesce(new, subject) AS now FROM report LEFT JOIN old_names ON old = subject) SELECT rule, subject, CASE WHEN (rule, now) IN (SELECT (rule, subject) FROM later_report) THEN CASE WHEN new IS NULL THEN 'open' ELSE 'moved' END WHEN now NOT IN (SELECT path FROM present) THEN 'gone' ELSE 'resolved' END AS outcome FROM m",
    ),
    "finding_ids": (
        lambda h: frame(h, "report").select("subject", P.finding_id(F.col("rule"), F.lit("repo"), F.lit("c"), F.col("subject")).alias("id")),
        "WITH " + values("report") + " SELECT subject, substr(sha256(encode(rule) || unhex('00') || encode('repo') || unhex('00') || encode('c') || unhex('00') || encode(subject)), 1, 16) AS id FROM report",
    ),
    # statistics
    "discoveries": (
        lambda h: M.benjamini_hochberg(frame(h, "pvalues"), "path", "p"),
        "WITH " + values("pvalues") + ", o AS (SELECT *, row_number() OVER (ORDER BY p, path) AS i, count(*) OVER () AS m FROM pvalues) SELECT path, p FROM o WHERE i <= (SELECT max(i) FROM o WHERE p <= 0.05e0*i/m)",
    ),
    "sign_flip": (
        lambda h: h.spark.createDataFrame([(M.sign_flip([r.effect for r in frame(h, "effects").collect()]),)], "p double"),
        "WITH " + values("effects") + ", e AS (SELECT effect, row_number() OVER (ORDER BY repo) - 1 AS i FROM effects), m AS (SELECT mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -effect ELSE effect END) AS total FROM e, range(32) t(mask) GROUP BY mask) SELECT count(*) FILTER (total >= (SELECT sum(effect) FROM e))/32e0 AS p FROM m",
    ),
    "sampling_dates": (
        lambda h: h.spark.createDataFrame([(d,) for d in O.sample_dates(day(2023, 1, 1), day(2023, 12, 31), 6)], "date date"),
        "SELECT CAST(DATE '2023-01-01' + CAST(364 * i // 5 AS INTEGER) AS DATE) AS date FROM range(6) t(i)",
    ),
    "cut_off_series": (
        lambda h: h.spark.createDataFrame([(d,) for d in O.cutoffs(day(2024, 5, 31), 4, 3)], "date date"),
        "SELECT CAST(DATE '2024-05-31' - to_months(CAST(3 * i AS INTEGER)) AS DATE) AS date FROM range(1, 5) t(i)",
    ),
}
