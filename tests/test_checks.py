"""Checks of files, commits' provenance and what became of findings, on fixtures."""

import datetime as dt
import hmac

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import hygiene as H
from sedimenta.operators import provenance as P


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_generated_and_interpreters(spark):
    rows = [("a.py", "# Code generated by tool\nx"), ("b.min.js", "x"), ("c.py", "#!/usr/bin/env -S FOO=1 python3.12\n"), ("d", "#!/bin/sh -e\n"), ("e.py", "\n" * 8 + "# do not edit"), ("f.py", "# maintained, not auto-generated\n")]
    df = spark.createDataFrame(rows, "path string, text string").select("path", H.says_generated("text", "path").alias("g"), H.interpreter("text").alias("i"))
    got = {r.path: (r.g, r.i) for r in df.collect()}
    assert got == {"a.py": (True, None), "b.min.js": (True, None), "c.py": (False, "python"), "d": (False, "sh"), "e.py": (False, None), "f.py": (False, None)}


def test_file_kinds(spark):
    every = paths(spark, "src/a.py", "tests/test_a.py", "docs/x.md", "vendor/v.c", "gen/g.py", "old.py")
    kinds = H.file_kinds(every, paths(spark, "lib/z.c"), paths(spark, "gen/g.py"), every.where("path <> 'old.py'"))
    assert {r.path: r.reason for r in kinds.collect()} == {"src/a.py": None, "tests/test_a.py": "test", "docs/x.md": "doc", "vendor/v.c": "vendored", "gen/g.py": "generated", "old.py": "gone"}
    sizes = spark.createDataFrame([("src/a.py", 10), ("gen/g.py", 5)], "path string, code long")
    assert {(r.reason, r.files, r.lines) for r in H.coverage(kinds, sizes).collect()} >= {("ranked", 1, 10), ("generated", 1, 5)}
    assert {r.type: r.files for r in H.type_census(paths(spark, "a.py", "b/c.PY", "Makefile", "x/.env")).collect()} == {"py": 2, "Makefile": 1, ".env": 1}


def test_trees(spark):
    tree = paths(spark, "README.md", "LICENSE", "a/package.json", "go.mod", "go.sum", "b/Cargo.toml", "CLAUDE.md")
    assert {r.policy for r in H.presence(tree).collect() if r.present} == {"readme", "licence"}
    assert {r.manifest for r in H.missing_locks(tree).collect()} == {"a/package.json", "b/Cargo.toml"}
    assert {r.ecosystem for r in H.missing_updates(tree, spark.createDataFrame([("npm",)], "ecosystem string")).collect()} == {"gomod", "cargo"}
    lines = spark.createDataFrame([("# note",), ("*.go @x",), ("/a/ @y",), ("b/**/Cargo.toml @z",), ("go.* @w",)], "line string")
    assert {r.pattern: r.matched for r in H.owner_patterns(lines, tree).collect()} == {"*.go": 0, "/a/": 1, "b/**/Cargo.toml": 1, "go.*": 2}
    assert [r.path for r in H.agent_files(tree).collect()] == ["CLAUDE.md"]


def test_contents(spark):
    files = spark.createDataFrame([("x", bytearray(b"\x7fELF...")), ("y", bytearray(b"text"))], "path string, content binary")
    assert [(r.path, r.kind) for r in H.binaries(files).collect()] == [("x", "ELF")]
    mods = spark.createDataFrame([('[submodule "a"]\n path = a\n url = http://h/a\n[submodule "b"]\n url = https://u:p@h/b\n[submodule "c"]\n url = https://h/c\n',)], "text string")
    assert {(r.name, r.problem) for r in H.submodules(mods).collect()} == {("a", "plain transport"), ("b", "credentials"), ("c", None)}
    links = spark.createDataFrame([("a/b", "../c"), ("a/d", "../../e"), ("f", "/etc/x")], "path string, target string")
    assert {(r.path, r.outside) for r in H.symlinks(links).collect()} == {("a/b", False), ("a/d", True), ("f", True)}
    packages = spark.createDataFrame([("package.json", '{"scripts": {"postinstall": "x", "test": "y"}}')], "path string, text string")
    assert [(r.script, r.command) for r in H.install_scripts(packages).collect()] == [("postinstall", "x")]
    flows = spark.createDataFrame([("p.yml", "on: pull_request_target\n - uses: actions/checkout@v4\n   with:\n    ref: ${{ github.event.pull_request.head.sha }}\n"), ("i.yml", " - run: echo ${{ github.event.issue.title }}\n"), ("ok.yml", " - run: echo hi\n")], "path string, text string")
    assert {(r.path, r.risk) for r in H.workflow_risks(flows).collect()} == {("p.yml", "pwn request"), ("i.yml", "injection")}
    agents = spark.createDataFrame([(".x/settings.local.json", '{"enableAllProjectMcpServers": true, "mcpServers": {"a": {"env": {"K": "0123456789abcdef"}}, "b": {"env": {"K": "$KEY"}}}}')], "path string, text string")
    assert {r.risk for r in H.agent_risks(agents).collect()} == {"agent_approval_disabled", "agent_local_settings", "mcp_literal_env"}


@pytest.mark.parametrize(("text", "want"), [("MIT", "permissive"), ("MIT OR GPL-3.0-only", "permissive"), ("MIT AND GPL-3.0-or-later", "strong copyleft"), ("GPL-2.0 WITH Classpath-exception-2.0", "weak copyleft"), ("(MIT OR LGPL-3.0) AND MPL-2.0", "weak copyleft"), ("SSPL-1.0", "strong copyleft"), ("CDDL-1.1", "weak copyleft"), ("Mine-1.0", None), ("Mine-1.0 OR GPL-2.0", None), ("Mine-1.0 AND GPL-2.0", "strong copyleft"), ("MIT/X11", "permissive"), ("", None), (None, None)])
def test_licence_strength(text, want):
    assert H.strength(text) == want


def test_secrets_are_sanitised(spark):
    values = {"xxxxxxxx": True, "changeme": True, "${KEY}": True, "abcdefgh": True, "aaaaaaaa": True, "q8Zr" + "T1mK9sLp": False}
    df = spark.createDataFrame([("generic-key", "f", "c", 1, v) for v in values], "rule string, file string, commit string, line long, secret string")
    rows = H.sanitised(df, b"salt" * 20).collect()
    assert {r.value for r in rows} == {hmac.new(b"salt" * 20, v.encode(), "sha256").hexdigest()[:12] for v in values}
    assert sum(r.placeholder for r in rows) == 5 and {r.confidence for r in rows} == {"low", "medium"} and all(len(r.value) == 12 for r in rows)
    facts = spark.createDataFrame([(True, False, None)], "a boolean, b boolean, c boolean")
    assert {r.control: r.result for r in H.control_coverage(facts).collect()} == {"a": "met", "b": "gap", "c": "unknown"}
    assert {(r.strength, r.packages) for r in H.copyleft(spark.createDataFrame([("p", "MIT"), ("q", "GPL-3.0")], "name string, licence string")).collect()} == {("permissive", 1), ("strong copyleft", 1)}


def test_provenance(spark):
    commits = spark.createDataFrame([("a", [("Signed-off-by", "x"), ("PROJ-1", "y")]), ("b", [("signed-off-by", "x")]), ("c", [("Signed-off-by", "z")])], "hash string, trailers array<struct<key string, value string>>")
    assert [(r.key, r.commits) for r in P.trailers(commits).collect()] == [("Signed-off-by", 3)]
    d = lambda n: dt.date(2024, 1, n)
    heads = spark.createDataFrame([("a", 1, d(1), "fix: x"), ("b", 2, d(5), "feat: y"), ("c", 3, d(28), "more")], "hash string, pos long, date date, subject string")
    changes = spark.createDataFrame([("a", 1, d(1), "p"), ("b", 2, d(5), "p"), ("c", 3, d(28), "p")], "hash string, pos long, date date, path string")
    got = {r.marked: r for r in P.cohorts(heads, changes, heads.where("hash = 'a'"), heads.where("hash = 'b'")).collect()}
    assert (got[True].commits, got[True].fixes, got[True].again) == (1, 1, 1) and (got[False].reverted, got[False].again) == (1, 0)
    signed = spark.createDataFrame([(d(1), "-----BEGIN PGP SIGNATURE"), (d(2), "-----BEGIN SSH SIGNATURE"), (d(3), None)], "date date, signature string")
    assert P.signing_by_year(signed).first().signed == 2 and {r.kind for r in P.signing_by_kind(signed).collect()} == {"gpg", "ssh", "none"}
    times = spark.createDataFrame([("ada", dt.datetime(2024, 1, 1, 10, i), i, "feat: x") for i in range(6)] + [("bob", dt.datetime(2024, 1, 1, 12, 0), 9, "y")], "author string, ts timestamp, pos long, subject string")
    r = P.commit_shape(times).first()
    assert (r.commits, round(r.burst_share, 3), r.hours) == (7, 0.857, 2)
    assert not P.convention(times).first().typed_history
    labels = spark.createDataFrame([("a", None), ("bb", "p")], "hash string, path string")
    whole = spark.createDataFrame([("aaaa", d(2), 1), ("bbbb", d(3), 2)], "hash string, date date, pos long")
    touched = spark.createDataFrame([("aaaa", "q"), ("bbbb", "p"), ("bbbb", "r")], "hash string, path string")
    assert {r.path for r in P.labelled(whole, touched, labels, "2024-01-01", "2024-02-01").collect()} == {"q", "p"}


def test_cross_check_and_outcomes(spark):
    functions = spark.createDataFrame([("f", "a", 1, 100), ("f", "b", 200, 210), ("f", "c", 300, 305), ("f", "c2", 300, 306)], "file string, function string, start long, stop long")
    other = spark.createDataFrame([("f", "a", 1, 10), ("f", "b", 200, 212), ("f", "c", 300, 350)], "file string, function string, start long, stop long")
    got = {r.function: (r.stop, r.suspect) for r in P.cross_checked(functions, other).collect()}
    assert got == {"a": (10, True), "b": (210, False), "c": (305, False), "c2": (306, False)}
    before = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), ("r", "d")], "rule string, subject string")
    after = spark.createDataFrame([("r", "a"), ("r", "new")], "rule string, subject string")
    renames = spark.createDataFrame([("d", "new")], "old string, new string")
    out = P.remediation(before, after, paths(spark, "a", "b", "new"), renames)
    assert {r.subject: r.outcome for r in out.collect()} == {"a": "open", "b": "resolved", "c": "gone", "d": "moved"}
    assert P.pooled(out).first().resolved == 1
    tops = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "b"), (3, "c")], "cut int, path string")
    assert {r.cut: round(r.overlap, 3) for r in P.carry_over(tops).collect()} == {2: 0.333, 3: 1.0}
    ranked = spark.createDataFrame([("a", 1), ("b", 20)], "path string, place int")
    assert {(r.path, r.place) for r in P.misses(ranked, paths(spark, "a", "b", "z")).collect()} == {("b", 20), ("z", None)}
    lines = spark.createDataFrame([(2020, ["x", "y"]), (2020, ["x"])], "year int, people array<string>")
    assert {(r.person, r.lines) for r in P.blame_shares(lines).collect()} == {("x", 1.5), ("y", 0.5)}
    assert len(before.select(P.finding_id(F.col("rule"), F.lit("repo"), F.lit("c"), F.col("subject")).alias("i")).first().i) == 16
