"""Operators on small fixtures that the driver's tables have no cases of."""

import datetime as dt
import json
import math
from itertools import product

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import exprs as X
from sedimenta.operators import coupling, graph, history, identity, metrics, ordered, ranking, rules, scan
from sedimenta.sources import changelog, exports
from sedimenta.streaming import incremental

LOG = """--a1--2024-01-03T10:00:00+02:00--Ada--fix(core): totals -- again (#12)\x1fBob B <bob@x.org>\x1fci-bot <ci@x.org>
3\t1\tsrc/{old => new}/a.py
-\t-\tlogo.png

--b2--2024-01-02T23:30:00+02:00--Bob B--Merge work
--c3--2024-01-01T03:10:00-05:00--Ada--PROJ-7 start, and add tests & docs
10\t0\tsrc/old/a.py
2\t2\t"src/caf\\303\\251.py"
5\t0\ttests/test_a.py
"""


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "log.txt"
    path.write_text(LOG)
    return changelog.read(spark, str(path))


def test_parse(log):
    rows = {r.hash: r for r in log.collect()}
    assert list(rows) and set(rows) == {"a1", "b2", "c3"}
    assert rows["a1"].subject == "fix(core): totals -- again (#12)"
    assert rows["a1"].co_authors == ["Bob B"] and rows["a1"].hour == 10
    assert rows["b2"].files == [] and rows["c3"].date == dt.date(2024, 1, 1)


def test_changes(log):
    rows = {(r.hash, r.path): r for r in changelog.changes(log).collect()}
    assert rows["a1", "src/new/a.py"].old_path == "src/old/a.py"
    assert rows["a1", "src/new/a.py"].renamed and (rows["a1", "src/new/a.py"].added, rows["a1", "logo.png"].added) == (3, 0)
    assert ("c3", "src/café.py") in rows


def test_subjects(spark):
    cases = {"fix(core): a (#12)": (True, "#12", 1), "PROJ-42 add x, y and more words": (False, "PROJ-42", 3), "closes #9": (False, "#9", 1), "Refactor (a, b)": (False, None, 1), "bugs on macOS and Linux": (True, None, 1)}
    df = spark.createDataFrame([(s,) for s in cases], "subject string")
    got = {r.subject: (r.f, r.t, r.c) for r in df.select("subject", X.is_fix("subject").alias("f"), X.ticket_key("subject").alias("t"), X.clauses("subject").alias("c")).collect()}
    assert got == cases


def test_whole_months(spark):
    pairs = [("2024-01-31", "2024-02-29", 0), ("2024-01-15", "2024-03-15", 2), ("2024-05-01", "2024-04-01", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, n int").select("n", X.whole_months(F.to_date("a"), F.to_date("b")).alias("m"))
    assert all(r.n == r.m for r in df.collect())


def test_defaults_of_wide_commits(spark):
    rows = [("wide", 1, f"f{i}", 10, 10) for i in range(25)] + [(f"c{k}", 1, f"f{k}", 3, 0) for k in range(40)]
    changes = spark.createDataFrame(rows, "hash string, pos long, path string, added long, deleted long")
    assert [r.hash for r in history.sweeps(changes).collect()] == ["wide"]
    big = spark.createDataFrame([("imp", 1, f"g{i}", 100, 0) for i in range(120)] + rows, "hash string, pos long, path string, added long, deleted long")
    assert [r.hash for r in history.imports(big).collect()] == ["imp"]


def test_plumbing_and_coupling_defaults(spark):
    rows = [(f"c{k}", k, dt.date(2024, 1, 1) + dt.timedelta(k), "Ada", "edit", p, 1, 1) for k in range(30) for p in ("version.py", "core.py")]
    changes = spark.createDataFrame(rows, "hash string, pos long, date date, author string, subject string, path string, added long, deleted long")
    assert {r.path for r in history.plumbing(changes).collect()} == {"version.py", "core.py"}
    sets = coupling.changesets(changes)
    (pair,) = coupling.coupling(sets).collect()
    assert (pair.entity, pair.coupled, pair.degree, pair.shared) == ("core.py", "version.py", 100, 30)
    assert {(r.entity, r.confidence) for r in coupling.companions(sets).collect()} == {("core.py", 100), ("version.py", 100)}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("x", "y"), ("y", "x")], "src string, dst string")
    strong = {r.node: r.root for r in graph.strong_components(edges).collect()}
    assert strong == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r.node: r.length for r in graph.shortest_loops(edges).collect()} == {"a": 3, "b": 3, "c": 3, "e": 1, "x": 2, "y": 2}
    roots = {r.node: r.root for r in graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()}
    assert roots["d"] == "a" and roots["y"] == "x" and roots["e"] == "e"
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    assert {r.root for r in graph.components(chain).collect()} == {0}
    assert {r.node: (r.direct, r["all"]) for r in graph.dependents(edges).collect()}["d"] == (1, 3)
    names = graph.lineage(spark.createDataFrame([("a", "b"), ("b", "c")], "old string, new string")).collect()
    assert {(r.name, r.origin) for r in names} == {("b", "a"), ("c", "a")}


def test_truck_factor(spark):
    owners = spark.createDataFrame([("p1", "ada"), ("p2", "ada"), ("p3", "ada"), ("p3", "bob"), ("p4", "bob")], "path string, person string")
    steps = graph.truck_factor(owners).collect()
    assert [s.person for s in steps] == ["ada", "bob"] and steps[-1].orphaned == 1.0


def test_tails_and_tests(spark):
    df = spark.createDataFrame([(3, 10, 0.2), (0, 5, 0.5), (5, 5, 0.5)], "k long, n long, p double")
    got = [r.t for r in df.select(metrics.binomial_tail("k", "n", "p").alias("t")).collect()]
    want = [sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)) for k, n, p in ((3, 10, 0.2), (0, 5, 0.5), (5, 5, 0.5))]
    assert got == pytest.approx(want)
    draw = spark.createDataFrame([(20, 5, 4, 2)], "a long, b long, c long, d long").select(metrics.hypergeometric_tail("a", "b", "c", "d").alias("t")).first().t
    assert draw == pytest.approx(sum(math.comb(5, i) * math.comb(15, 4 - i) for i in range(2, 5)) / math.comb(20, 4))
    for effects in ([1, 2, -1, 0.5], [-1, -2, -1], [0, 1, 1], [0.5]):
        brute = sum(sum(s * e for s, e in zip(signs, effects, strict=True)) >= sum(effects) for signs in product((1, -1), repeat=len(effects))) / 2 ** len(effects)
        assert metrics.sign_flip(effects) == brute
    assert metrics.sign_flip([]) is None and metrics.sign_flip([-1, -2, -1]) == 1.0 and metrics.sign_flip([0, None]) == 1.0
    low, high = metrics.bootstrap({"b": [1.0, None], "a": [2.0], "c": [3.0], "d": [None]}, lambda x: sum(x) / len(x), rounds=200)
    assert 1 <= low <= high <= 3
    assert metrics.bootstrap({"a": [None]}, sum) is None


def test_rankings_by_ranges(spark):
    rows = [(i % 3, (i * 7919) % 500, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, v int, i int")
    got = {r.i: r.place for r in metrics.ranked(df, F.desc("v"), F.asc("i")).collect()}
    assert got == {i: k + 1 for k, (_, _, i) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    got = {r.i: r.place for r in metrics.ranked(df, F.desc("v"), F.asc("i"), by=("g",)).collect()}
    for g in range(3):
        assert [got[i] for _, _, i in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))] == list(range(1, sum(r[0] == g for r in rows) + 1))
    assert metrics.ranked(df.limit(0), F.asc("v")).count() == 0


def test_strong_components_of_random_graphs(spark):
    import random

    draw = random.Random(5)
    for n, m in ((30, 40), (40, 60), (12, 40)):
        pairs = sorted({(draw.randrange(n), draw.randrange(n)) for _ in range(m)})
        reach = {i: {i} for i in range(n)}
        for _ in range(n):
            for a, b in pairs:
                reach[a] |= reach[b]
        want = {}
        for i in range(n):
            same = [j for j in range(n) if j in reach[i] and i in reach[j]]
            if len(same) > 1:
                want[i] = min(same)
        edges = spark.createDataFrame(pairs, "src int, dst int")
        assert {r.node: r.root for r in graph.strong_components(edges).collect()} == want


def test_long_loops_take_few_rounds(spark, monkeypatch):
    rounds, write = [], graph._staged
    monkeypatch.setattr(graph, "_staged", lambda df: rounds.append(1) or write(df))
    n = 100
    loop, tail, out = [(i, (i + 1) % n) for i in range(n)], [(-i, -i + 1) for i in range(1, n)], [(5, 500), (500, 501)]
    edges = spark.createDataFrame(loop + tail, "src int, dst int")
    assert {r.node: r.root for r in graph.strong_components(edges).collect()} == dict.fromkeys(range(n), 0)
    assert {r.node: r.length for r in graph.shortest_loops(edges).collect()} == dict.fromkeys(range(n), n)
    assert len(rounds) < 60
    # a loop with a way out is no forced walk from its start, but one from its end
    assert {r.node for r in graph.strong_components(spark.createDataFrame(loop + out, "src int, dst int")).collect()} == set(range(n))


def test_shortest_loops_of_random_graphs(spark):
    import random

    draw = random.Random(9)
    for n, m in ((25, 45), (12, 30)):
        pairs = sorted({(draw.randrange(n), draw.randrange(n)) for _ in range(m)} | {(100 + i, 100 + (i + 1) % 12) for i in range(12)} | {(103, 100)})
        want = {}
        for start in {a for a, _ in pairs}:
            near, length, met = {start}, 0, set()
            while near and start not in met:
                near = {b for a, b in pairs if a in near} - met
                met, length = met | near, length + 1
            if start in met:
                want[start] = length
        edges = spark.createDataFrame(pairs, "src int, dst int")
        assert {r.node: r.length for r in graph.shortest_loops(edges).collect()} == want


def test_moved_lines(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("p", "x", "+", day(1), 1), ("p", "x", "+", day(2), 2), ("p", "x", "-", day(5), 3), ("p", "x", "-", day(30), 4), ("p", "y", "+", day(1), 1)]
    df = spark.createDataFrame(rows, "path string, text string, kind string, date date, pos long")
    (r,) = ordered.moved_lines(df).collect()
    assert (r.added, r.churned) == (3, 1)


def test_moved_lines_as_one_queue(spark):
    import random

    draw = random.Random(9)
    rows = [("p", draw.choice("xy"), draw.choice("++-"), dt.date(2024, 1, 1) + dt.timedelta(k // 3), k // 2) for k in range(300)]
    want = [0, 0]
    for text in "xy":
        queue = []
        for _, _, kind, date, _ in sorted((r for r in rows if r[1] == text), key=lambda r: (r[3], r[4], r[2])):
            if kind == "+":
                want[0] += 1
                queue.append(date)
                continue
            queue = [d for d in queue if (date - d).days <= 14]
            if queue:
                queue.pop(0)
                want[1] += 1
    (r,) = ordered.moved_lines(spark.createDataFrame(rows, "path string, text string, kind string, date date, pos long")).collect()
    assert [r.added, r.churned] == want and want[1] > 30


def test_dates():
    assert ordered.sample_dates(dt.date(2024, 1, 1), dt.date(2024, 3, 1), 12) == [dt.date(2024, 1, 1), dt.date(2024, 1, 31), dt.date(2024, 3, 1)]
    assert ordered.cutoffs(dt.date(2024, 5, 31), 2, 1) == [dt.date(2024, 3, 31), dt.date(2024, 4, 30)]


def test_identity(spark):
    people = [("Ada Byron", "ada@x.org", 5), ("Byron, Ada", "ab@y.org", 2), ("adabyron", "12+adabyron@users.noreply.host", 1), ("Bob", "no-reply@z.org", 3), ("Eve", "no-reply@z.org", 3)]
    got = {(r.name, r.email): r.head_name for r in identity.merge(spark.createDataFrame(people, "name string, email string, commits long")).collect()}
    assert got["Byron, Ada", "ab@y.org"] == got["adabyron", "12+adabyron@users.noreply.host"] == "Ada Byron"
    assert got["Bob", "no-reply@z.org"] == "Bob" and got["Eve", "no-reply@z.org"] == "Eve"


def test_scanners(spark):
    text = "see 10.20.30.40 and 127.0.0.1, 192.0.2.9\n# TODO later\n# x = 1\n# y = f(x)\n# return y\nsafe‮ line\npаypal ok"
    docs = spark.createDataFrame([("d", text)], "id string, text string")
    assert [r.address for r in scan.addresses(docs, "id", "text").collect()] == ["10.20.30.40"]
    assert scan.debt(docs, "id", "text").first().markers == 1
    assert {(r.number, r.kind) for r in scan.trojan_source(docs, "id", "text").collect()} == {(6, "bidi"), (7, "mixed script")}
    assert scan.commented_code(docs, "id", "text", share=0.7).first().code_lines == 4
    flows = spark.createDataFrame([("w.yml", "steps:\n - uses: a/b@v1\n - uses: 'c/d@" + "0" * 40 + "'\n")], "id string, text string")
    assert {(r.uses[:3], r.pinned) for r in scan.action_pins(flows, "id", "text").collect()} == {("a/b", False), ("c/d", True)}
    locks = scan.lock_drift(spark.createDataFrame([("a/b/package.json", 9), ("c/package.json", 1)], "path string, time long"), spark.createDataFrame([("a/package-lock.json", 5), ("package-lock.json", 3)], "path string, time long"))
    assert {(r.manifest, r.lock, r.drifted) for r in locks.collect()} == {("a/b/package.json", "a/package-lock.json", True), ("c/package.json", "package-lock.json", False)}


def test_secrets_and_packages(spark):
    rows = [("v1", "key", "a.py", "c1", 1, "low", True, False, False), ("v1", "key", "b.py", "c2", 2, "high", False, True, False), ("v2", "key", "t.py", "c1", 1, "medium", True, True, False)]
    groups = scan.secret_groups(spark.createDataFrame(rows, "value string, rule string, file string, commit string, line long, confidence string, at_head boolean, test_code boolean, local boolean"))
    told = {r.subject: r.severity for r in rules.secrets(groups).collect()}
    assert told == {"v1": "critical"}
    nested = {"results": [{"source": "lock", "packages": [{"name": "p", "version": "1.9.0", "ecosystem": "npm", "vulnerabilities": [{"id": "A", "score": 9.1, "fixed": ["1.10.0", "1.8"]}, {"id": "B", "score": 3.0, "fixed": ["2.0"]}]}]}]}
    schema = "results array<struct<source string, packages array<struct<name string, version string, ecosystem string, vulnerabilities array<struct<id string, score double, fixed array<string>>>>>>>"
    packages = scan.vulnerable_packages(spark.createDataFrame([(json.dumps(nested),)], "j string").select(F.from_json("j", schema).alias("x")).select("x.results"))
    r = packages.first()
    assert (r.advisories, r.score, r.fixed, r.ids) == (2, 9.1, "1.10.0", ["A", "B"])
    assert rules.vulnerable(packages).first().severity == "critical"


def test_manifests(spark):
    files = spark.createDataFrame([("package.json", '{"dependencies": {"left-pad": "1"}, "devDependencies": {"jest": "2"}}')], "path string, text string")
    assert {(r.name, r.scope) for r in changelog.npm_packages(files).collect()} == {("left-pad", "dependencies"), ("jest", "devDependencies")}
    go = spark.createDataFrame([("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\n")], "path string, text string")
    assert [r.name for r in changelog.go_modules(go).collect()] == ["github.com/a/b"]
    cargo = spark.createDataFrame([("Cargo.toml", '[package]\nname = "x"\nlicense = "MIT"\n[dependencies]\nserde = "1"\n[dev-dependencies]\ny = "1"\n')], "path string, text string")
    assert [r.name for r in changelog.cargo_packages(cargo).collect()] == ["serde"]
    assert cargo.select(changelog.toml_value(F.col("text"), "package", "license").alias("l")).first().l == "MIT"


def test_rules_and_exports(spark):
    found = spark.createDataFrame([("info", "b", "x", '{"n": [1, 2]}'), ("critical", "a", "src/y", "{}")], rules.SCHEMA)
    assert [f["severity"] for f in exports.digest(found)] == ["critical", "info"] and exports.digest(found)[1]["n_count"] == 2
    assert exports.report_json(found) == exports.report_json(found)
    log = exports.sarif(found, spark.createDataFrame([("src/y",)], "path string"))
    (result,) = log["runs"][0]["results"]
    assert result["level"] == "error" and result["partialFingerprints"]["primary/v1"] == exports.fingerprint("a", "src/y")
    bom = exports.sbom(spark.createDataFrame([("PyPI", "A_b", "1.0"), ("npm", "@s/p", "2"), ("npm", "@s/p", "2")], "ecosystem string, name string, version string"), "c")
    assert [c["purl"] for c in bom["components"]] == ["pkg:npm/%40s/p@2", "pkg:pypi/a-b@1.0"]
    assert rules.tripped(found, "critical").first().tripped and not rules.tripped(found.where("severity = 'info'"), "warning").first().tripped


def test_sections_of_a_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1200, 0.5, True), ("c", 7, None, False), ("d" * 200, 1, 2.0, None)], "path string, n long, share double, solo boolean")
    part = exports.section("Hotspots", df, F.desc("n"), k=2)
    assert part["total"] == 3 and [r[0] for r in part["rows"]] == ["a|b", "c"]
    none = exports.section("None", df.limit(0))
    text = exports.markdown([part, none])
    assert text.splitlines()[0] == "## Hotspots (2 of 3)" and "| a\\|b | 1,200 | 0.5 | yes |" in text and "| c | 7 | - | no |" in text and "None" not in text
    wide = exports.terminal([exports.section("All", df, F.asc("n"), k=None), none], width=60)
    assert wide.splitlines()[0] == "All" and max(map(len, wide.splitlines())) <= 60
    exports.write_sections({"hot": (df, F.desc("n"))}, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "hot")).count() == 3
    assert exports.manifest(spark, {"b": 1, "a": 2}) == exports.manifest(spark, {"a": 2, "b": 1})


def test_ranking_of_empty_tables(spark):
    none = spark.createDataFrame([], "hash string, pos long, date date, author string, subject string, path string, added long, deleted long")
    assert history.sweeps(none).count() == history.oversized(none).count() == 0
    assert ranking.hotspots(history.revisions(none), spark.createDataFrame([], "path string, code long, complexity long")).count() == 0
    assert coupling.coupling(coupling.changesets(none)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tmp_path / "in"
    batch.orderBy("ts").coalesce(1).write.parquet(str(folder))
    stream = incremental.read_events(spark, str(folder))
    static = batch.withColumn("ts", F.col("ts").cast("timestamp"))

    def run(df, mode):
        query = df.writeStream.format("memory").queryName("held").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{mode}{id(df)}")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table("held")

    for make in (incremental.monthly, incremental.trailing, incremental.quiet_sessions):
        key = ["w.start", "event_type"] if make is not incremental.quiet_sessions else ["w.start", "user_id"]
        n = "n" if make is not incremental.quiet_sessions else "events"
        got = {tuple(r) for r in run(make(stream), "complete" if make is not incremental.quiet_sessions else "append").select(*key, n).collect()}
        want = {tuple(r) for r in make(static).select(*key, n).collect()}
        assert got == want if make is not incremental.quiet_sessions else got <= want and got
    again = run(incremental.retouched(stream, days=2), "append").groupBy("again").count().collect()
    assert {r.again for r in again} <= {True, False} and sum(r["count"] for r in again) > 0


def test_the_pools_patterns_stay_with_the_pool(spark):
    from sedimenta.plans.report_queries import watch
    from sedimenta.sources.views import History

    h = History(spark, "/root/testdata/sf0.001").held()
    assert h.held() is h
    asked = X.TEST_PATH[:20]
    assert asked not in watch(h)._jdf.queryExecution().optimizedPlan().toString()


def test_parts_asked_first(spark):
    paths = ["a/tests/b.py", "TEST_x.py", "a_spec.rb", "x.t.sol", "tb_a.v", "a_tb.sv", "UserSpec.kt", "e2e/a", "smoke/a", "__fixtures__/a", "a.snap", "my-tests/a", "ATests/b"]
    df = spark.createDataFrame([(p, True) for p in paths] + [("src/a.py", False), ("contest.py", False), (None, None)], "path string, want boolean")
    assert all(r.got == r.want for r in df.select("want", X.is_test_path("path").alias("got")).collect())
    said = [("Fix: a", True), ("a CRASH", True), ("bugs", True), ("prefixed", False), (None, None)]
    assert all(r.got == r.want for r in spark.createDataFrame(said, "subject string, want boolean").select("want", X.is_fix("subject").alias("got")).collect())


def test_change_factors_of_a_path_cut_in_parts(spark):
    step = 1 << 19  # two changes a part of a long path
    rows = [(f"c{i}", i * step, dt.date(2024, 1, 1) + dt.timedelta(days=i), "abc"[i % 3 if i > 3 else 0], "fix: x" if i % 2 else "add", path, i, 1) for i in range(8) for path in ("a/long.py", f"b/{i % 2}.py")]
    changes = spark.createDataFrame(rows, "hash string, pos long, date date, author string, subject string, path string, added long, deleted long")
    plain, cut = (sorted(ranking.change_factors(changes, heavy=n).collect()) for n in (100, 5))
    past, want = [], []
    for i in range(8):
        mine = [r for r in rows if r[0] == f"c{i}"]
        before = [[r for r in past if r[5] == m[5]] for m in mine]
        want.append((f"c{i}", max(len({r[3] for r in p}) for p in before), sum(map(len, before)), len({r[0] for r in past if r[3] == mine[0][3]})))
        past += mine
    assert plain == cut and [(r.hash, r.ndev, r.nuc, r.exp) for r in plain] == want
