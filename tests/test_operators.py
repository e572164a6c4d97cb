"""Small graphs and cases with known answers, and random graphs against a plain search."""

import collections
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from depgrove.functions import names as N
from depgrove.functions import versions as V
from depgrove.operators import diff, graph, joins, query, reports, resolver
from depgrove.operators.parts import Parts
from depgrove.sources import sinks
from depgrove.streaming import changes

C = F.col


def made(spark, edges):
    ids = list(dict.fromkeys(x for e in edges for x in e))
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "vid long, id string")
    return nodes, spark.createDataFrame([(ids.index(a), ids.index(b), 1) for a, b in edges], "src long, dst long, rel int")


def test_impact_of_a_small_graph(spark):
    nodes, edges = made(spark, [("mill", "gear"), ("gear", "iron"), ("mill", "iron"), ("cart", "gear"), ("iron", "ore")])
    rows = sorted((r.distance, r.package, r.chain) for r in graph.impact(nodes, edges, "ore").collect())
    assert rows == [(1, "iron", "iron>ore"), (2, "gear", "gear>iron>ore"), (2, "mill", "mill>iron>ore"), (3, "cart", "cart>gear>iron>ore")]
    s = graph.impact_summary(nodes, edges, "iron", 2).first()
    assert (s.affected, s.rendered, s.truncated, s.direct_dependents, s.direct_dependencies) == (3, 2, 1, 2, 1)


def test_deep_chain_and_targets(spark):
    """More levels than are held apart, and searches that end at their targets."""
    nodes, edges = graph.synthetic(spark, 90, 2)
    found = {r.package: r.distance for r in graph.reachable(nodes, edges, "pkg-0==1", "dependencies").collect()}
    assert found == {f"pkg-{i}==1": (i + 1) // 2 for i in range(1, 90)}
    asked = spark.createDataFrame([(1, "dependencies", "pkg-0==1", "pkg-7==1", "path"), (2, "dependencies", "pkg-3==1", "pkg-80==1", "path"), (3, "dependents", "pkg-4==1", "pkg-9==1", "path"), (4, "dependents", "pkg-4==1", None, "nodes")], "qid long, direction string, node string, target string, kind string")
    assert {r.qid: r.result_count for r in graph.batch(nodes, edges, asked).collect()} == {1: 5, 2: 40, 3: 0, 4: 4}
    with pytest.raises(Exception, match="target of a path"):
        query.batch_report(nodes, edges, asked.withColumn("target", F.lit(""))).collect()
    with pytest.raises(ValueError):
        query.specs(spark, ["dependency-path:a"])


def test_affected(spark):
    rng = random.Random(9)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(40)})
    nodes = spark.range(30).select(C("id").alias("vid"), F.concat(F.lit("n"), "id").alias("id"))
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs if a != b], "src long, dst long, rel int")
    into = {}
    for a, b in pairs:
        if a != b:
            into.setdefault(b, []).append(a)
    for given in ((3, 7, 11, 12), (5,)):
        want = set()
        for s in given:
            seen, stack = {s}, [s]
            while stack:
                for x in into.get(stack.pop(), []):
                    if x not in seen:
                        seen.add(x)
                        stack.append(x)
            want |= seen - {s}
        ids = spark.createDataFrame([(f"n{g}",) for g in given], "id string")
        assert {r.package for r in graph.affected(nodes, edges, ids).collect()} == {f"n{x}" for x in want}


def test_canonical(spark):
    nodes = spark.createDataFrame([("g", "b==1", "b", "1", "npm", {"k": "1", "l": "1"}, 0), ("g", "a==1", "a", "1", "npm", None, 1), ("g", "b==1", "b", "1", "npm", {"k": "2"}, 2), ("h", "a==1", "a", "1", "rpm", {}, 0)], "graph string, id string, name string, version string, ecosystem string, meta map<string,string>, seq long")
    edges = spark.createDataFrame([("g", "b==1", "a==1", 1), ("g", "b==1", "a==1", 3), ("g", "a==1", "c==2", 1), ("h", "a==1", "a==1", 1)], "graph string, src string, dst string, rel int")
    n, e = graph.canonical(nodes, edges)
    rows = n.orderBy("vid").collect()
    assert [(r.graph, r.id, r.version, r.ecosystem, r.meta) for r in rows] == [("g", "b==1", "1", "npm", {"k": "2", "l": "1"}), ("g", "a==1", "1", "npm", {}), ("g", "c==2", "2", "generic", {}), ("h", "a==1", "1", "rpm", {})]
    of = {r.vid: r.id for r in rows}
    assert sorted((r.graph, of[r.src], of[r.dst], r.rel) for r in e.collect()) == [("g", "a==1", "c==2", 1), ("g", "b==1", "a==1", 3), ("h", "a==1", "a==1", 1)]


def test_transaction_counts(spark):
    from depgrove.operators import transactions

    nodes, edges = made(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("d", "c")])
    matches = spark.createDataFrame([("t", 1, "install", "package", "b", "x", "b", "exact"), ("t", 2, "upgrade", "old", "d", "x", None, "none"), ("t", 2, "upgrade", "new", "d", "x", "d", "name-arch")], "graph string, idx int, action string, role string, name string, arch string, node string, how string")
    counts = transactions.dependents_of(nodes, edges, matches)
    assert sorted(tuple(r) for r in counts.collect()) == [("b", 2, 4), ("d", 0, 0)]
    actions = spark.createDataFrame([("t", 1, "install"), ("t", 2, "upgrade"), ("t", 3, "erase")], "graph string, idx int, action string")
    rows = transactions.ordered(transactions.impact(actions, matches, counts)).collect()
    assert [(r.idx, r.status, r.roles, r.direct, r.affected) for r in rows] == [(1, "exact", "package", 2, 4), (2, "candidate", "new", 0, 0), (3, "unmatched", "", 0, 0)]


def test_selectors(spark):
    nodes = spark.createDataFrame([("a==1", "a", {"purl": "p1"}), ("a==2", "a", {"purl": "p2"}), ("b==1", "b", {"purl": "p3", "name": "bee"}), ("c==1", "c", {"purl": "p3"})], "id string, name string, meta map<string,string>")
    assert [joins.select_node(nodes, t) for t in ("a==1", "p2", "b", "bee")] == ["a==1", "a==2", "b==1", "bee"]
    assert joins.select_package(nodes, "bee") == "b==1"
    for pick in (lambda: joins.select_node(nodes, "a"), lambda: joins.select_node(nodes, "p3"), lambda: joins.select_package(nodes, "p3"), lambda: joins.select_snapshot_node(nodes, "a"), lambda: joins.select_snapshot_node(nodes, "z"), lambda: joins.side_selectors("a", "b", None), lambda: joins.side_selectors(None, "b", " ")):
        with pytest.raises(ValueError):
            pick()
    assert joins.side_selectors(None, "x", "y") == ("x", "y") and joins.side_selectors(" x ", None, None) == ("x", "x")


def test_paths_and_unknown_ids(spark):
    nodes, edges = made(spark, [("app", "lib"), ("lib", "base")])
    assert [tuple(r) for r in graph.shortest_path(nodes, edges, "app", "base").collect()] == [("app>lib>base", 2)]
    assert [tuple(r) for r in graph.shortest_path(nodes, edges, "app", "app").collect()] == [("app", 0)]
    assert graph.shortest_path(nodes, edges, "base", "app").count() == 0
    assert graph.neighbours(nodes, edges, "none", "dependents").count() == 0
    with pytest.raises(ValueError):
        graph.turned(edges, "sideways")


def test_random_graphs(spark):
    rng = random.Random(4)
    for _ in range(2):
        n = 14
        pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(30)})
        nodes = spark.range(n).select(C("id").alias("vid"), F.concat(F.lit("n"), "id").alias("id"))
        edges = spark.createDataFrame([(a, b, 1) for a, b in pairs if a != b], "src long, dst long, rel int")
        out = {}
        for a, b in pairs:
            if a != b:
                out.setdefault(a, []).append(b)
        paths, queue = {0: [0]}, deque([0])
        while queue:
            x = queue.popleft()
            for y in sorted(out.get(x, [])):
                if y not in paths:
                    paths[y] = paths[x] + [y]
                    queue.append(y)
        found = graph.levels(edges, graph.starts_at(nodes, "n0"), "dependencies", paths=True).collect()
        assert {r.vid: list(r.path) for r in found} == paths


def test_merges(spark):
    rows = spark.createDataFrame([("a", 1, {"x": "1", "y": "1"}), ("a", 2, {"x": "2"}), ("b", 3, None)], "id string, seq long, meta map<string,string>")
    assert {r.id: (r.seq, r.meta) for r in graph.merged_nodes(rows).collect()} == {"a": (1, {"x": "2", "y": "1"}), "b": (3, {})}


def test_version_orders(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    lit = F.lit
    assert value(V.parts_key(lit("1.0.0")) < V.parts_key(lit("1.0.0-rc1")))
    assert value(V.advisory_key(lit("1.a")) < V.advisory_key(lit("1.1"))) and value(V.diff_key(lit("1.1")) < V.diff_key(lit("1.a")))
    assert value(V.in_range(lit("1.9"), lit("0"), lit("2.0"))) and not value(V.in_range(lit("2.0"), lit("0"), lit("2.0")))
    assert not value(V.in_range(lit("1"), lit(None).cast("string"), lit(None).cast("string")))
    for rule, version, want in (("^1.2", "1.9.0", True), ("^1.2", "2.0.0", False), ("~1.2", "1.3.0", False), (">=1,<2", "1.5", True), ("1.0.0 || 3.0.0", "3.0.0", True), ("*", "9", True), ("", "9", True)):
        assert value(V.allows(lit(rule), lit(version))) is want, (rule, version)
    assert value(V.allows(lit("1.0 || !x"), lit("1.0"))) and value(V.allows(lit("what"), lit("1"))) is False
    with pytest.raises(Exception, match="unsupported version constraint"):
        value(V.allows(lit("!=1.1"), lit("1.0")))
    assert value(V.parts_key(lit("1.0.0+b")) == V.parts_key(lit("1.0.0"))) and value(V.change_kind(lit("1.0-RC1"), lit("1.0-rc1"))) == "replacement"
    assert value(V.in_range(lit("1:1.0"), lit("2.0"), lit("2:0"), epochs=lit(True))) and not value(V.in_range(lit("1.0-1"), lit(None), lit("0:1.0-1"), epochs=lit(True)))
    assert value(V.precise(F.array(lit("1"), lit("1-2")), F.array(lit("0:1"), lit(None)))) == ["1-2"]


def test_names(spark):
    row = spark.range(1).select(
        N.purl(F.lit("npm"), F.lit("@s/a b"), F.lit("1")).alias("npm"), N.rpm_file(F.lit("a-b-1.0-2.el9.x86_64.rpm")).alias("rpm"), N.rpm_file(F.lit("build.log")).alias("log"),
        N.nevra(F.lit("a-b-3:1.0-2.el9.x86_64")).alias("nevra"), N.seconds(F.lit("1:00:02.5")).alias("seconds"), N.severity_rank(F.lit("9.8")).alias("rank"),
    ).first()
    assert row.npm == "pkg:npm/%40s/a%20b@1" and tuple(row.rpm) == ("a-b", "1.0", "2.el9", "x86_64") and tuple(row.log) == ("build.log", "", "", "unknown")
    assert tuple(row.nevra) == ("a-b", "3", "1.0", "2.el9", "x86_64") and row.seconds == 3602.5 and row["rank"] == 4


def test_diff_of_small_snapshots(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, name string, version string, license string, ecosystem string")
    left = frame([("app==1", "app", "1", "MIT", "npm"), ("lib==1", "lib", "1", None, "npm")])
    right = frame([("app==1", "app", "1", "ISC", "npm"), ("lib==2", "lib", "2", None, "npm"), ("core==1", "core", "1", None, "npm")])
    found = diff.classified(left, right)
    assert sorted((r.kind, r.name) for r in found.collect()) == [("added", "core"), ("metadataChange", "app"), ("upgrade", "lib")]
    assert diff.verdict(found, ("added",)).first().exit_code == 2 and diff.verdict(found, ("removed",)).first().status == "pass"


def test_self_provided_requirement_stays_unresolved(spark):
    wants = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "rpmlib(z)")], "pkg string, cap string")
    gives = spark.createDataFrame([("a", "x"), ("b", "y")], "pkg string, cap string")
    assert sorted((r.cap, r.provider) for r in joins.providers(wants, gives).collect()) == [("x", None), ("y", "b")]


def test_licenses(spark):
    rows = reports.license_rows(spark.createDataFrame([("a", "MIT"), ("b", "GPL-3.0 OR mit"), ("c", " ")], "id string, license string"), ("mit",))
    s = reports.license_summary(rows).first()
    assert (s.packages, s.licensed, s.missing, s.denied) == (3, 2, 1, 2)


def registry(spark):
    d = {"app": {"1.0.0": {"addon": ">=1.0.0,<3.0.0", "lib": ">=1.0.0,<3.0.0"}}, "addon": {"2.0.0": {"core": ">=3.0.0,<4.0.0"}, "1.0.0": {"core": ">=1.0.0,<2.0.0"}},
         "lib": {"2.0.0": {"core": ">=2.0.0,<3.0.0"}, "1.0.0": {"core": ">=1.0.0,<2.0.0"}}, "core": {"3.1.0": {}, "2.5.0": {}, "1.5.0": {}}, "bad": {"1.0.0": {"core": ">=9"}}}
    return spark.createDataFrame([(n, v, x) for n, vs in d.items() for v, x in vs.items()], "name string, version string, dependencies map<string,string>")


def test_resolver(spark):
    rows = registry(spark)
    found = resolver.resolve(rows, spark.createDataFrame([("app",), ("bad",), ("core",)], "root string"))
    by = {}
    for r in found.collect():
        by.setdefault(r.root, []).append((r.name, r.version))
    assert by == {"app": [("addon", "1.0.0"), ("app", "1.0.0"), ("core", "1.5.0"), ("lib", "1.0.0")], "bad": [(None, None)], "core": [("core", "3.1.0")]}
    assert resolver.resolved_edges(found.where("root = 'app'"), rows).count() == 4
    assert tuple(resolver.clause_counts(rows).first()) == (1 + 1 + 3, 7)


def test_conflicts_are_learned():
    """A conflict that has nothing to do with forty other choices: going back one by one takes 2**40 steps."""
    many = {f"a{i:02}": ["2", "1"] for i in range(40)}
    rank = {"r": ["1"], "q": ["1"], "z": ["2", "1"], "w": ["3", "2", "1"]} | many
    every = frozenset("21")
    wants = {("r", "1"): {n: every for n in many} | {"q": frozenset("1"), "z": every}, ("q", "1"): {"w": frozenset("3")}, ("z", "1"): {"w": frozenset("1")}, ("z", "2"): {"w": frozenset("2")}}
    search = resolver._Search("r", rank, wants)
    assert search.solve() is None and search.steps < 60
    wants["z", "1"] = {"w": frozenset("13"), "a39": frozenset("1")}  # only with an older choice of one of the forty
    search = resolver._Search("r", rank, wants)
    assert search.solve() == {n: "2" for n in many} | {"r": "1", "q": "1", "z": "1", "w": "3", "a39": "1"} and search.steps < 120


def test_what_is_left_of_a_registry(spark):
    """Versions without a choice go, then those that need them."""
    d = {"a": {"1": {"b": "*"}, "2": {"b": "2"}}, "b": {"1": {}, "2": {"c": "*"}}, "c": {"1": {"none": "*"}}}
    rows = spark.createDataFrame([(n, v, x) for n, vs in d.items() for v, x in vs.items()], "name string, version string, dependencies map<string,string>")
    left = resolver.possible(rows, resolver.clauses(rows))
    assert {tuple(r) for r in left.collect()} == {("a", "1"), ("b", "1")}
    found = resolver.resolve(rows, spark.createDataFrame([("a",), ("c",), ("unknown",)], "root string"))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", "a", "1"), ("a", "b", "1"), ("c", None, None), ("unknown", None, None)]))


def test_resolver_against_all_choices(spark):
    """Random registries: a root is resolved just if some choice of versions holds, and what is chosen holds."""
    import itertools

    rng = random.Random(12)
    rows, worlds = [], {}
    for w in range(14):
        names = [f"w{w}{c}" for c in "abcd"]
        world = {n: {f"{v}.0.0": {m: rng.choice(["*", "1.0.0", ">=2.0.0", "<2.0.0", "^2.0.0"]) for m in names if m > n and rng.random() < 0.6} for v in (1, 2, 3)} for n in names}
        worlds[names[0]] = world
        rows += [(n, v, d) for n, vs in world.items() for v, d in vs.items()]
    holds = {"*": "123", "1.0.0": "1", ">=2.0.0": "23", "<2.0.0": "1", "^2.0.0": "2"}
    registry_ = spark.createDataFrame(rows, "name string, version string, dependencies map<string,string>")
    found = {}
    for r in resolver.resolve(registry_, spark.createDataFrame([(n,) for n in worlds], "root string")).collect():
        found.setdefault(r.root, {})[r.name] = r.version
    for root, world in worlds.items():
        fits = lambda pick: all(m in pick and pick[m][0] in holds[c] for n in pick for m, c in world[n][pick[n]].items())
        any_ = any(fits(dict(zip(names, vs))) for k in range(4) for names in map(lambda x: (root, *x), itertools.combinations(sorted(world)[1:], k)) for vs in itertools.product(("1.0.0", "2.0.0", "3.0.0"), repeat=k + 1))
        if any_:
            assert root in found[root] and fits(found[root])
        else:
            assert found[root] == {None: None}


def test_written_graphs(spark, tmp_path):
    nodes, edges = made(spark, [("a", "b"), ("b", "c")])
    sinks.write_graph(nodes, edges, str(tmp_path), 2)
    back = sinks.read_graph(spark, str(tmp_path))
    assert sorted(r.id for r in back[0].collect()) == ["a", "b", "c"] and back[1].edges.count() == 2
    assert {r.package: r.distance for r in graph.reachable(*back, "c", "dependents").collect()} == {"b": 1, "a": 2}
    assert "Bucketed: true" in back[1].towards("dependents")._jdf.queryExecution().executedPlan().toString().replace("Bucketed: false (disabled by query planner)", "Bucketed: true")
    nodes.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/nodes")
    with pytest.raises(ValueError):
        sinks.read_graph(spark, str(tmp_path))
    assert sinks.summary_line(nodes, edges, "a").first().line == "root=a nodes=3 edges=2"
    assert sinks.sbom_components(spark.createDataFrame([("a==1", {"k": "v", "ecosystem": "npm", "license": "MIT"})], "id string, meta map<string,string>")).first().component == '{"type":"library","bom-ref":"a==1","name":"a","version":"1","purl":"pkg:npm/a@1","licenses":[{"license":{"name":"MIT"}}],"properties":[{"name":"depgrove:ecosystem","value":"npm"},{"name":"depgrove:k","value":"v"}]}'


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:01:00", "view", 1), (1, "2024-01-01 00:01:00", "view", 1), (2, "2024-01-01 00:02:00", "view", 1), (3, "2024-01-01 09:00:00", "click", 2)], "event_id long, ts string, event_type string, user_id long")
    rows.withColumn("ts", C("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, event_type string, user_id long"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = changes.change_counts(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.event_type, r.n) for r in spark.table("counted").collect()] == [("view", 2)]
    assert changes.sessions(spark.read.parquet(str(tmp_path / "in"))).count() == 2


def test_deep_trees_and_steps(spark):
    from depgrove.operators import joins, npm

    lines = spark.createDataFrame([("t", i, i, f"n{i}") for i in range(20)] + [("t", 20, 14, "m"), ("t", 21, 15, "o")], "tree string, line long, depth long, id string")
    parents = {r.id: r.parent for r in joins.tree_parents(lines).collect()}
    assert parents == {"n0": None, **{f"n{i}": f"n{i - 1}" for i in range(1, 20)}, "m": "n13", "o": "m"}
    text = '{"delta": "0:00:07"}'
    for i in range(7):
        text = f'{{"s{i}": {text}}}'
    found = npm.flat_steps(spark.createDataFrame([(1, text)], "key long, json string")).collect()
    assert [(r.step, r.seconds) for r in found] == [("s6.s5.s4.s3.s2.s1.s0", 7.0)]


def searched(pairs, start):
    out, best, queue = {}, {start: 0}, deque([start])
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    while queue:
        x = queue.popleft()
        for y in sorted(out.get(x, [])):
            if y not in best:
                best[y] = best[x] + 1
                queue.append(y)
    return best


def numbered_graph(spark, n, pairs):
    nodes = spark.range(n).select(C("id").alias("vid"), F.concat(F.lit("n"), "id").alias("id"))
    return nodes, spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, rel int")


def test_levels_leave_edges_and_seen_where_they_are(spark):
    """A level shuffles its frontier only: neither the edges nor what was seen stands under an exchange."""
    from depgrove.operators import searches

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        nodes, edges = numbered_graph(spark, 50, [(i, i + 1) for i in range(49)])
        written = searches.Edges(edges)
        seen = searches.Seen("vid", ["m0"], written.n, None)
        level = searches.bucketed(spark.createDataFrame([(0, 1)], "vid long, m0 long"), "vid", "level", written.n)
        seen.add(level)
        step = level.by_key.join(written.towards("dependencies"), C("vid") == C("src")).groupBy(C("dst").alias("vid")).agg(F.bit_or("m0").alias("m0"))
        plan = seen.beside(step)[0]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_queries_in_bits(spark):
    rng = random.Random(12)
    pairs = sorted({(rng.randrange(90), rng.randrange(90)) for _ in range(330)})
    nodes, edges = numbered_graph(spark, 90, pairs)
    starts = spark.createDataFrame([(1000 + i, i % 90) for i in range(1100)], "qid long, vid long")  # more than go together
    from depgrove.operators import searches

    want = {v: searched(pairs, v) for v in range(90)}
    back = {v: int(any(b == v and a in want[v] for a, b in pairs)) for v in range(90)}
    got = {r.qid: (r.reached, r.direct, r.back) for r in searches.reach_counts(edges, starts, "dependencies", cycles=True).collect()}
    assert got == {1000 + i: (len(want[i % 90]) - 1, sum(d == 1 for d in want[i % 90].values()), back[i % 90]) for i in range(1100)}
    some = starts.where("qid < 1090")
    found = collections.Counter((r.qid, r.vid, r.distance) for r in searches.distances(edges, some, "dependencies").collect())
    assert found == collections.Counter((1000 + i, v, d) for i in range(90) for v, d in want[i].items())
    ends = some.select("qid", ((C("vid") * 7 + 3) % 90).alias("vid"))
    lengths = {r.qid: r.distance for r in searches.target_distances(edges, some, ends, "dependencies").collect()}
    assert lengths == {1000 + i: want[i][(i * 7 + 3) % 90] for i in range(90) if (i * 7 + 3) % 90 in want[i]}
    assert searches.reach_counts(edges, starts.limit(0), "dependencies").count() == 0


def test_deep_graphs_by_parts(spark):
    nodes, edges = graph.synthetic(spark, 1000, 3)
    parts = Parts(edges, "dependencies", part_bits=8)
    found = {r.package: r.distance for r in graph.deep_reachable(nodes, parts, "pkg-0==1", "dependencies").collect()}
    assert found == {f"pkg-{i}==1": -(-i // 3) for i in range(1, 1000)}
    path = graph.deep_path(nodes, edges, "pkg-0==1", "pkg-999==1", part_bits=8).first()
    assert path.distance == 333 and path.path.split(">") == [f"pkg-{i}==1" for i in range(0, 1000, 3)]
    rng = random.Random(3)
    pairs = sorted({(a, (a + rng.choice([1, 1, 2, -5, 40])) % 150) for a in range(150) for _ in range(2)})
    nodes, edges = numbered_graph(spark, 150, pairs)
    starts = spark.createDataFrame([(q, q * 3 % 150) for q in range(66)], "qid long, vid long")
    for most in (10**6, 60):  # also with parts that are too heavy to be packed
        some = starts if most > 60 else starts.limit(3)
        got = {(r.qid, r.vid): r.distance for r in Parts(edges, "dependencies", 6, most).distances(some).collect()}
        assert got == {(r.qid, v): d for r in some.collect() for v, d in searched(pairs, r.vid).items()}
    for a, b in ((0, 149), (5, 5)):
        assert [tuple(r) for r in graph.deep_path(nodes, edges, f"n{a}", f"n{b}", part_bits=6).collect()] == [tuple(r) for r in graph.shortest_path(nodes, edges, f"n{a}", f"n{b}").collect()]
    assert graph.deep_path(nodes, edges, "n1", "none").count() == 0


def test_interval_join(spark):
    """All ends, ties and groups against every pair; and a hot group whose product would not fit."""
    from depgrove.operators import intervals as I

    rng = random.Random(6)
    points = [(g, rng.randrange(12), f"{g}{i}") for g in "abc" for i in range(25)]
    tests = {"at_least": (I.at_least, lambda p, k: p >= k), "above": (I.above, lambda p, k: p > k), "at_most": (I.at_most, lambda p, k: p <= k), "below": (I.below, lambda p, k: p < k)}
    ranges = [(i, rng.choice("abcd"), [(rng.choice(list(tests)), rng.randrange(-1, 13)) for _ in range(rng.randrange(4))]) for i in range(120)]
    want = collections.Counter((r, item) for r, g, ends in ranges for h, p, item in points if g == h and all(tests[t][1](p, k) for t, k in ends))
    shape = "range long, `group` string, ends array<struct<test:string,k:int>>"
    ends = F.transform("ends", lambda e: F.when(e["test"] == "at_least", I.at_least(e["k"])).when(e["test"] == "above", I.above(e["k"])).when(e["test"] == "at_most", I.at_most(e["k"])).otherwise(I.below(e["k"])))
    found = I.matches(spark.createDataFrame(points, "`group` string, key int, item string"), spark.createDataFrame(ranges, shape).select("range", "group", ends.alias("bounds")))
    assert collections.Counter((r.range, r.item) for r in found.collect()) == want
    n = 10_000
    hot = spark.range(n).select(F.lit("x").alias("group"), C("id").alias("key"), C("id").alias("item"))
    narrow = spark.range(n).select(C("id").alias("range"), F.lit("x").alias("group"), F.array(I.at_least(C("id")), I.below(C("id") + 2)).alias("bounds"))
    assert I.matches(hot, narrow).count() == 2 * n - 1


def test_constraints_held(spark):
    constraints = ["*", "", None, "latest", "1.0.0", "=1.2.3", "^1.2", "^0.3.1", "^0.0.2", "~1.2.0", ">=1.0,<2.0", ">1.2.3 <=2.0.0-rc1", "<1.0.0 || >=2.0.0", "^1 || ^2 || 0.3.1", "1.2.3 || what ever?"]
    known = ["0.0.2", "0.3.1", "0.3.9", "1.0.0", "1.2.3", "1.2.9", "1.9.0", "2.0.0-rc1", "2.0.0", "3.1.4"]
    wants = spark.createDataFrame([("p", c) for c in constraints[:-1]], "dependency string, constraint string")
    versions = spark.createDataFrame([("p", v) for v in known], "name string, version string")
    every = wants.join(versions, C("dependency") == C("name")).where(V.allows(C("constraint"), C("version")))
    same = lambda df, c: sorted(str((r.constraint, r[c])) for r in df.collect())
    assert same(resolver.held(wants, versions), "choice") == same(every, "version")
    odd = spark.createDataFrame([("p", constraints[-1])], "dependency string, constraint string")
    assert [r.choice for r in resolver.held(odd, versions.where("version = '1.2.3'")).collect()] == ["1.2.3"]
    with pytest.raises(Exception, match="unsupported version constraint"):
        resolver.held(odd, versions).collect()


def test_contracts(spark):
    from depgrove.operators import contracts

    schema = {
        "type": "object", "required": ["a"], "additionalProperties": {"type": "integer"},
        "properties": {"a": {"$ref": "#/$defs/x"}, "b": {"enum": ["one", 2, None]}, "c": {"oneOf": [{"type": "number"}, {"minimum": 5}]}, "d": {"allOf": [{"minLength": 2}, {"maxLength": 3}], "not": {"const": "bad"}}, "e": {"type": "array", "maxItems": 2, "items": {"type": ["string", "boolean"]}}},
        "$defs": {"x": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["k"], "properties": {"k": {"pattern": "^v"}}}}},
    }
    cases = {
        '{"a": [{"k": "v1"}], "b": 2, "c": 3, "d": "ok", "e": ["s", true], "more": 7}': set(), "[1]": {("$", "not of type object")}, "nothing": {("$", "no JSON")}, "{}": {("$.a", "required")}, '{"a": []}': {("$.a", "minItems")},
        '{"a": [{"k": "w"}, {}, 3]}': {("$.a[0].k", "pattern"), ("$.a[1].k", "required"), ("$.a[2]", "not of type object")}, '{"a": [{"k": 1}], "b": "two", "more": "x", "extra": 1.5}': {("$.b", "enum differs"), ("$.more", "not of type integer"), ("$.extra", "not of type integer")},
        '{"a": [{"k": "v"}], "c": 6, "d": "bad", "e": [null, "a", "b"]}': {("$.c", "oneOf"), ("$.d", "not"), ("$.e", "maxItems"), ("$.e[0]", "not of type string or boolean")}, '{"a": [{"k": "v"}], "d": "long", "b": null}': {("$.d", "maxLength")},
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, json string")
    found = {}
    for r in contracts.checked(rows, schema).collect():
        found.setdefault(r.n, set()).add((r.path, r.reason))
    assert {text: found.get(n, set()) for n, text in enumerate(cases)} == cases
    with pytest.raises(ValueError):
        contracts.faults({"$ref": "#/a", "a": {"items": {"$ref": "#/a"}}}, C("json"))


def test_triage_of_mixed_reports(spark):
    from depgrove.operators import triage

    texts = [
        None, "no json", "[1]", "{}", '{"schema":"x.advisory.report.v1"}',
        '{"schema":"x.graph.diff.v1","summary":{"policyFailures":4},"policy":{"status":"fail","matchedKinds":["a"]}}',
        '{"schema":"x.graph.diff.v1","stats":{"policyFailures":4}}',
        '{"schema":"x.bundle.catalog.v1","summary":{"performanceReports":2,"performanceMaxNodes":9,"triageWarn":1},"bundles":[{"ok":"true","path":"p"},{"ok":true},5]}',
        '{"schema":"x.performance.report.v1","summary":{"maxNodes":4,"allContiguous":true}}',
        '{"schema":"x.npm.diagnostics.v1","root":"r","summary":{"unresolvedDependencies":3}}',
    ]
    reports = triage.parsed(spark.createDataFrame(list(enumerate(texts)), "ord long, text string"))
    found = {r.counter: r.value for r in triage.rollup(reports).collect()}
    assert (found["reports"], found["failedChecks"], found["graphDiffReports"], found["graphDiffPolicyFailures"]) == (10, 1, 2, 5)
    assert (found["performanceReports"], found["performanceMaxNodes"], found["performanceContiguousReports"], found["nodes"]) == (3, 9, 1, 0)
    assert "realDataCoverageReports" not in found and found["parallelQueryReports"] == 0
    checks = {r.ord: (r.check, r.status) for r in triage.checks(reports).collect()}
    assert checks == {4: ("advisory", "pass"), 5: ("graph-diff-policy", "fail"), 7: ("bundle-catalog", "warn")}
    catalog = triage.checks(reports).where("ord = 7").first().detail
    assert '"performanceMaxNodes":9' in catalog and "parallelQueryReports" not in catalog
    findings = [(r.category, r.place) for r in triage.findings(reports).orderBy("category").collect()]
    assert findings == [("bundleCatalog", 1), ("graphDiffPolicies", 1), ("npm", 1)]
    none = triage.rollup(reports.limit(0)).collect()
    assert len(none) == 29 and not any(r.value for r in none) and triage.checks(reports.limit(0)).count() == 0
