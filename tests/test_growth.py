"""Plans and tables whose size must not outgrow the input."""

from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_package_of_a_transaction_is_parsed_once(spark):
    from depgrove.functions.names import transaction_package

    texts = ["a-b-2:1-3.noarch.rpm", "a-1-2.x86_64", "plain", "a-:1-2.src", "x.y", "", None, " a-1-.noarch "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(transaction_package(F.col("t")).alias("p"))
    assert _plan(df).count("regexp_extract(") == 3
    found = [tuple(r.p)[:6] if r.p else None for r in df.collect()]
    assert found == [
        ("a-b", "2", "1", "3", "noarch", "a-b==1-3.noarch"), ("a", "0", "1", "2", "x86_64", "a==1-2.x86_64"), ("plain", "0", "", "", "unknown", "plain"),
        ("a", "0", "1", "2", "src", "a==1-2.src"), ("x.y", "0", "", "", "y", "x.y"), None, None, ("a", "0", "1", "", "noarch", "a==1.noarch"),
    ]


def test_rounds_of_a_deep_search_do_not_follow_its_cuts(spark, monkeypatch):
    from depgrove.operators import graph, parts

    calls, counted = [], parts.counted_buckets
    monkeypatch.setattr(parts, "counted_buckets", lambda *a, **k: (calls.append(1), counted(*a, **k))[1])
    nodes, edges = graph.synthetic(spark, 120, 3)
    found = {r.package: r.distance for r in graph.deep_reachable(nodes, edges, "pkg-0==1", "dependencies", part_bits=3).collect()}
    assert found == {f"pkg-{i}==1": -(-i // 3) for i in range(1, 120)}
    assert len(calls) < 16  # 15 parts, of which each is entered from the one before
    cut = parts.Parts(edges, "dependencies", 3, 150)
    assert cut.coarser(1) is cut  # no part becomes more than a task holds


def test_all_runs_of_queries_go_in_one_search(spark, monkeypatch):
    from depgrove.operators import searches

    calls, levels = [], searches.mask_levels
    monkeypatch.setattr(searches, "COLUMNS", 1)
    monkeypatch.setattr(searches, "mask_levels", lambda *a, **k: (calls.append(1), levels(*a, **k))[1])
    edges = spark.range(150).select(F.col("id").alias("src"), ((F.floor(F.col("id") / 4) * 4 + (F.col("id") + 1) % 4)).alias("dst"), F.lit(1).alias("rel")).where("src < 100")
    starts = spark.range(150).select(F.col("id").alias("qid"), F.col("id").alias("vid"))
    found = sorted(tuple(r) for r in searches.reach_counts(edges, starts, "dependencies", cycles=True).select("qid", "reached", "direct", "back").collect())
    assert found == [(q, 3, 1, 1) if q < 100 else (q, 0, 0, 0) for q in range(150)]
    assert len(calls) == 1


def test_edges_are_merged_in_as_many_tasks_as_they_need(spark):
    from depgrove.operators import graph

    edges = spark.createDataFrame([(1, 2, 1, 1), (1, 2, 3, 3), (2, 1, 2, 2)], "src long, dst long, rel int, seq int")
    merged = graph.merged_edges(edges, 9 * graph.MERGED_ROWS)
    assert "RepartitionByExpression [src#" in _plan(merged) and _plan(merged).splitlines()[1].strip().endswith(", 9")
    assert sorted(map(tuple, merged.collect())) == [(1, 2, 3), (2, 1, 2)]


def test_a_contract_parses_a_text_once(spark):
    from depgrove.operators import contracts

    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0, "maximum": 9}, "b": {"items": {"type": "string", "minLength": 2}}}}
    df = spark.createDataFrame([(1, '{"a": 10, "b": ["x", 1]}'), (2, "{}"), (3, "{")], "k int, json string")
    found = contracts.checked(df, schema)
    plan = _plan(found)
    assert plan.count("parseJson") == 1 and plan.count("Repartition") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "$.a", "maximum"), (1, "$.b[0]", "minLength"), (1, "$.b[1]", "not of type string"), (2, "$.a", "required"), (3, "$", "no JSON")]


def test_unresolved_requirements_meet_no_list_of_providers(spark):
    from depgrove.operators import joins

    requires = spark.createDataFrame([(p, c) for p in range(4) for c in ("none", "own", "many", "rpmlib(x)")], "pkg int, cap string")
    provides = spark.createDataFrame([(1, "own"), (1, "own")] + [(p, "many") for p in range(3)], "pkg int, cap string")
    found = joins.unresolved(requires, provides)
    assert sorted(map(tuple, found.collect())) == [(0, "none"), (1, "none"), (1, "own"), (2, "none"), (3, "none")]
    assert sorted(map(tuple, found.collect())) == sorted((r.pkg, r.cap) for r in joins.providers(requires, provides).where("provider IS NULL").collect())
    join = next(line for line in _plan(found).splitlines() if "Join LeftOuter" in line)
    assert "pkg#" not in join and "Aggregate [" in _plan(found)


def test_lock_files_are_read_by_lines_and_hold_what_is_asked_for(monkeypatch):
    import tracemalloc

    from depgrove.sources import lockfiles

    monkeypatch.setattr(lockfiles, "BLOCK_LINES", 1)
    texts = {
        "poetry-lock": ['[[package]]\nname = "p{0}"\nversion = "1"\ndescription = """\n[[package]]\n"""\n[package.dependencies]\np{1} = ">=1"\n', ""],
        "cargo-lock": ['[[package]]\nname = "p{0}"\nversion = "1"\ndependencies = ["p{1}"]\n', ""],
        "yarn-lock": ['"p{0}@^1", "p{0}@~1":\n  version "1"\n  dependencies:\n    p{1} "^1"\n', ""],
        "pnpm-lock": ["  p{0}@1:\n    resolution: {{integrity: sha}}\n    dependencies:\n      p{1}: '1'\n", "packages:\n"],
        "pyproject": ['p{0} = "^1"\n', "[tool.poetry.dependencies]\n"],
    }
    n = 2000
    for form, (entry, head) in texts.items():
        lines = (head + "".join(entry.format(i, i + 1) for i in range(n))).splitlines(keepends=True)
        parse = lockfiles.PARSERS[form]
        every = list(parse(iter(lines), "f", None).rows())
        for kind in ("node", "edge"):
            assert list(parse(iter(lines), "f", kind).rows()) == [r for r in every if r[1] == kind]
        assert sum(r[1] == "edge" for r in every) == n and sum(r[1] == "node" for r in every) == n + 1
        tracemalloc.start()
        lock = parse(iter(lines), "f", "edge")
        assert lock.packages and tracemalloc.get_traced_memory()[1] < 1000 * n, form
        tracemalloc.stop()


def test_a_search_has_the_buckets_that_its_edges_fill(spark):
    from depgrove.operators import graph, searches

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        nodes, edges = graph.synthetic(spark, 60, 2)
        held = searches.Edges.of(edges)
        assert held.n == spark.sparkContext.defaultParallelism < 40
        assert {r.package: r.distance for r in graph.reachable(nodes, held, "pkg-0==1", "dependencies").collect()} == {f"pkg-{i}==1": (i + 1) // 2 for i in range(1, 60)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_both_kinds_of_queries_go_in_one_search_and_send_nothing_seen(spark, monkeypatch):
    from depgrove.operators import graph, searches

    calls, levels, beside, plans = [], searches.mask_levels, searches.Seen.beside, []
    monkeypatch.setattr(searches, "mask_levels", lambda *a, **k: (calls.append(1), levels(*a, **k))[1])
    monkeypatch.setattr(searches.Seen, "beside", lambda self, rows: (lambda out: (plans.append(out[0]._jdf.queryExecution().executedPlan().toString()), out)[1])(beside(self, rows)))
    nodes, edges = graph.synthetic(spark, 12, 1)
    asked = spark.createDataFrame([(1, "dependencies", "pkg-0==1", None, "nodes"), (2, "dependencies", "pkg-2==1", "pkg-5==1", "path"), (3, "dependencies", "pkg-5==1", "pkg-2==1", "path"), (4, "dependencies", "gone", None, "nodes")], "qid long, direction string, node string, target string, kind string")
    assert {r.qid: r.result_count for r in graph.batch(nodes, edges, asked).collect()} == {1: 11, 2: 4, 3: 0, 4: 0}
    assert len(calls) == 1 and plans and all("LeftOuter, BuildRight" not in p and "BroadcastHashJoin [vid" not in p.split("SortMergeJoin")[0] for p in plans)


def test_requires_sends_a_line_once_to_its_order_and_once_to_its_part(spark, tmp_path):
    from depgrove.plans import derive

    lines = [(o, p) for o, parts in enumerate([(1, 2, 3), (1, 1), (2, 4, 4), (5, 6), (6, None), (7, 9, 9), (3,)]) for p in parts] + [(None, 1), (None, 2)]
    parts = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "c"), (7, "b"), (None, "d")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = derive.table(spark, str(tmp_path), "requires")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(l_orderkey" in plan and plan.count("FileScan") == 2
    tables = {t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("lineitem", "part")}
    wanted = spark.sql(derive.SQL["requires"], **tables)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect())) and found.count() > 8


def test_providers_meet_requirements_in_slices(spark, monkeypatch):
    from depgrove.operators import joins
    from depgrove.plans import join_queries

    requires = spark.createDataFrame([(p, c) for p in range(4) for c in ("none", "own", "many", "rpmlib(x)", None)], "pkg int, cap string")
    provides = spark.createDataFrame([(1, "own"), (1, "own"), (None, "own"), (2, None)] + [(p, "many") for p in range(7)], "pkg int, cap string")
    monkeypatch.setattr(joins, "SLICE", 2)
    monkeypatch.setattr(join_queries, "table", lambda s, d, name: {"requires": requires, "provides": provides}[name])
    found = join_queries.QUERIES["requires_providers"](spark, "")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joins.providers(requires, provides).where("provider IS NOT NULL").collect()))
    assert "Generate explode(providers" in _plan(found)


def test_lines_of_trees_are_parsed_once_and_many_trees_lie_in_a_file(spark, tmp_path, monkeypatch):
    from depgrove.plans import source_queries
    from depgrove.sources import tables

    tmp_path.joinpath("two.txt").write_text(
        "[INFO] Scanning\n[INFO] --- maven-dependency-plugin:3.6.0:tree (default-cli) @ a ---\n[INFO] g:a:jar:1\n[INFO] +- g:b:jar:1:compile\r\n[INFO] |  \\- (g:c:jar:1:test - omitted)\n"
        "[INFO] --- dependency:3.6.0:tree (default-cli) @ d ---\r\n[INFO] |  +- g:e:jar:1:compile\n[INFO] g:d:jar:1\n[INFO] +- g:b:jar:1:compile (optional)\n[INFO] +- ((g:x:jar:1:compile\n\n"
    )
    edges = tables.maven_tree(spark, str(tmp_path))[1]
    assert sorted((r.src, r.dst, r.rel) for r in edges.collect()) == [("g:a==1", "g:b==1", 1), ("g:b==1", "g:c==1", 3), ("g:d==1", "g:b==1", 2)]
    assert _plan(edges).count("Relation [") == 1  # lines ask for parents and are asked as such from one reading
    paths, load = [], source_queries.load
    monkeypatch.setattr(source_queries, "load", lambda s, kind, path: (paths.append(path), load(s, kind, path))[1])
    rows = spark.range(2 * 16 * 512).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"))
    monkeypatch.setattr(source_queries, "table", lambda s, d, name: rows)
    assert source_queries.QUERIES["loaded_maven_edges"](spark, "").count() == 0  # first lines only
    files = spark.read.text(paths[0], wholetext=True).select(F.regexp_count("value", F.lit(":tree ")).alias("trees"), F.regexp_count("value", F.lit(":jar:")).alias("lines"))
    assert sorted(map(tuple, files.collect())) == [(16, 16 * 512)] * 2


def test_a_block_of_queries_is_sent_each_node_once(spark, monkeypatch):
    from depgrove.operators import searches

    plans, counted = [], searches.counted_buckets
    monkeypatch.setattr(searches, "COLUMNS", 1)
    monkeypatch.setattr(searches, "LIST_ENDS", 2)
    monkeypatch.setattr(searches, "BUCKET_BLOCKS", 1)
    monkeypatch.setattr(searches, "SENT_ROWS", 0)
    monkeypatch.setattr(searches, "counted_buckets", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), counted(df, *a, **k))[1])
    ends = {i: {(i + 1) % 9, 500, *range(100, 105)} if i < 9 else {i + 1} if i < 340 and i % 10 < 8 else set() for i in range(600)}
    ends[20] = {20, 21}
    rows = [(a, b) for a, bs in ends.items() for b in bs]
    edges = spark.createDataFrame(rows + rows[::2], "src long, dst long")
    starts = spark.range(600).select(F.col("id").alias("qid"), F.col("id").alias("vid"))
    assert {r.block for r in searches.runs(starts).collect()} != {r.run for r in searches.runs(starts).collect()}
    asked = searches.reach_counts(edges, starts, "dependencies", cycles=True).select("qid", "reached", "direct", "back").collect()
    reached = {}
    for q in range(600):
        seen, new = {q}, {q}
        while new:
            new = {b for a in new for b in ends[a]} - seen
            seen |= new
        reached[q] = (q, len(seen) - 1, len(ends[q] - {q}), int(any(q in ends[a] for a in seen)))
    assert sorted(map(tuple, asked)) == sorted(reached.values())
    # a level asks for its nodes' lists and gets them; neither what it follows nor what was seen moves
    assert len(plans) > 8 and all(p.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(block" not in p for p in plans[1:])
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_a_task_meets_providers_slice_by_slice(spark, monkeypatch):
    from depgrove.operators import joins

    monkeypatch.setattr(joins, "SLICE", 8)
    caps = [f"c{i}" for i in range(5)]
    requires = spark.createDataFrame([(p, c) for p in range(40) for c in caps], "pkg long, cap string").repartition(2, "pkg")
    provides = spark.createDataFrame([(100 + p, c) for p in range(21) for c in caps[:4]] + [(3, "c4"), (7, "c4")], "pkg long, cap string")
    found = joins.provided(requires, provides)
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows) == sorted([(p, c, 100 + o) for p in range(40) for c in caps[:4] for o in range(21)] + [(p, "c4", o) for p in range(40) for o in (3, 7) if p != o])
    tasks = found.rdd.glom().map(lambda part: [(r.cap, max(r.provider - 100, 0) // 8, r.pkg) for r in part]).collect()
    assert all(t == sorted(t) for t in tasks) and "Sort [cap#" in _plan(found)  # a join may drop an order right below it


def test_nodes_stay_where_they_lie_and_a_selector_goes_to_them(spark, tmp_path, monkeypatch):
    from depgrove.operators import graph, joins, query

    nodes, edges = graph.synthetic(spark, 30, 2)
    nodes.write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes").withColumn("meta", F.create_map().cast("map<string,string>"))
    asked, resolved = [], joins.resolved
    monkeypatch.setattr(joins, "resolved", lambda n, s: (asked.append(s), resolved(n, s))[1])
    found = query.run(nodes, edges, "dependencies", "pkg-3==1"), query.run(nodes, edges, "reachable", "pkg-25==1"), graph.reachable(nodes, edges, "pkg-25==1", "dependencies")
    assert [sorted(r.package for r in df.collect()) for df in found] == [["pkg-4==1", "pkg-5==1"]] + [[f"pkg-{i}==1" for i in range(26, 30)]] * 2
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        last = plan[plan.index("Join ["):]
        assert plan.split("Join [")[0].endswith("SortMerge") and "Exchange hashpartitioning(vid#" in last  # the files of the nodes are few KB
    sizes = [int(str(s._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for s in asked]
    assert len(sizes) == 2 and all(n < 1000 for n in sizes)
