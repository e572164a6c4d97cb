"""Searches over a graph that is written for them: edges bucketed by the end that a search leaves from, what was seen bucketed by node.

Many queries go together: a node has one row whatever the number of queries that reach it, with a bit for each query in columns of 64. A
level is one join of the last level with the edges, `bit_or` by node, and what was seen before taken off; only that sum by node is shuffled.
More queries than a row has bits for go together as well, in runs of 64: a node then has a row for each run that reaches it. Runs lie in blocks, and what a
block's queries reach lies where the block does: a node's edges are sent once, as lists, to each block that reaches it, and are followed there by all
its runs. So what a level sends grows with the nodes that blocks reach, and neither with the edges out of them nor with the queries.
What was seen is kept as few tables: MERGED of about one size are written as one, which takes a shuffle of theirs, each row's log(levels) times.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Bucketed, bucketed, buckets, counted, counted_buckets, written

C = F.col
MERGED = 6
BITS = 64
#: Columns of bits that go together; more queries than they hold go in runs of one column, those with targets in a search for each run.
COLUMNS = 16
#: The edges of a bucket, at most, where a shuffle has more partitions than the graph needs; the rows of a level that go to all tasks.
BUCKET_EDGES = 500_000
SENT_ROWS = 10_000
#: The runs of a block (a power of two) and the ends of edges in a row of a node's list, at most; blocks for each bucket, at least, if there are as many runs.
BLOCK_RUNS = 64
LIST_ENDS = 1024
BUCKET_BLOCKS = 4


class Edges:
    """A graph's edges, written once, and once more for each direction that is asked for. n: the buckets, as many as a shuffle has partitions or as the
    edges fill: a level reads and writes them all, however small it is."""

    def __init__(self, edges: DataFrame, n: int | None = None):
        self.edges, self._n = edges, n
        self._by: dict[str, DataFrame] = {}
        self._lists: dict[str, tuple[DataFrame, int]] = {}

    @property
    def n(self) -> int:
        if self._n is None:
            spark = self.edges.sparkSession
            self.edges, found = counted(self.edges.select("src", "dst"), "edges")
            self._n = min(buckets(spark), max(spark.sparkContext.defaultParallelism, -(-found["n"] // BUCKET_EDGES)))
        return self._n

    @classmethod
    def written(cls, by_source: DataFrame, by_target: DataFrame, n: int) -> Edges:
        """Edges that lie in n buckets by either end."""
        out = cls(by_source, n)
        out._by = {"dependencies": turned(by_source, "dependencies"), "dependents": turned(by_target, "dependents")}
        return out

    @classmethod
    def of(cls, edges: DataFrame | Edges) -> Edges:
        return edges if isinstance(edges, Edges) else cls(edges)

    def towards(self, direction: str, depth: int | None = None) -> DataFrame:
        """src, dst of each edge, turned so that a search goes from src to dst; bucketed by src, unless it is read for a step or two only."""
        if direction not in self._by:
            if depth is not None and depth <= 2:
                return turned(self.edges, direction)
            n = self.n
            # by hash of src before the write, so that a bucket is one file
            self._by[direction] = bucketed(turned(self.edges, direction).repartition(n, "src"), "src", "edges", n).by_key
        return self._by[direction]

    def lists(self, direction: str) -> tuple[DataFrame, int]:
        """src, dsts: the different ends of the edges, turned as in `towards`, in rows of LIST_ENDS at most, and their number of buckets by src. Of all buckets:
        for searches whose levels fill them, so the edges need not be counted; nor do they have to be distinct."""
        if direction not in self._lists:
            n = self._n or buckets(self.edges.sparkSession)
            ends = turned(self.edges, direction).repartition(n, "src").distinct()
            place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
            rows = ends.withColumn("slice", F.floor((place - 1) / LIST_ENDS)).groupBy("src", "slice").agg(F.collect_list("dst").alias("dsts"))
            self._lists[direction] = bucketed(rows.select("src", "dsts"), "src", "lists", n).by_key, n
        return self._lists[direction]


def turned(edges: DataFrame, direction: str) -> DataFrame:
    if direction == "dependencies":
        return edges.select("src", "dst")
    if direction == "dependents":
        return edges.select(C("dst").alias("src"), C("src").alias("dst"))
    raise ValueError(f"direction must be dependencies or dependents, not {direction!r}")


def towards(edges: DataFrame | Edges, direction: str) -> DataFrame:
    """The edges of a search, without writing them if they are not written."""
    return edges.towards(direction) if isinstance(edges, Edges) else turned(edges, direction)


class Seen:
    """Rows by key over the levels so far, at most one a key in each table; several tables' values for a key meet by `merge`. by: that one of the keys by
    which they are bucketed, if not by all."""

    def __init__(self, key: str | list[str], values: list[str], n: int, merge: Callable[[DataFrame], DataFrame], by: str | None = None):
        self.keys, self.values, self.n, self.merge, self.by = [key] if isinstance(key, str) else key, values, n, merge, by
        self.tables: list[tuple[int, Bucketed]] = []

    def add(self, table: Bucketed) -> None:
        self.tables.append((0, Bucketed(*[df.select(*self.keys, *self.values) for df in table])))
        while len(self.tables) >= MERGED and self.tables[-MERGED][0] == self.tables[-1][0]:
            last = reduce(DataFrame.unionByName, [t.plain for _, t in self.tables[-MERGED:]]).repartition(self.n, *([self.by] if self.by else self.keys))
            self.tables[-MERGED:] = [(self.tables[-1][0] + 1, bucketed(self.merge(last), self.keys, "seen", self.n, by=self.by))]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.plain for _, t in self.tables])

    def beside(self, rows: DataFrame) -> tuple[DataFrame, list[list[Column]]]:
        """The rows with each table's values of their key (null: none) in columns of their own; no table is shuffled,
        nor sent to all tasks through the driver, which would get each of them again at each level."""
        columns = []
        for i, (_, table) in enumerate(self.tables):
            names, keys = {v: f"{v}_{i}" for v in self.values}, {k: f"key_{k}_{i}" for k in self.keys}
            rows = rows.join(table.by_key.withColumnsRenamed(names | keys).hint("merge"), reduce(lambda a, b: a & b, [C(k) == C(o) for k, o in keys.items()]), "left").drop(*keys.values())
            columns.append([C(name) for name in names.values()])
        return rows, columns


def stepped(level: DataFrame, out: DataFrame, rows: int) -> DataFrame:
    """The edges out of a level of so many rows; a large one is joined by bucket and never sent to all tasks."""
    return (level.hint("merge") if rows > SENT_ROWS else level).join(out, C("vid") == C("src"))


def numbered(starts: DataFrame, together: int) -> tuple[DataFrame, int]:
    """qid, run and bit of the distinct queries (so many go together), and their number. Only the queries' own ids meet in one task."""
    rows = starts.select("qid").distinct().withColumn("i", F.row_number().over(Window.orderBy("qid")) - 1)
    rows, n = counted(rows.select("qid", F.floor(C("i") / together).cast("int").alias("run"), (C("i") % together).alias("bit")), "queries")
    return rows, n["n"]


def runs(starts: DataFrame) -> DataFrame:
    """qid, block, run and bit of the distinct queries, 64 a run and up to BLOCK_RUNS runs a block; no task holds them all."""
    rows = starts.select("qid").distinct().orderBy("qid").withColumn("i", F.monotonically_increasing_id())
    rows, found = counted(rows.select("qid", F.shiftright("i", 6).alias("run"), C("i").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("bit")), "queries")
    few = min(BLOCK_RUNS, max(1, found["n"] // (BITS * BUCKET_BLOCKS * buckets(starts.sparkSession))))
    return rows.withColumn("block", F.shiftright("run", few.bit_length() - 1))


def _keys(rows: DataFrame, *keys: str) -> list[str]:
    """Those of the keys that the rows have: run is there only where several runs go together."""
    return [k for k in keys if k in rows.columns]


def _masks(rows: DataFrame, columns: int) -> DataFrame:
    """vid (and block and run) and a column of bits m0, m1, ... for each 64 queries. rows: vid (, block, run), bit."""
    one = lambda c: F.bit_or(F.when(F.floor(C("bit") / BITS) == c, F.call_function("shiftleft", F.lit(1).cast("long"), C("bit") % BITS)).otherwise(F.lit(0).cast("long"))).alias(f"m{c}")
    return rows.groupBy(*_keys(rows, "block", "vid", "run")).agg(*[one(c) for c in range(columns)])


def mask_levels(edges: Edges, starts: DataFrame, direction: str, columns: int, depth: int | None = None, targets: DataFrame | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """vid, m0, m1, ... and distance: a row for each node and distance at which queries reach it first. starts, targets: vid, bit; a query ends
    with the level that holds its target. With block and run in starts (and no targets) the rows of `run_levels`, of which `each` makes others."""
    if "run" in starts.columns:
        return run_levels(edges, starts, direction, depth, each)
    m, n, keys = [f"m{c}" for c in range(columns)], edges.n, ["vid"]
    out = edges.towards(direction, depth)
    wanted = bucketed(_masks(targets, columns).withColumnsRenamed({c: f"want_{c}" for c in m}), "vid", "targets", n).by_key if targets is not None else None
    seen = Seen(keys, m, n, lambda df: df.groupBy(*keys).agg(*[F.bit_or(c).alias(c) for c in m]))
    levels, distance, done = [], 0, [0] * columns

    def keep(fresh: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        hits = {}
        if wanted is not None:
            fresh = fresh.join(wanted, "vid", "left")
            hits = {f"hit_{c}": F.bit_or(C(c).bitwiseAND(F.coalesce(f"want_{c}", F.lit(0)))) for c in m}
        table, found = counted_buckets(fresh, keys, "level", n, **hits)
        seen.add(table)
        levels.append(table.plain.select(*keys, *m, F.lit(distance).cast("long").alias("distance")))
        return table.by_key.select(*keys, *m), found

    level, found = keep(_masks(starts, columns))
    while found["n"] and (depth is None or distance < depth):
        distance += 1
        if wanted is not None:
            done = [d | found[f"hit_{c}"] for d, c in zip(done, m)]
            level = level.select("vid", *[C(c).bitwiseAND(F.lit(~d)).alias(c) for d, c in zip(done, m)])
        step = stepped(level, out, found["n"]).select(C("dst").alias("vid"), *m)
        step = placed(step, n, *keys).groupBy(*keys).agg(*[F.bit_or(c).alias(c) for c in m])
        step, before = seen.beside(step)
        fresh = [reduce(lambda a, b: a.bitwiseAND(F.bitwise_not(F.coalesce(b, F.lit(0).cast("long")))), [row[i] for row in before], C(c)).alias(c) for i, c in enumerate(m)]
        some = reduce(lambda a, b: a | b, [C(c) != 0 for c in m])
        level, found = keep(step.select(*keys, *fresh).where(some))
    return reduce(DataFrame.unionByName, levels)


@contextmanager
def joined_where_they_lie(spark):
    """Tables that lie by one of the keys of a join are joined there, for what runs within; else Spark shuffles them by all of the keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_levels(edges: Edges, starts: DataFrame, direction: str, depth: int | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """block, vid, run, m0, distance and again: a row for each node, run and distance, with the bits of the run's queries that reach the node first, and of those
    that begin there and come back. each: what is made of each level's rows, which lie by block, before they are united. starts: vid, block, run, bit."""
    (out, n), keys, none = edges.lists(direction), ["block", "vid", "run"], F.lit(0).cast("long")
    seen = Seen(keys, ["m0"], n, lambda df: df.groupBy(*keys).agg(F.bit_or("m0").alias("m0")), by="block")
    levels, distance = [], 0
    with joined_where_they_lie(starts.sparkSession):
        rows = _masks(starts.repartition(n, "block"), 1).withColumn("again", none)
        while True:
            table, found = counted_buckets(rows.select(*keys, "m0", "again"), keys, "level", n, by="block", fresh=F.count_if(C("m0") != 0))
            of = lambda df: df.withColumn("distance", F.lit(distance).cast("long"))  # noqa: B023, E731
            levels.append(each(of(table.by_key)) if each else of(table.plain))
            if not found["fresh"] or distance == depth:
                return reduce(DataFrame.unionByName, levels)
            seen.add(table)
            distance += 1
            level = table.by_key.where("m0 <> 0").select(*keys, "m0")
            begun = table.by_key.select(*[C(k).alias(f"begun_{k}") for k in keys], C("m0").alias("begun")).hint("merge") if distance == 1 else begun
            level = level.hint("merge") if found["fresh"] > SENT_ROWS else level
            asked = level.select("block", "vid").distinct()
            asked = placed(asked.hint("merge") if found["fresh"] > SENT_ROWS else asked, n, "vid").join(out, C("vid") == C("src"))
            sent = asked.select(C("block").alias("to"), "src", "dsts").repartition(n, "to")
            step = level.join(sent, (C("block") == C("to")) & (C("vid") == C("src"))).select("block", "run", F.explode("dsts").alias("vid"), "m0")
            step, before = seen.beside(step.groupBy(*keys).agg(F.bit_or("m0").alias("m0")))
            step = step.join(begun, reduce(lambda a, b: a & b, [C(k) == C(f"begun_{k}") for k in keys]), "left")
            fresh = reduce(lambda a, b: a.bitwiseAND(F.bitwise_not(F.coalesce(b, none))), [row[0] for row in before], C("m0"))
            rows = step.select(*keys, fresh.alias("m0"), C("m0").bitwiseAND(F.coalesce("begun", none)).alias("again")).where("m0 <> 0 OR again <> 0")


def placed(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows as tables of n buckets lie; as a grouping lays them out anyway where a shuffle has as many partitions, after a sum within tasks."""
    return rows if n == buckets(rows.sparkSession) else rows.repartition(n, *keys)


def bits_of(columns: int) -> Column:
    """The numbers of a row's queries."""

    def of(c: int) -> Column:
        held = lambda i: F.call_function("shiftrightunsigned", C(f"m{c}"), i).bitwiseAND(F.lit(1)) == 1
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), held), lambda i: i + BITS * c)

    return F.explode(F.flatten(F.array(*map(of, range(columns))))).alias("bit")


def run_counts(level: DataFrame) -> DataFrame:
    """run, bit, reached, direct and back of each query in a level of `run_levels`: counted where the level's blocks lie, by mask first."""
    alike = level.groupBy("block", "run", "distance", "m0", "again").agg(F.count("*").alias("n"))
    held = lambda m: F.call_function("shiftrightunsigned", C(m), C("bit")).bitwiseAND(F.lit(1)) == 1
    bits = alike.select("*", F.explode(F.array(*map(F.lit, range(BITS)))).alias("bit"))
    new = F.when(held("m0") & (C("distance") > 0), C("n")).otherwise(0)
    each = bits.where(held("m0") | held("again")).select("block", "run", "bit", "distance", new.alias("n"), F.when(held("again"), 1).otherwise(0).alias("back"))
    of = each.groupBy("block", "run", "bit").agg(F.sum("n").alias("reached"), F.sum(F.when(C("distance") == 1, C("n")).otherwise(0)).alias("direct"), F.max("back").alias("back"))
    return of.select("run", "bit", "reached", "direct", C("back").cast("long").alias("back"))


def counts(rows: DataFrame, columns: int, **where: Column) -> DataFrame:
    """bit and, for each name, how many of the rows that meet its condition have the bit; rows are summed by their masks first, as most nodes are
    reached by the same queries as others."""
    alike = rows.groupBy(*[f"m{c}" for c in range(columns)]).agg(*[F.count_if(on).alias(name) for name, on in where.items()])
    return alike.select(bits_of(columns), *where).groupBy("bit").agg(*[F.sum(name).alias(name) for name in where])


def each_run(starts: DataFrame, targets: DataFrame | None = None):
    """Of each run of so many queries as go together: its queries (qid, bit), columns, starts and targets (vid, bit). Without targets all go
    together; queries and starts of more than the columns hold have their run."""
    together = BITS * COLUMNS
    if targets is None and starts.select("qid").distinct().limit(together + 1).count() > together:
        queries = runs(starts)
        yield queries, 1, starts.join(queries.hint("merge"), "qid").select("vid", "block", "run", "bit"), None
        return
    queries, n = numbered(starts, together)
    for run in range(-(-n // together)):
        own = queries.where(C("run") == run).select("qid", "bit")
        at = lambda rows: rows.join(own, "qid").select("vid", "bit") if rows is not None else None  # noqa: B023, E731
        yield own, -(-min(together, n - run * together) // BITS), at(starts), at(targets)


def _united(parts: list[DataFrame], starts: DataFrame, *columns: str) -> DataFrame:
    empty = starts.select("qid", *[F.lit(None).cast("long").alias(c) for c in columns]).limit(0)
    return reduce(DataFrame.unionByName, parts) if parts else empty


def distances(edges: DataFrame | Edges, starts: DataFrame, direction: str, depth: int | None = None) -> DataFrame:
    """qid, vid, distance (0 at the starts). starts: qid, vid."""
    edges, parts = Edges.of(edges), []
    for own, columns, at, _ in each_run(starts):
        found = mask_levels(edges, at, direction, columns, depth)
        by = _keys(own, "run", "bit")
        own = own.hint("merge") if "run" in by else own
        parts.append(found.select(*_keys(found, "vid", "run"), "distance", bits_of(columns)).join(own, by).select("qid", "vid", "distance"))
    return _united(parts, starts, "vid", "distance")


def target_distances(edges: DataFrame | Edges, starts: DataFrame, targets: DataFrame, direction: str) -> DataFrame:
    """qid, distance of each query's target (qid, vid), where it is reached; a query ends with the level that holds it."""
    edges, parts = Edges.of(edges), []
    for own, columns, at, ends in each_run(starts, targets):
        found = mask_levels(edges, at, direction, columns, targets=ends)
        wanted = _masks(ends, columns).withColumnsRenamed({f"m{c}": f"want_{c}" for c in range(columns)})
        hit = found.join(wanted, "vid").select("distance", *[C(f"m{c}").bitwiseAND(C(f"want_{c}")).alias(f"m{c}") for c in range(columns)])
        parts.append(hit.select("distance", bits_of(columns)).join(own, "bit").select("qid", "distance"))
    return _united(parts, starts, "distance")


def answers(edges: DataFrame | Edges, starts: DataFrame, targets: DataFrame, direction: str) -> DataFrame:
    """qid, reached and, of queries with a target that is reached, distance: both kinds in one search. For as many queries as go together."""
    edges, parts = Edges.of(edges), []
    for own, columns, at, ends in each_run(starts, targets):
        found = mask_levels(edges, at, direction, columns, targets=ends)
        wanted = _masks(ends, columns).withColumnsRenamed({f"m{c}": f"want_{c}" for c in range(columns)})
        hit = found.join(wanted, "vid").select("distance", *[C(f"m{c}").bitwiseAND(C(f"want_{c}")).alias(f"m{c}") for c in range(columns)]).select("distance", bits_of(columns))
        parts.append(counts(found, columns, reached=C("distance") > 0).join(own, "bit").join(hit, "bit", "left").select("qid", "reached", "distance"))
    return _united(parts, starts, "reached", "distance")


def reach_counts(edges: DataFrame | Edges, starts: DataFrame, direction: str, cycles: bool = False) -> DataFrame:
    """qid, reached (nodes, the starts themselves not) and direct (at a distance of 1), with a row per node and none per node and query; cycles:
    also back, 1 where a way leads back to the start."""
    edges, parts = Edges.of(edges), []
    for own, columns, at, _ in each_run(starts):
        if "run" in own.columns:
            found = mask_levels(edges, at, direction, columns, each=run_counts)
            rows = found.groupBy("run", "bit").agg(F.sum("reached").alias("reached"), F.sum("direct").alias("direct"), F.max("back").alias("back")).join(own.hint("merge"), ["run", "bit"])
            parts.append(rows.select("qid", "reached", "direct", *(["back"] if cycles else [])))
            continue
        found = mask_levels(edges, at, direction, columns)
        rows = counts(found, columns, reached=C("distance") > 0, direct=C("distance") == 1).join(own, "bit")
        if cycles:
            before = at.join(towards(edges, direction), C("vid") == C("dst")).select(C("src").alias("vid"), "bit")
            asked = _masks(before, columns).withColumnsRenamed({f"m{c}": f"want_{c}" for c in range(columns)})
            ends = found.join(asked, "vid").select(*[C(f"m{c}").bitwiseAND(C(f"want_{c}")).alias(f"m{c}") for c in range(columns)])
            rows = rows.join(ends.select(bits_of(columns)).distinct().withColumn("again", F.lit(1).cast("long")), "bit", "left").withColumn("back", F.coalesce("again", F.lit(0).cast("long")))
        parts.append(rows.select("qid", "reached", "direct", *(["back"] if cycles else [])))
    return _united(parts, starts, "reached", "direct", *(["back"] if cycles else []))


class Origins:
    """What is reached from any of many nodes, with the first two different ones of each node: enough to tell whether one of the many is
    reached from another."""

    @staticmethod
    def search(edges: DataFrame | Edges, starts: DataFrame, direction: str) -> DataFrame:
        """vid, of: at most two rows for each node. starts: vid."""
        edges = Edges.of(edges)
        out, ends = edges.towards(direction), lambda df: df.select("vid", F.explode(F.array("a", "b")).alias("of")).where("of IS NOT NULL")
        two = lambda df: df.groupBy("vid").agg(F.min("of").alias("a"), F.nullif(F.max("of"), F.min("of")).alias("b"))
        seen = Seen("vid", ["a", "b"], edges.n, lambda df: two(ends(df)))
        level, found = counted_buckets(starts.select("vid", C("vid").alias("a"), F.lit(None).cast("long").alias("b")).distinct(), "vid", "level", edges.n)
        while found["n"]:
            seen.add(level)
            step, before = seen.beside(two(ends(placed(stepped(level.by_key, out, found["n"]).select(C("dst").alias("vid"), "a", "b"), edges.n, "vid"))))
            known = F.array_compact(F.array(*[c for row in before for c in row]))
            fresh = F.slice(F.array_except(F.array_compact(F.array("a", "b")), known), F.lit(1), F.greatest(F.lit(0), 2 - F.size(known)))
            step = step.select("vid", fresh.alias("x")).where(F.size("x") > 0).select("vid", F.get("x", 0).alias("a"), F.get("x", 1).alias("b"))
            level, found = counted_buckets(step, "vid", "level", edges.n)
        return ends(seen.rows())
