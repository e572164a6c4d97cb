"""Joins between packages, capabilities, advisories, builds and snapshots; each is a set of equality joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import versions as V
from . import intervals as I

C = F.col
#: So many providers of a capability are one row: a multiple of 8, which Parquet packs together, and few enough that a page holds them many times.
SLICE = 128


def providers(requires: DataFrame, provides: DataFrame, ignored: tuple[str, ...] = ("rpmlib(", "config(")) -> DataFrame:
    """pkg, cap, provider: one row per provider other than the package itself; without one the provider is null (an unresolved
    capability). Capabilities that begin with an ignored prefix are left out."""
    for prefix in ignored:
        requires = requires.where(~C("cap").startswith(prefix))
    p = provides.select(C("pkg").alias("provider"), C("cap").alias("provided")).distinct()
    return requires.join(p, (C("cap") == C("provided")) & (C("pkg") != C("provider")), "left").select("pkg", "cap", "provider")


def provided(requires: DataFrame, provides: DataFrame, ignored: tuple[str, ...] = ("rpmlib(", "config(")) -> DataFrame:
    """The rows of `providers` that have a provider. A capability's providers meet its requirements in rows of SLICE, which are few enough to be sent
    to where the requirements lie. A task meets them slice by slice, so its rows, which are many, repeat the same few providers and take little where they
    are written."""
    for prefix in ignored:
        requires = requires.where(~C("cap").startswith(prefix))
    p = provides.where("pkg IS NOT NULL").select("pkg", C("cap").alias("provided")).distinct()
    place = F.row_number().over(Window.partitionBy("provided").orderBy("pkg"))
    slices = p.withColumn("slice", F.floor((place - 1) / SLICE)).groupBy("provided", "slice").agg(F.collect_list("pkg").alias("providers"))
    last = slices.groupBy("provided").agg(F.max("slice").alias("last"))
    asked = requires.join(last, C("cap") == C("provided")).select("pkg", "cap", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("at"))
    # an order right below a join counts as needless, so the sorted rows pass a list of one
    ordered = asked.sortWithinPartitions("cap", "at", "pkg").select("pkg", "cap", F.explode(F.array("at")).alias("at"))
    found = ordered.join(slices, (C("cap") == C("provided")) & (C("at") == C("slice"))).select("pkg", "cap", F.explode("providers").alias("provider"))
    return found.where(C("pkg") != C("provider"))


def unresolved(requires: DataFrame, provides: DataFrame, ignored: tuple[str, ...] = ("rpmlib(", "config(")) -> DataFrame:
    """pkg, cap: the rows of `providers` whose provider is null, without the rows of the others. Of a capability's providers only the first and
    the last count: they are the package itself where no other provides it."""
    for prefix in ignored:
        requires = requires.where(~C("cap").startswith(prefix))
    ends = provides.groupBy(C("cap").alias("provided")).agg(F.min("pkg").alias("first"), F.max("pkg").alias("last"))
    other = F.coalesce((C("first") != C("pkg")) | (C("last") != C("pkg")), F.lit(False))
    return requires.join(ends, C("cap") == C("provided"), "left").where(~other).select("pkg", "cap")


def first_requirements(packages: DataFrame, limit: int) -> DataFrame:
    """pkg, cap of the first requirements of each package (array `requires`), cut before any lookup."""
    return packages.select("pkg", F.posexplode(F.slice("requires", 1, limit)).alias("pos", "cap"))


def nearest_installed(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """wanted: path, dep. Gives target: the installed path nearest above the wanting one, from its own folder up to the root; null if
    there is none. A path is node_modules/a/node_modules/b; the root's is empty."""
    depth = F.size(F.split("path", "node_modules/")) - 1
    above = F.transform(F.sequence(F.lit(0), depth), lambda up: F.call_function("substring_index", F.concat(F.lit("/"), "path"), F.lit("/node_modules/"), depth + 1 - up))
    candidate = F.transform(above, lambda a: F.ltrim(F.concat(F.ltrim(a, F.lit("/")), F.lit("/node_modules/"), C("dep")), F.lit("/")))
    asked = wanted.select("path", "dep", F.posexplode(candidate).alias("up", "target"))
    found = asked.join(installed.select(C("path").alias("target")).distinct(), "target").groupBy("path", "dep").agg(F.min_by("target", "up").alias("target"))
    return wanted.join(found, ["path", "dep"], "left")


def exact_or_unique(asked: DataFrame, packages: DataFrame) -> DataFrame:
    """asked: name, version. Gives found: the id of that name and version, else of the name's only version, else null."""
    only = packages.groupBy("name").agg(F.count("*").alias("n"), F.first("id").alias("only")).where("n = 1").select("name", "only")
    exact = packages.select("name", "version", C("id").alias("exact"))
    return asked.join(exact, ["name", "version"], "left").join(only, "name", "left").select("name", "version", F.coalesce("exact", "only").alias("found"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that no edge leads to: they get an edge from the root."""
    return nodes.join(edges.select(C("dst").alias("vid")), "vid", "left_anti")


def advisory_matches(advisories: DataFrame, packages: DataFrame) -> DataFrame:
    """advisory, severity and id of every match: by purl, by package id, or by name with a version listed, in a range, or neither given.

    advisories: advisory (a key), severity, ecosystem, purls (array, as names.purl_forms gives them), package_id, package, versions
    (array), ranges (array of structs: introduced, fixed, last_affected, limit); packages: id, name, version (as the id has it),
    ecosystem, purls, candidates (array: the spellings of the version). One equality join for each way, never a comparison of all with
    all; the ecosystem, where given, must be the same. Columns that are null count as not given.
    """
    a, p = advisories.alias("a"), packages.alias("p")
    none = F.array().cast("array<string>")
    same = (F.coalesce("a.ecosystem", F.lit("")) == "") | (C("a.ecosystem") == C("p.ecosystem"))
    by_purl = advisories.select("advisory", "severity", "ecosystem", F.explode("purls").alias("purl")).distinct().alias("a")
    has_purl = packages.select("id", "ecosystem", F.explode("purls").alias("purl")).distinct().alias("p")
    listed = advisories.select("advisory", "severity", "ecosystem", "package", F.explode("versions").alias("spelled")).alias("a")
    spelled = packages.select("id", "ecosystem", "name", F.explode("candidates").alias("spelled")).alias("p")
    free = (F.size(F.coalesce("a.versions", none)) <= 0) & (F.size(F.coalesce("a.ranges", F.array())) <= 0)
    ways = [
        by_purl.join(has_purl, (C("a.purl") == C("p.purl")) & same),
        a.join(p, (C("a.package_id") == C("p.id")) & same),
        listed.join(spelled, (C("a.package") == C("p.name")) & (C("a.spelled") == C("p.spelled")) & same),
        a.where(free).join(p, (C("a.package") == C("p.name")) & same),
    ]
    rows = [x.select("a.advisory", "a.severity", "p.id") for x in ways]
    rows.append(_ranged(advisories, packages))
    return reduce(DataFrame.unionByName, rows).dropDuplicates(["advisory", "id"])


def _ranged(advisories: DataFrame, packages: DataFrame) -> DataFrame:
    """advisory, severity, id where one of the ranges holds a spelling of the version. Versions have the order of their kind: rpm or not, and of an
    rpm all spellings or, for a range whose bounds have a release or an epoch, the precise ones."""
    rpm, own = C("ecosystem") == "rpm", F.coalesce("ecosystem", F.lit(""))
    exact = F.filter("candidates", lambda x: F.contains(x, F.lit("-")) | F.contains(x, F.lit(":")))
    kinds = F.when(rpm, F.array(F.lit("rpm"), F.lit("precise"))).otherwise(F.array(F.lit("plain")))
    points = packages.select("id", "name", "ecosystem", "candidates", F.explode(kinds).alias("kind"))
    fine = F.when((C("kind") == "precise") & (F.size(exact) > 0), exact).otherwise(C("candidates"))
    points = points.select("id", "name", "kind", rpm.alias("rpm"), F.array_distinct(F.array(own, F.lit(""))).alias("ecos"), F.explode(fine).alias("v"))
    points = points.select("id", "name", "kind", "rpm", "v", F.explode("ecos").alias("eco"))
    points = points.select(F.struct("name", "kind", "eco").alias("group"), V.advisory_key(C("v"), C("rpm")).alias("key"), C("id").alias("item"))
    ranges = advisories.where("package IS NOT NULL").select("advisory", "severity", "package", own.alias("eco"), F.posexplode("ranges").alias("i", "r"))
    has = lambda c: F.coalesce(C(f"r.{c}"), F.lit("")) != ""
    fields = ("introduced", "fixed", "last_affected", "limit")
    some = reduce(lambda x, y: x | y, map(has, fields))
    detailed = F.exists(F.array_compact(F.array(*[C(f"r.{c}") for c in fields])), lambda x: F.contains(x, F.lit("-")) | F.contains(x, F.lit(":")))
    kind = F.explode(F.array(F.lit("plain"), F.when(detailed, "precise").otherwise("rpm"))).alias("kind")
    ranges = ranges.where(some).select("advisory", "severity", "i", "r", "package", "eco", kind)
    key = lambda c: V.advisory_key(C(f"r.{c}"), C("kind") != "plain")
    bounds = F.array_compact(F.array(
        F.when(has("introduced") & (C("r.introduced") != "0"), I.at_least(key("introduced"))), F.when(has("fixed"), I.below(key("fixed"))),
        F.when(has("last_affected"), I.at_most(key("last_affected"))), F.when(has("limit"), I.below(key("limit"))),
    ))
    ranges = ranges.select(F.struct("advisory", "severity", "i", "kind").alias("range"), F.struct(C("package").alias("name"), "kind", "eco").alias("group"), bounds.alias("bounds"))
    return I.matches(points, ranges).select("range.advisory", "range.severity", C("item").alias("id"))


def advisory_packages(nodes: DataFrame) -> DataFrame:
    """The packages of a graph as advisory_matches wants them. nodes: id, ecosystem, meta."""
    of = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    name, version = N.split_id(C("id"))
    spelled = F.when(C("ecosystem") == "rpm", V.rpm_candidates(version, of("version"), of("release"), of("epoch"), of("arch"))).otherwise(F.array(version))
    return nodes.select("id", name.alias("name"), version.alias("version"), "ecosystem", F.array_union(N.purl_forms(of("purl")), N.purl_forms(C("id"))).alias("purls"), spelled.alias("candidates"))


def keyed_diff(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], order: str) -> DataFrame:
    """key, change (added, removed or changed) and fields (the names of those that differ); of rows with one key the last by `order` counts.
    Both sides are grouped by the key at once, so there is one shuffle and no join; null keys are keys."""
    side = lambda df, n: df.select(*key, F.struct(C(order).alias("place"), *fields).alias("row"), F.lit(n).alias("side"))
    last = lambda n: F.max(F.when(C("side") == n, C("row")))
    both = side(left, 0).unionByName(side(right, 1)).groupBy(*key).agg(last(0).alias("l"), last(1).alias("r"))
    differ = F.array_compact(F.array(*[F.when(~F.equal_null(C(f"l.{f}"), C(f"r.{f}")), f) for f in fields]))
    change = F.when(C("l").isNull(), "added").when(C("r").isNull(), "removed").when(F.size(differ) > 0, "changed")
    return both.select(*key, change.alias("change"), F.when(change == "changed", F.array_join(differ, ",")).otherwise("").alias("fields")).where("change IS NOT NULL")


def edge_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    added, removed = right.exceptAll(left), left.exceptAll(right)
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


def provenance(installed: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The installed packages with the build of the binary artifact of the same name, version, release and arch; else null."""
    key = ["name", "version", "release", "arch"]
    built = artifacts.groupBy(*key).agg(F.min("build").alias("build"))
    return installed.join(built, key, "left")


def action_match(actions: DataFrame, packages: DataFrame) -> DataFrame:
    """actions: idx, id, name, arch. Gives node: the exact id, else the first id of the name and arch; null if there is none."""
    first = packages.groupBy("name", "arch").agg(F.min("id").alias("first"))
    exact = packages.select("id", C("id").alias("exact")).distinct()
    return actions.join(exact, "id", "left").join(first, ["name", "arch"], "left").select("idx", F.coalesce("exact", "first").alias("node"), F.when(C("exact").isNotNull(), "exact").when(C("first").isNotNull(), "name").otherwise("none").alias("how"))


def transaction_matches(actions: DataFrame, packages: DataFrame) -> DataFrame:
    """graph, idx, action, role (package, old or new), name, arch, node and how (exact, name-arch or none) of each package of a transaction.

    actions: graph, idx, action, package, old, new (structs of names.transaction_package, null if there is none); packages: id, name, arch."""
    role = lambda r: F.struct(F.lit(r).alias("role"), C(r).alias("p"))
    asked = actions.select("graph", "idx", "action", F.explode(F.array(role("package"), role("old"), role("new"))).alias("x")).where("x.p IS NOT NULL")
    asked = asked.select("graph", "idx", "action", "x.role", "x.p.name", "x.p.arch", C("x.p.node").alias("id"))
    first = packages.where("name <> '' AND arch <> ''").groupBy("name", "arch").agg(F.min("id").alias("first"))
    exact = packages.select("id", C("id").alias("exact")).distinct()
    both = asked.join(exact, "id", "left").join(first, ["name", "arch"], "left")
    how = F.when(C("exact").isNotNull(), "exact").when(C("first").isNotNull(), "name-arch").otherwise("none")
    return both.select("graph", "idx", "action", "role", "name", "arch", F.coalesce("exact", "first").alias("node"), how.alias("how"))


def paired(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Removed and added ids of a name, paired in order: name, position, old, new."""
    at = lambda df, c: df.select("name", F.row_number().over(Window.partitionBy("name").orderBy("id")).alias("position"), C("id").alias(c))
    return at(removed, "old").join(at(added, "new"), ["name", "position"])


#: What each kind of selector is looked for in, in this order: ids, then purls, then names (before ==, of the metadata, in column name).
LOOKED_FOR = {"query": {"id": 0, "purl": 1, "before": 2}, "report": {"id": 0, "purl": 1, "before": 2, "meta": 2}, "diff": {"id": 0, "column": 2}}
CANDIDATES = {"query": 20, "report": 20, "diff": 5}


def resolved(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """kind, selector, node, status (found, ambiguous, text or unknown), matches and candidates of each selector. nodes: id, meta and, for diffs,
    name; selectors: kind (query, report or diff), selector.

    An id is itself; else the only node with that purl, else the only one with that name; several are ambiguous, in a report only if no single
    one has the name. Without any, a query or report takes the text itself, a diff knows no node. All selectors are looked up in one join."""
    of = lambda k: F.try_element_at("meta", F.lit(k))
    way = lambda name, key: F.struct(F.lit(name).alias("way"), key.alias("key"))
    ways = [way("id", C("id")), way("purl", of("purl")), way("before", N.split_id(C("id"))[0]), way("meta", of("name")), *([way("column", C("name"))] if "name" in nodes.columns else [])]
    keys = nodes.select("id", F.explode(F.array(*ways)).alias("w")).select("id", "w.way", C("w.key").alias("selector")).where("selector IS NOT NULL")
    asked = selectors.select("kind", "selector").distinct()
    rank = F.lit(None).cast("int")
    for kind, places in LOOKED_FOR.items():
        for name, place in places.items():
            rank = F.when((C("kind") == kind) & (C("way") == name), place).otherwise(rank)
    hits = asked.join(keys, "selector").select("kind", "selector", "id", rank.alias("rank")).where("rank IS NOT NULL").distinct()
    place = Window.partitionBy("kind", "selector", "rank").orderBy("id")
    most = F.when(C("kind") == "diff", CANDIDATES["diff"]).otherwise(CANDIDATES["query"])
    counts = hits.groupBy("kind", "selector", "rank").agg(F.count("*").alias("n"))
    few = hits.withColumn("k", F.row_number().over(place)).where(C("k") <= max(CANDIDATES.values())).where(C("k") <= most)
    few = few.groupBy("kind", "selector", "rank").agg(F.array_sort(F.collect_list("id")).alias("ids")).join(counts, ["kind", "selector", "rank"])
    at = lambda r, c: F.max(F.when(C("rank") == r, C(c))).alias(f"{c}{r}")
    found = asked.join(few.groupBy("kind", "selector").agg(*[at(r, c) for r in range(3) for c in ("n", "ids")]), ["kind", "selector"], "left")
    one = lambda r: C(f"n{r}") == 1
    several = lambda r: C(f"n{r}") > 1
    report, diff = C("kind") == "report", C("kind") == "diff"
    used = F.when(C("n0") >= 1, 0).when(one(1), 1).when(several(1) & report & one(2), 2).when(several(1), 1).when(C("n2") >= 1, 2)
    pick = lambda c: F.when(used == 0, C(f"{c}0")).when(used == 1, C(f"{c}1")).when(used == 2, C(f"{c}2"))
    n, ids = F.coalesce(pick("n"), F.lit(0).cast("long")), F.coalesce(pick("ids"), F.array().cast("array<string>"))
    status = F.when((used == 0) | (n == 1), "found").when(n > 1, "ambiguous").when(diff, "unknown").otherwise("text")
    node = F.when(used == 0, C("selector")).when(n == 1, ids[0]).when((n == 0) & ~diff, C("selector"))
    return found.select("kind", "selector", node.alias("node"), status.alias("status"), n.alias("matches"), ids.alias("candidates"))


def _selected(nodes: DataFrame, kind: str, text: str, role: str) -> str:
    # of known size, so that the one row is sent to the nodes, and not their keys to it
    asked = nodes.sparkSession.range(1).select(F.lit(kind).alias("kind"), F.lit(text).alias("selector"))
    row = resolved(nodes, asked).first()
    if row.status == "ambiguous":
        more = ", ..." if row.matches > len(row.candidates) else ""
        raise ValueError(f"Ambiguous {role} selector {text!r}; candidates: {', '.join(row.candidates)}{more}")
    if row.status == "unknown":
        raise ValueError(f"no node {text!r}")
    return row.node


def select_node(nodes: DataFrame, text: str, role: str = "node") -> str:
    """The id that a selector of a query means; several are an error. nodes: id, meta."""
    return _selected(nodes.select("id", "meta"), "query", text, role)


def select_package(nodes: DataFrame, text: str) -> str:
    """The id that a selector of a report means. nodes: id, meta."""
    return _selected(nodes.select("id", "meta"), "report", text, "package")


def select_snapshot_node(nodes: DataFrame, text: str) -> str:
    """The id that a selector of a diff means; none is an error as well. nodes: id, name, meta."""
    return _selected(nodes, "diff", text, "node")


def side_selectors(both: str | None, left: str | None, right: str | None) -> tuple[str, str]:
    """One selector for both sides, or one for each, not a mixture."""
    both, left, right = ((x or "").strip() for x in (both, left, right))
    if both and (left or right):
        raise ValueError("a selector for both sides excludes one for each")
    if not both and not (left and right):
        raise ValueError("a selector for both sides, or one for each, is needed")
    return (both, both) if both else (left, right)


def selector(packages: DataFrame, text: str) -> DataFrame:
    """How a selector is understood, without an error: the exact id, else the only package of the purl, else the only one of the name, else
    unchanged; null where several were meant; candidates says how many the deciding step had."""
    hits = packages.agg(
        F.count_if(C("id") == text).alias("ids"), F.count_if(C("purl") == text).alias("purls"), F.count_if(C("name") == text).alias("names"),
        F.min(F.when(C("purl") == text, C("id"))).alias("by_purl"), F.min(F.when(C("name") == text, C("id"))).alias("by_name"),
    )
    chosen: Column = F.when((C("ids") > 0) | (C("purls") + C("names") == 0), F.lit(text)).when(C("purls") == 1, C("by_purl")).when((C("purls") == 0) & (C("names") == 1), C("by_name"))
    return hits.select(F.lit(text).alias("selector"), chosen.alias("chosen"), F.greatest("ids", F.when(C("purls") > 0, C("purls")).otherwise(C("names"))).alias("candidates"))


def tree_parents(lines: DataFrame) -> DataFrame:
    """lines: tree, line, depth, id. Gives the parent: the id of the last line before at a depth of one less, however deep."""
    row = F.struct(*[c for c in lines.columns if c not in ("tree", "line")])
    none = lines.select(row.alias("row"), "id").schema
    asked = F.struct((C("depth") - 1).alias("of"), F.lit(None).cast(none["id"].dataType).alias("last"), row.alias("row"))
    given = F.struct(C("depth").alias("of"), C("id").alias("last"), F.lit(None).cast(none["row"].dataType).alias("row"))
    before = Window.partitionBy("tree", "of").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # both from one reading of the lines
    both = lines.select("tree", "line", F.inline(F.array(asked, given))).where("row IS NOT NULL OR of >= 0")
    found = both.withColumn("parent", F.last("last", ignorenulls=True).over(before))
    return found.where("row IS NOT NULL").select("tree", "line", "row.*", "parent").select(*lines.columns, "parent")
