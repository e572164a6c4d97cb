"""Loaders whose formats columns can read: JSON, XML, TSV and line formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import nonempty, purl_forms, purl_package, transaction_package
from ..operators import npm
from ..operators.joins import first_requirements, nearest_installed, providers, tree_parents
from ..operators.tables import counted
from .common import MAP, files, lines, node, one_per_id

C = F.col


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """graph, name, constraint, url, marker, hash and scope of each requirement line; option lines are left out."""
    rows = lines(spark, path).withColumn("text", F.trim(F.regexp_replace("text", r"(^|\s)#.*$", ""))).where("text <> '' AND NOT startswith(text, '-')")
    body = F.trim(F.regexp_replace(F.substring_index("text", ";", 1), r"\s+--hash=\S+", ""))
    name = F.regexp_extract(body, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    scope = F.when(F.regexp_like("graph", F.lit(r"(?i)dev|test")), "dev").otherwise("runtime")
    return rows.select(
        "graph", "line", F.translate(F.lower(name), "_.", "--").alias("name"), F.regexp_extract(body, r"\[([^\]]*)\]", 1).alias("extras"),
        F.trim(F.regexp_extract(body, r"^[A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]]*\])?\s*((?:===|==|~=|!=|<=|>=|<|>).*)$", 1)).alias("constraint"),
        nonempty(F.regexp_extract(body, r"@\s*(\S+)$", 1)).alias("url"), nonempty(F.regexp_extract("text", r";\s*(.*?)(?:\s+--hash.*)?$", 1)).alias("marker"),
        nonempty(F.regexp_extract("text", r"--hash=(\S+)", 1)).alias("hash"), scope.alias("scope"),
    )


def requirements_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A root per file, named after it, and a node for each requirement: its exact version, else its constraint or address, else unresolved."""
    rows = requirements(spark, path)
    exact = F.trim(F.regexp_extract("constraint", r"^={2,3}(.*)$", 1))
    version = F.coalesce(*[F.nullif(c, F.lit("")) for c in (exact, C("constraint"), C("url"))], F.lit("unresolved"))
    root = F.regexp_extract("graph", r"([^/]*?)(?:\.[^./]*)?$", 1)
    rows = rows.withColumn("version", version).withColumn("root", F.concat(root, F.lit("==resolved")))
    nodes = one_per_id(rows.select(C("line").alias("seq"), *node(C("graph"), C("name"), C("version"), F.lit("pypi"), constraint=C("constraint"), url=C("url"), marker=C("marker"), hash=C("hash"), scope=C("scope"), extras=C("extras"))))
    roots = files(spark, path).select(*node(C("graph"), root, F.lit("resolved"), F.lit("pypi"), node_type=F.lit("root")), F.lit(-1).cast("long").alias("seq"))
    return roots.unionByName(nodes), rows.select("graph", C("root").alias("src"), F.concat("name", F.lit("=="), "version").alias("dst"), F.lit(1).alias("rel")).distinct()


def maven_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The trees that a build prints: the depth is where the name begins, the parent the last line one level up in the same tree. The line that says that
    the plugin starts on a module begins another tree. rel: 1 plain, 2 optional, 3 omitted, 4 excluded."""
    trees = files(spark, path).select("graph", F.posexplode(F.split("text", r"(?m)^\[INFO\] --- \S*dependency\S*:tree .*$")).alias("tree", "text"))
    rows = trees.select("graph", "tree", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).where(F.contains("text", F.lit(":")))
    # each step is named once, as the next ones ask for it several times
    rows = rows.withColumn("text", F.when(F.startswith("text", F.lit("[INFO] ")), F.substr("text", F.lit(8))).otherwise(C("text")))
    rows = rows.withColumn("said", F.ltrim("text", F.lit("|+\\ -")))
    rows = rows.withColumn("p", F.split(F.regexp_extract("said", r"^\(?([^ ()]+)", 1), ":")).where(F.size("p") >= 4)
    p, n = C("p"), F.size("p")
    at = lambda i: F.get(p, F.lit(i))
    has = F.when(n >= 6, at(3)).when((n == 5) & at(4).isin("compile", "runtime", "test", "provided", "system"), None).when(n == 5, at(3))
    version = F.when(n == 4, at(3)).when(n == 5, F.when(has.isNull(), at(3)).otherwise(at(4))).otherwise(at(4))
    name = F.concat_ws(":", at(0), at(1), F.when(at(2) != "jar", at(2)), has)
    rel = F.when(F.contains("text", F.lit("excluded")), 4).when(F.contains("text", F.lit("omitted")), 3).when(F.contains("text", F.lit("(optional")), 2).otherwise(1)
    rows = rows.select(
        "graph", "tree", (F.shiftleft(C("tree").cast("long"), 32) + C("line")).alias("line"), ((F.length("text") - F.length("said")) / 3).cast("long").alias("depth"),
        name.alias("name"), version.alias("version"), rel.alias("rel"), F.element_at(p, -1).alias("scope"),
    ).withColumn("id", F.concat("name", F.lit("=="), "version"))
    found = tree_parents(rows.select(F.struct("graph", "tree").alias("tree"), "line", "depth", "id", "rel"))
    nodes = one_per_id(rows.select(C("line").alias("seq"), *node(C("graph"), C("name"), C("version"), F.lit("maven"), scope=C("scope"))))
    edges = found.where("parent IS NOT NULL").groupBy(C("tree.graph").alias("graph"), C("parent").alias("src"), C("id").alias("dst")).agg(F.max_by("rel", "line").alias("rel"))
    return nodes, edges


def dot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges of a digraph, also to a block of targets; labels without a version get ==unknown."""
    text = F.regexp_replace("text", r"//[^\n]*", "")
    pair = r'"?([\w.:+/=@-]+)"?\s*->\s*(\{[^}]*\}|"[^"]+"|[\w.:+/=@-]+)'
    found = files(spark, path).withColumn("text", text).select("graph", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pair), 1).alias("s"), F.regexp_extract_all("text", F.lit(pair), 2).alias("t"))).alias("x"))
    full = lambda c: F.when(F.contains(c, F.lit("==")), c).otherwise(F.concat(c, F.lit("==unknown")))
    edges = found.select("graph", C("x.s").alias("s"), F.explode(F.regexp_extract_all(C("x.t"), F.lit(r'([\w.:+/=@-]+)'), 1)).alias("t"))
    edges = edges.select("graph", full(C("s")).alias("src"), full(C("t")).alias("dst"), F.lit(1).alias("rel")).distinct()
    ids = edges.select("graph", C("src").alias("id")).union(edges.select("graph", "dst")).distinct()
    return ids.select(*node(C("graph"), F.substring_index("id", "==", 1), F.regexp_extract("id", r"==(.*)$", 1), F.lit("generic"), C("id"))), edges


def transaction(spark: SparkSession, path: str) -> DataFrame:
    """graph, idx (from 1), action, package, old and new (structs of names.transaction_package, null if there is none) of each line of a
    solver's transaction: a verb, with or without a colon, and a package, or `old -> new`. Other lines are left out."""
    rows = lines(spark, path).withColumn("text", F.trim("text")).where("NOT startswith(text, '#')")
    action = F.rtrim(F.lower(F.substring_index("text", " ", 1)), F.lit(":"))
    rest = F.when(F.contains("text", F.lit(" ")), F.trim(F.substr("text", F.instr("text", " ") + 1))).otherwise("")
    rows = rows.select("graph", "line", action.alias("action"), rest.alias("rest")).where(action.isin("install", "erase", "upgrade", "downgrade", "reinstall"))
    arrow = F.instr("rest", " -> ")
    old, new = F.when(arrow > 0, F.substr("rest", F.lit(1), arrow - 1)), F.when(arrow > 0, F.substr("rest", arrow + 4))
    idx = F.row_number().over(Window.partitionBy("graph").orderBy("line"))
    return rows.select("graph", idx.alias("idx"), "action", transaction_package(F.when(arrow == 0, C("rest"))).alias("package"), transaction_package(old).alias("old"), transaction_package(new).alias("new"))


CYCLONEDX = """bomFormat string, metadata struct<component: struct<`bom-ref`: string, name: string, version: string>>,
components array<struct<type: string, `bom-ref`: string, name: string, version: string, purl: string, licenses: array<struct<license: struct<id: string, name: string>, expression: string>>, properties: array<struct<name: string, value: string>>>>,
dependencies array<struct<ref: string, dependsOn: array<string>>>"""


def cyclonedx(spark: SparkSession, path: str, prefix: str = "depgrove:") -> tuple[DataFrame, DataFrame]:
    """Components with their properties as metadata, the prefix of a property's name taken off; ends of dependencies that are no component,
    and the root, are of the ecosystem of the last component that has one."""
    docs = files(spark, path).select("graph", F.from_json("text", CYCLONEDX).alias("d"))
    x = docs.select("graph", F.posexplode("d.components").alias("seq", "c"))
    ref = F.coalesce(F.nullif(C("c.`bom-ref`"), F.lit("")), F.concat(F.coalesce("c.name", F.lit("unknown")), F.lit("=="), F.coalesce("c.version", F.lit("unknown"))))
    eco = nonempty(F.regexp_extract("c.purl", r"^pkg:([^/]+)/", 1))
    first = F.get("c.licenses", F.lit(0))
    text = F.coalesce(first["license"]["id"], first["license"]["name"], first["expression"])
    props = F.map_from_entries(F.transform(F.coalesce("c.properties", F.array().cast("array<struct<name:string,value:string>>")), lambda p: F.struct(F.regexp_replace(p["name"], "^" + prefix, "").alias("k"), p["value"].alias("v"))))
    of_file = x.select("graph", "seq", eco.alias("eco")).where("eco IS NOT NULL").groupBy("graph").agg(F.max_by("eco", "seq").alias("last"))
    nodes = x.select("seq", *node(C("graph"), C("c.name"), C("c.version"), F.coalesce(eco, F.lit("generic")), ref, purl=C("c.purl"), ecosystem=eco, component_type=C("c.type"), license=text), props.alias("props"))
    nodes = nodes.withColumn("meta", F.map_concat(F.map_filter("meta", lambda k, v: ~F.map_contains_key("props", k)), "props")).drop("props")
    edges = docs.select("graph", F.explode("d.dependencies").alias("d")).select("graph", C("d.ref").alias("src"), F.explode("d.dependsOn").alias("dst"), F.lit(1).alias("rel")).distinct()
    root = docs.select("graph", F.coalesce(F.nullif(C("d.metadata.component.`bom-ref`"), F.lit("")), F.concat("d.metadata.component.name", F.lit("=="), "d.metadata.component.version")).alias("id")).where("id IS NOT NULL")
    bare = edges.select("graph", C("src").alias("id")).union(edges.select("graph", "dst")).distinct().union(root).distinct().join(nodes.select("graph", "id"), ["graph", "id"], "left_anti")
    bare = bare.join(of_file, "graph", "left").select(F.lit(2**31 - 1).alias("seq"), *node(C("graph"), F.substring_index("id", "==", 1), F.regexp_extract("id", r"==(.*)$", 1), F.coalesce("last", F.lit("generic")), C("id")))
    return one_per_id(nodes.unionByName(bare)), edges


SNAPSHOT = f"root string, ecosystem string, nodes array<struct<id: string, name: string, version: string, metadata: {MAP}>>, edges array<struct<source: string, target: string, relationshipType: int>>"


def snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    docs = files(spark, path).select("graph", F.from_json("text", SNAPSHOT).alias("d"))
    n = docs.select("graph", C("d.ecosystem").alias("eco"), F.explode("d.nodes").alias("n"))
    nodes = n.select("graph", C("n.id").alias("id"), C("n.name").alias("name"), C("n.version").alias("version"), F.coalesce(F.try_element_at("n.metadata", F.lit("ecosystem")), "eco").alias("ecosystem"), C("n.metadata").alias("meta"))
    edges = docs.select("graph", F.explode("d.edges").alias("e")).select("graph", C("e.source").alias("src"), C("e.target").alias("dst"), F.coalesce("e.relationshipType", F.lit(1)).alias("rel"))
    return nodes, edges


DEPENDENCIES = (("peerDependencies", "peer"), ("optionalDependencies", "optional"), ("devDependencies", "dev"), ("dependencies", "runtime"))
RECORD = "name: string, version: string, resolved: string, integrity: string, license: string, dev: boolean, devOptional: boolean, optional: boolean, peer: boolean, hasInstallScript: boolean, scripts: map<string,string>, " + ", ".join(f"{f}: {MAP}" for f, _ in DEPENDENCIES)
LOCK = f"name string, version string, license string, scripts {MAP}, packages map<string, struct<{RECORD}>>, dependencies map<string, string>"


def _record_meta(p: str, kind: Column, place: Column) -> dict[str, Column]:
    """What a lock file's record says of a package."""
    c = lambda f: C(f"{p}.{f}")
    on = lambda x: F.when(F.coalesce(x, F.lit(False)), "True")
    scope = F.when(F.coalesce(c("optional"), F.lit(False)), "optional").when(F.coalesce(c("dev"), F.lit(False)) | F.coalesce(c("devOptional"), F.lit(False)), "dev").when(F.coalesce(c("peer"), F.lit(False)), "peer").otherwise("runtime")
    peers = F.array_join(F.array_sort(F.map_keys(c("peerDependencies"))), ",")
    return {
        "ecosystem": F.lit("npm"), "node_type": F.when(kind == "root", "root").otherwise("package"), "package_path": F.nullif(place, F.lit("")), "classification": kind, "dependency_scope": scope,
        "resolved": c("resolved"), "integrity": c("integrity"), "license": F.nullif(c("license"), F.lit("")), "dev": on(c("dev")), "optional": on(c("optional")), "has_install_script": on(c("hasInstallScript")),
        "remote_tarball_url": on(npm.domain(c("resolved")).isNotNull()), "remote_tarball_domain": npm.domain(c("resolved")), "git_dependency": on(npm.is_git(c("resolved"), c("version"))),
        "local_file_dependency": on(npm.is_file(c("resolved"), c("version"))), "peer_dependencies": F.nullif(peers, F.lit("")),
    }


def _script_meta(scripts: Column) -> dict[str, Column]:
    names = F.array_sort(F.map_keys(scripts))
    install = F.filter(names, lambda x: x.isin("preinstall", "install", "postinstall"))
    return {"lifecycle_scripts": F.nullif(F.array_join(names, ","), F.lit("")), "install_scripts": F.nullif(F.array_join(install, ","), F.lit("")), "has_install_script": F.when(F.size(install) > 0, "True")}


def _locks(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).select("graph", F.from_json("text", LOCK).alias("d"))


def _records(docs: DataFrame) -> DataFrame:
    """graph, seq, path, name, version, p (the record) and scripts of each path in lock files that has a name and a version."""
    rows = docs.select("graph", "d", F.posexplode("d.packages").alias("seq", "path", "p"))
    own = F.regexp_extract("path", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)
    is_root = C("path") == ""
    name = F.when(is_root, F.coalesce("p.name", "d.name", F.lit("npm-project"))).otherwise(F.coalesce("p.name", F.nullif(own, F.lit(""))))
    version = F.when(is_root, F.coalesce("p.version", "d.version", F.lit("0.0.0"))).otherwise(C("p.version"))
    return rows.select("graph", "seq", "path", name.alias("name"), version.alias("version"), "p", "d.scripts").where("name IS NOT NULL AND version IS NOT NULL")


def locked_packages(spark: SparkSession, path: str) -> DataFrame:
    """graph, path, name and version of every path of lock files: a package that lies at several has as many rows."""
    return _records(_locks(spark, path)).select("graph", "path", "name", "version")


def package_lock(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (with scope, constraint, path and target_path) and what could not be found (graph, path, dep) of lock files with packages
    by path: each dependency is looked up from its package's folder upwards. Files with nested dependencies instead (version 1) give a
    node per entry and an edge from what holds it, level by level until none is left."""
    docs = _locks(spark, path)
    rows = _records(docs)

    def entries(field: str, scope: str) -> Column:
        return F.transform(F.map_entries(F.coalesce(f"p.{field}", F.create_map().cast(MAP))), lambda e: F.struct(e["key"].alias("dep"), F.lit(scope).alias("scope"), e["value"].alias("constraint")))

    fields = F.array(*[entries(f, scope) for f, scope in DEPENDENCIES])
    # of several fields the first counts; the graph is put in front of the path, so that files are resolved apart
    at = lambda c: F.concat(F.lit("node_modules/"), F.sha1("graph"), F.when(F.length(c) > 0, F.concat(F.lit("/"), c)).otherwise(""))
    asked = rows.select("graph", at(C("path")).alias("path"), F.concat("name", F.lit("=="), "version").alias("src"), F.posexplode(F.flatten(fields)).alias("k", "x"))
    wanted = asked.groupBy("graph", "path", "src", C("x.dep").alias("dep")).agg(F.min_by("x", "k").alias("x"))
    installed = rows.select(at(C("path")).alias("path"), F.concat("name", F.lit("=="), "version").alias("dst"))
    found = nearest_installed(wanted.select("path", "dep").distinct(), installed)
    edges = wanted.join(found, ["path", "dep"], "left").join(installed.withColumnRenamed("path", "target"), "target", "left")
    plain = lambda c: F.regexp_replace(c, r"^node_modules/[0-9a-f]{40}/?", "")
    edges = edges.select("graph", plain("path").alias("path"), "src", "dep", "dst", C("x.scope").alias("scope"), C("x.constraint").alias("constraint"), plain("target").alias("target_path"))
    direct = edges.where("path = '' AND dst IS NOT NULL").select("graph", C("target_path").alias("path"), F.lit(True).alias("direct")).distinct()
    placed = rows.join(direct, ["graph", "path"], "left")
    kind = F.when(C("path") == "", "root").when(C("direct"), "direct").otherwise("transitive")
    meta = _record_meta("p", kind, C("path"))
    scripts = {k: F.when(C("path") == "", v) for k, v in _script_meta(C("scripts")).items()}
    meta |= {k: F.coalesce(v, meta[k]) if k in meta else v for k, v in scripts.items()}
    nodes = placed.select("seq", *node(C("graph"), C("name"), C("version"), F.lit("npm"), **meta))
    missing = edges.where("dst IS NULL").select("graph", "path", "dep")
    old_nodes, old_edges = _nested_lock(docs)
    edges = edges.where("dst IS NOT NULL").select("graph", "src", "dst", F.lit(1).alias("rel"), "scope", "constraint", "path", "target_path")
    return one_per_id(nodes.unionByName(old_nodes)), edges.unionByName(old_edges), missing


def _nested_lock(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of lock files of version 1; docs: graph, d (LOCK)."""
    record = "struct<" + RECORD.replace(f"dependencies: {MAP}", f"dependencies: {MAP}, requires: string") + ">"
    record = record.replace(f", dependencies: {MAP}, requires", ", nested: string, requires")
    old = docs.where("d.packages IS NULL AND d.dependencies IS NOT NULL")
    root = F.concat(F.coalesce("d.name", F.lit("npm-project")), F.lit("=="), F.coalesce("d.version", F.lit("0.0.0")))
    level = old.select("graph", root.alias("src"), F.explode("d.dependencies").alias("name", "text"), F.lit(True).alias("direct"))
    found, left = [], 1
    while left:  # each level is written and read from there; how much is below it is counted meanwhile
        rows = level.select("graph", "src", "name", "direct", F.from_json("text", record).alias("p"), F.get_json_object("text", "$.dependencies").alias("nested"))
        rows = rows.withColumn("version", F.coalesce("p.version", F.lit("0.0.0"))).withColumn("id", F.concat("name", F.lit("=="), "version")).withColumn("seq", F.lit(len(found)))
        table, n = counted(rows, "nested", left=F.count_if(C("nested").isNotNull()))
        found.append(table.drop("nested"))
        left = n["left"]
        level = table.where("nested IS NOT NULL").select("graph", C("id").alias("src"), F.explode(F.from_json("nested", MAP)).alias("name", "text"), F.lit(False).alias("direct"))
    rows = reduce(DataFrame.unionByName, found)
    kind = F.when(C("direct"), "direct").otherwise("transitive")
    meta = _record_meta("p", kind, F.concat(F.lit("legacy:"), "name"))
    nodes = rows.select("seq", *node(C("graph"), C("name"), C("version"), F.lit("npm"), **meta))
    roots = old.select(F.lit(-1).alias("seq"), *node(C("graph"), F.coalesce("d.name", F.lit("npm-project")), F.coalesce("d.version", F.lit("0.0.0")), F.lit("npm"), ecosystem=F.lit("npm"), node_type=F.lit("root"), classification=F.lit("root"), dependency_scope=F.lit("runtime"), license=F.nullif(C("d.license"), F.lit("")), **_script_meta(C("d.scripts"))))
    edges = rows.select("graph", "src", C("id").alias("dst"), F.lit(1).alias("rel"), _record_meta("p", kind, F.lit(""))["dependency_scope"].alias("scope"), F.coalesce("p.version", F.lit("")).alias("constraint"), F.lit("legacy").alias("path"), F.concat(F.lit("legacy:"), "name").alias("target_path"))
    return roots.unionByName(nodes), edges


def package_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The root and a node for each requirement, named by its constraint; of several fields peer, then optional, then dev counts."""
    fields = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
    schema = "name string, version string, " + ", ".join(f"{f} {MAP}" for f in fields)
    docs = files(spark, path).select("graph", F.from_json("text", schema).alias("d"))
    parts = [docs.select("graph", F.concat("d.name", F.lit("=="), "d.version").alias("root"), F.explode(f"d.{f}").alias("name", "version"), F.lit(i).alias("rank"), F.lit(s).alias("scope")) for i, (f, s) in enumerate(zip(fields, ("runtime", "dev", "optional", "peer")))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    best = rows.groupBy("graph", "root", "name").agg(F.max_by("version", "rank").alias("version"), F.max_by("scope", "rank").alias("scope"))
    root = docs.select(*node(C("graph"), C("d.name"), C("d.version"), F.lit("npm")))
    return root.unionByName(best.select(*node(C("graph"), C("name"), C("version"), F.lit("npm"), scope=C("scope")))), best.select("graph", C("root").alias("src"), F.concat("name", F.lit("=="), "version").alias("dst"), F.lit(1).alias("rel"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """name, version, dependencies (map of name to constraint); a record's dependencies are such a map, or a list of objects with a name and
    a constraint, which is * if it is missing."""
    rows = files(spark, path).select(F.explode(F.from_json("text", "map<string, map<string, struct<dependencies: string>>>")).alias("name", "versions"))
    rows = rows.select(F.trim("name").alias("name"), F.explode("versions").alias("version", "r"))
    text, none = F.ltrim(C("r.dependencies")), F.create_map().cast(MAP)
    listed = F.from_json(text, "array<struct<name: string, constraint: string>>")
    as_map = F.map_from_entries(F.transform(F.filter(listed, lambda x: x["name"].isNotNull()), lambda x: F.struct(x["name"].alias("k"), F.coalesce(x["constraint"], F.lit("*")).alias("v"))))
    found = F.when(F.startswith(text, F.lit("[")), as_map).otherwise(F.from_json(text, MAP))
    return rows.select("name", F.trim("version").alias("version"), F.coalesce(found, none).alias("dependencies"))


RPM = """name string, arch string, version struct<_epoch: string, _ver: string, _rel: string>, summary string, format struct<license: string, sourcerpm: string,
provides: struct<entry: array<struct<_name: string>>>, requires: struct<entry: array<struct<_name: string>>>>"""


def primary_of(spark: SparkSession, path: str) -> str:
    """The primary metadata that a repomd.xml names, beside the folder it is in; another path is itself. A file of a few lines."""
    if not path.rsplit("/", 1)[-1].startswith("repomd"):
        return path
    schema = "_type string, location struct<_href: string>"
    rows = spark.read.format("xml").option("rowTag", "data").option("ignoreNamespace", True).schema(schema).load(path)
    found = rows.where("_type = 'primary' AND location._href <> ''").select("location._href").first()
    if found is None:
        raise ValueError(f"{path} names no primary metadata")
    href = found[0]
    return href if "://" in href or href.startswith("/") else f"{path.rsplit('/', 1)[0]}/{href}"


def rpm_repository(spark: SparkSession, path: str, requirement_limit: int = 200, package_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """primary.xml, also compressed, or the repomd.xml that names it: packages, and edges to providers (rel 30) or to capabilities that
    nothing provides (rel 31). package_limit: only the first packages of the file."""
    path = primary_of(spark, path)
    rows = spark.read.format("xml").option("rowTag", "package").option("ignoreNamespace", True).schema(RPM).load(path).where("version IS NOT NULL AND format IS NOT NULL")
    if package_limit is not None:
        rows = rows.limit(max(0, package_limit))
    full = F.concat("version._ver", F.lit("-"), "version._rel", F.lit("."), "arch")
    rows = rows.select(
        F.lit(path).alias("graph"), "name", full.alias("full"), F.concat("name", F.lit("=="), full).alias("id"), "arch", "summary", F.coalesce("version._epoch", F.lit("0")).alias("epoch"), C("version._ver").alias("ver"), C("version._rel").alias("rel"),
        C("format.license").alias("license"), C("format.sourcerpm").alias("source"), C("format.provides.entry._name").alias("gives"), C("format.requires.entry._name").alias("wants"),
    )
    nodes = rows.select(*node(C("graph"), C("name"), C("full"), F.lit("rpm"), C("id"), ecosystem=F.lit("rpm"), node_type=F.lit("package"), name=C("name"), epoch=C("epoch"), version=C("ver"), release=C("rel"), arch=C("arch"), license=C("license"), source_rpm=C("source"), summary=C("summary")))
    given = rows.select(C("id").alias("pkg"), F.explode(F.array_union(F.coalesce("gives", F.array().cast("array<string>")), F.array("name"))).alias("cap"))
    wants = first_requirements(rows.select(C("id").alias("pkg"), C("wants").alias("requires")), requirement_limit).drop("pos")
    found = providers(wants, given).distinct()
    cap = F.concat(F.lit("rpm-capability:"), "cap")
    missing = found.where("provider IS NULL").select(cap.alias("id"), "cap").distinct()
    nodes = nodes.unionByName(missing.select(*node(F.lit(path), C("id"), F.lit(""), F.lit("rpm"), C("id"), ecosystem=F.lit("rpm"), node_type=F.lit("unresolved_requirement"), capability=C("cap"))))
    edges = found.groupBy(C("pkg").alias("src"), F.coalesce("provider", cap).alias("dst")).agg(F.max(F.when(C("provider").isNull(), 31).otherwise(30)).alias("rel"))
    return nodes, edges.select(F.lit(path).alias("graph"), "src", "dst", "rel")


TSV = ("name", "epoch", "version_release", "arch", "vendor", "license", "source_rpm", "install_time", "distribution", "packager", "upstream_url", "build_host", "dist_tag", "dist_url", "bug_url")


def installed_rpms(spark: SparkSession, path: str) -> DataFrame:
    """Rows of 15, 8 or 3 fields; three are name, version-release and arch. (none) counts as missing."""
    part, n = F.split("text", "\t"), F.size(F.split("text", "\t"))
    at = lambda i: nonempty(F.nullif(F.get(part, F.lit(i)), F.lit("(none)")))
    short = {"name": 0, "version_release": 1, "arch": 2}
    cols = [F.when(n >= 8, at(i)).otherwise(at(short[c]) if c in short else F.lit(None).cast("string")).alias(c) for i, c in enumerate(TSV)]
    return lines(spark, path).where(n >= 3).select("graph", "line", *cols, F.concat(at(0), F.lit("=="), F.when(n >= 8, at(2)).otherwise(at(1))).alias("id"))


def installed_graph(packages: DataFrame, requires: DataFrame, provides: DataFrame, requirement_limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """The graph of installed packages. packages: the rows of installed_rpms; requires: name, position, cap as the database lists them;
    provides: cap, position, id of the packages that the database names for a capability, the first of which counts. A root leads to all
    packages; capabilities that begin with an ignored prefix are left out before the first requirements of a package are taken."""
    root = F.lit("rpm-installed==local")
    meta = {c: C(c) for c in TSV if c not in ("name", "version_release")}
    nodes = packages.select(*node(C("graph"), C("name"), C("version_release"), F.lit("rpm"), C("id"), ecosystem=F.lit("rpm"), name=C("name"), version=C("version_release"), **meta), C("line").alias("seq") if "line" in packages.columns else F.lit(0).alias("seq"))
    nodes = one_per_id(nodes)
    roots = packages.select("graph").distinct().select(F.lit(-1).cast("long").alias("seq"), *node(C("graph"), F.lit("rpm-installed"), F.lit("local"), F.lit("rpm"), root, ecosystem=F.lit("rpm"), node_type=F.lit("root")))
    wants = requires.where("cap <> '' AND NOT startswith(cap, 'rpmlib(') AND NOT startswith(cap, 'config(')")
    wants = wants.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("position"))).where(C("k") <= requirement_limit)
    first = provides.groupBy("cap").agg(F.min_by("id", "position").alias("dst"))
    found = packages.select("graph", "name", C("id").alias("src")).join(wants, "name").join(first, "cap").where("src <> dst").select("graph", "src", "dst")
    edges = packages.select("graph", root.alias("src"), C("id").alias("dst")).unionByName(found).distinct()
    return roots.unionByName(nodes), edges.withColumn("rel", F.lit(1))


def _text(c: str, name: str) -> Column:
    return F.get_json_object(c, f"$.{name}")


def _purl_sets(*texts: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(purl_forms(t), F.array().cast("array<string>")) for t in texts])))


RANGES = "array<struct<introduced: string, fixed: string, lastAffected: string, limit: string>>"


def _ranges(text: Column) -> Column:
    renamed = lambda r: F.struct(r["introduced"].alias("introduced"), r["fixed"].alias("fixed"), r["lastAffected"].alias("last_affected"), r["limit"].alias("limit"))
    return F.transform(F.from_json(text, RANGES), renamed)


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """The advisories of an overlay (an object with advisories, or a list) as joins.advisory_matches wants them, and id and summary.
    advisory is the file and the place in it. One that names no package, name, package id or purl is an error."""
    docs = files(spark, path)
    one = F.when(F.startswith(F.ltrim("text"), F.lit("[")), C("text")).otherwise(_text("text", "advisories"))
    rows = docs.select("graph", F.posexplode(F.from_json(one, "array<string>")).alias("at", "a"))
    nested = _text("a", "package")
    package = F.when(~F.startswith(F.ltrim(nested), F.lit("{")), F.nullif(nested, F.lit("")))
    name = F.coalesce(package, F.nullif(_text("a", "name"), F.lit("")), F.nullif(_text("a", "packageId"), F.lit("")))
    purls = _purl_sets(_text("a", "purl"), _text("a", "packageUrl"), _text("a", "packageURL"), _text("a", "packageId"), _text("a", "package.purl"))
    given, single = _text("a", "versions"), _text("a", "version")
    versions = F.when(F.startswith(F.ltrim(given), F.lit("[")), F.from_json(given, "array<string>")).when(given.isNotNull(), F.array(given)).when(single.isNotNull(), F.array(single))
    checked = F.when(name.isNull() & (F.size(purls) == 0), F.raise_error(F.lit("each advisory must name a package, a package id or a purl")).cast("string")).otherwise(_text("a", "id"))
    return rows.select(
        F.concat("graph", F.lit("#"), "at").alias("advisory"), checked.alias("id"), _text("a", "severity").alias("severity"), _text("a", "ecosystem").alias("ecosystem"), purls.alias("purls"), _text("a", "packageId").alias("package_id"),
        name.alias("package"), versions.alias("versions"), _ranges(_text("a", "ranges")).alias("ranges"), _text("a", "summary").alias("summary"),
    )


EVENTS = "array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string, limit: string>>>>"


def osv_feed(spark: SparkSession, path: str, ecosystem: str) -> DataFrame:
    """The records of public feeds (a record, a list, or a container of records) as joins.advisory_matches wants them, a row per affected
    package of the ecosystem, whose name is compared without regard to case."""
    from ..operators.reports import range_intervals

    boxes = [_text("text", b) for b in ("vulns", "advisories", "items", "CVE_Items")]
    listed = lambda t: F.when(F.startswith(F.ltrim(t), F.lit("[")), F.from_json(t, "array<string>"))
    rows = files(spark, path).select("graph", F.posexplode(F.coalesce(listed(C("text")), *[listed(b) for b in boxes], F.array("text"))).alias("at", "v"))
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    id_ = F.coalesce(some(_text("v", "id"), _text("v", "cve.CVE_data_meta.ID")), F.lit("UNKNOWN"))
    severity = _text("v", "severity")
    severity = F.coalesce(some(_text("v", "database_specific.severity"), _text("v", "severity[0].score"), _text("v", "severity[0].type"), F.when(~F.startswith(F.ltrim(severity), F.lit("[")), severity)), F.lit(""))
    summary = F.coalesce(some(_text("v", "summary"), _text("v", "details")), F.lit(""))
    alone = F.array(F.to_json(F.struct(
        F.struct(some(_text("v", "package"), _text("v", "name")).alias("name"), some(_text("v", "purl"), _text("v", "packageUrl")).alias("purl")).alias("package"),
        F.from_json(_text("v", "versions"), "array<string>").alias("versions"), F.from_json(_text("v", "ranges"), EVENTS).alias("ranges"),
    )))
    rows = rows.select("graph", "at", id_.alias("id"), severity.alias("severity"), summary.alias("summary"), F.posexplode(F.coalesce(listed(_text("v", "affected")), alone)).alias("k", "a"))
    purl = F.coalesce(_text("a", "package.purl"), F.lit(""))
    named = F.coalesce(some(_text("a", "package.name"), _text("a", "name"), purl_package(purl)), F.lit(""))
    same = F.lower(F.coalesce(some(_text("a", "package.ecosystem")), F.lit(ecosystem))) == ecosystem.lower()
    intervals = F.flatten(F.transform(F.from_json(_text("a", "ranges"), EVENTS), lambda r: range_intervals(r["events"])))
    limited = F.transform(intervals, lambda r: F.struct(r["introduced"].alias("introduced"), r["fixed"].alias("fixed"), r["last_affected"].alias("last_affected"), F.lit(None).cast("string").alias("limit")))
    rows = rows.where(same & (named != ""))
    return rows.select(
        F.concat("graph", F.lit("#"), "at", F.lit("."), "k").alias("advisory"), "id", "severity", F.lit(ecosystem).alias("ecosystem"), _purl_sets(purl).alias("purls"), F.lit(None).cast("string").alias("package_id"),
        named.alias("package"), F.coalesce(F.from_json(_text("a", "versions"), "array<string>"), F.array().cast("array<string>")).alias("versions"), limited.alias("ranges"), "summary",
    )


BUILD = """id string, build_id string, package string, source_package string, created_at string, finished_at string, released string, release_id string, tasks array<struct<id: string, status: string, arch: string, index: string,
started_at: string, finished_at: string, alma_commit_cas_hash: string, platform: struct<name: string, id: string, type: string, arch_list: array<string>>, ref: struct<url: string, git_ref: string, git_commit_hash: string>,
test_tasks: array<struct<id: string, performance_stats: array<struct<statistics: string>>>>, performance_stats: array<struct<statistics: string>>,
artifacts: array<struct<id: string, name: string, type: string, href: string, cas_hash: string, log_content: string, log: string, content: string, text: string, excerpt: string>>>>,
sign_tasks array<struct<id: string, status: string, started_at: string, finished_at: string, stats: string>>, test_tasks array<struct<id: string, status: string, revision: string, performance_stats: array<struct<statistics: string>>>>"""

#: Relationships of a build's graph.
BUILD_EDGES = {"source": 20, "repository": 21, "commit": 22, "task": 23, "environment": 24, "artifact": 25, "sign": 26, "test": 27, "release": 28}


def builds(spark: SparkSession, path: str) -> DataFrame:
    """graph, build (its node) and b: what the build's file says."""
    docs = files(spark, path).select("graph", F.from_json("text", BUILD).alias("b"))
    return docs.select("graph", F.concat(F.lit("albs-build:"), F.coalesce(F.nullif(C("b.id"), F.lit("")), C("b.build_id"), F.lit("unknown"))).alias("build"), "b")


def build(spark: SparkSession, path: str, task_limit: int = 50, artifact_limit: int = 200, test_task_limit: int = 50, logs: bool = False) -> tuple[DataFrame, DataFrame]:
    """The provenance of builds: source package, release, tasks, repositories, commits, environments, artifacts, signatures and tests, with the
    relationships of BUILD_EDGES. The first tasks, artifacts (over all tasks) and tests of a build; logs: also artifacts that are no rpm."""
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    b = builds(spark, path)
    stem = lambda url: F.nullif(F.regexp_replace(F.substring_index(F.rtrim(F.coalesce(url, F.lit("")), F.lit("/")), "/", -1), r"\.git$", ""), F.lit(""))
    repos = F.filter(F.transform("b.tasks", lambda t: stem(t["ref"]["url"])), lambda x: x.isNotNull())
    package = F.coalesce(some(C("b.package"), C("b.source_package")), F.get(repos, F.lit(0)), F.lit("unknown"))
    b = b.withColumn("package", package).withColumn("source", F.concat(F.lit("source:"), "package")).withColumn("release", F.concat(F.lit("albs-release:"), "b.release_id"))
    t = b.select("graph", "build", "source", "release", "package", F.posexplode(F.slice("b.tasks", 1, max(0, task_limit)) if task_limit > 0 else F.filter("b.tasks", lambda x: F.lit(False))).alias("k", "t")).where("t.id IS NOT NULL")
    arch = some(C("t.arch"))
    t = t.withColumn("task", F.concat(F.lit("albs-task:"), "t.id", F.lit(":"), F.coalesce(arch, F.lit("unknown")))).withColumn("repository", F.concat(F.lit("git:"), some(C("t.ref.url"))))
    t = t.withColumn("commit", F.concat(F.lit("git-commit:"), some(C("t.ref.git_commit_hash"), C("t.alma_commit_cas_hash"))))
    t = t.withColumn("environment", F.when(arch.isNotNull(), F.concat(F.lit("buildenv:"), F.coalesce(some(C("t.platform.name")), F.lit("albs")), F.lit(":"), arch)))
    a = t.select("graph", "build", "release", "task", "k", F.posexplode("t.artifacts").alias("j", "a")).where("a.id IS NOT NULL AND a.name <> ''")
    a = a if logs else a.where("a.type = 'rpm'")
    a = a.withColumn("n", F.row_number().over(Window.partitionBy("graph", "build").orderBy("k", "j"))).where(C("n") <= artifact_limit)
    prefix = F.when(C("a.type") != "rpm", "build-log:").when(F.endswith("a.name", F.lit(".src.rpm")), "srpm:").otherwise("rpm:")
    a = a.withColumn("artifact", F.concat(prefix, "a.id", F.lit(":"), "a.name"))
    sign = b.select("graph", "build", "release", F.explode("b.sign_tasks").alias("x")).withColumn("sign", F.concat(F.lit("albs-sign-task:"), "x.id"))
    test = b.select("graph", "build", F.posexplode("b.test_tasks").alias("k", "x")).where(C("k") < test_task_limit).withColumn("test", F.concat(F.lit("albs-test-task:"), "x.id"))
    edge = lambda df, src, dst, kind: df.select("graph", C(src).alias("src"), C(dst).alias("dst"), F.lit(BUILD_EDGES[kind]).alias("rel"))
    edges = [
        edge(b, "build", "source", "source"), edge(b, "build", "release", "release"), edge(t, "build", "task", "task"), edge(t, "source", "repository", "repository"), edge(t, "task", "commit", "commit"),
        edge(t, "task", "environment", "environment"), edge(a, "task", "artifact", "artifact"), edge(a.where("a.type = 'rpm'"), "artifact", "release", "release"), edge(sign, "build", "sign", "sign"),
        edge(sign, "sign", "release", "release"), edge(test, "build", "test", "test"),
    ]
    every = edges[0]
    for x in edges[1:]:
        every = every.unionByName(x)
    every = every.where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    albs, rpm, git = F.lit("albs"), F.lit("rpm"), F.lit("git")
    of = lambda df, id_, eco, kind, **meta: df.where(C(id_).isNotNull()).select(*node(C("graph"), F.regexp_extract(C(id_), r"^[^:]+:(.*)$", 1), F.lit(""), eco, C(id_), ecosystem=eco, node_type=kind, **meta))
    kind = F.when(C("a.type") != "rpm", "build_log").when(F.endswith("a.name", F.lit(".src.rpm")), "source_rpm").otherwise("binary_rpm")
    nodes = [
        of(b, "build", albs, F.lit("albs_build"), package=C("package"), created_at=C("b.created_at"), finished_at=C("b.finished_at"), released=C("b.released"), release_id=C("b.release_id")),
        of(b, "source", rpm, F.lit("source_package"), package=C("package")), of(b, "release", albs, F.lit("release"), release_id=C("b.release_id")),
        of(t, "task", rpm, F.lit("build_task"), task_id=C("t.id"), status=C("t.status"), arch=C("t.arch"), started_at=C("t.started_at"), finished_at=C("t.finished_at"), platform=C("t.platform.name")),
        of(t, "repository", git, F.lit("git_repository"), url=C("t.ref.url"), package=C("package")), of(t, "commit", git, F.lit("git_commit"), git_ref=C("t.ref.git_ref"), repository=C("t.ref.url")),
        of(t, "environment", rpm, F.lit("build_environment"), platform=C("t.platform.name"), arch=C("t.arch"), arch_list=F.array_join("t.platform.arch_list", ",")),
        of(a, "artifact", F.when(C("a.type") == "rpm", rpm).otherwise(albs), kind, artifact_name=C("a.name"), artifact_type=C("a.type"), href=C("a.href"), cas_hash=C("a.cas_hash")),
        of(sign, "sign", albs, F.lit("sign_task"), status=C("x.status"), stats=C("x.stats")), of(test, "test", albs, F.lit("test_task"), status=C("x.status"), revision=C("x.revision")),
    ]
    placed = [x.withColumn("seq", F.lit(i)) for i, x in enumerate(nodes)]
    return one_per_id(reduce(DataFrame.unionByName, placed)), every


def build_steps(docs: DataFrame, tests: bool = False) -> DataFrame:
    """key (build and task) and json of the statistics of a build's tasks, or of their tests, for npm.flat_steps; docs: rows of `builds`."""
    t = docs.select("build", F.explode("b.tasks").alias("t")).withColumn("key", F.concat("build", F.lit("/"), "t.id"))
    stats = t.select("key", F.explode("t.test_tasks").alias("x")).select("key", F.explode("x.performance_stats").alias("s")) if tests else t.select("key", F.explode("t.performance_stats").alias("s"))
    return stats.where("s.statistics IS NOT NULL").select("key", C("s.statistics").alias("json"))
