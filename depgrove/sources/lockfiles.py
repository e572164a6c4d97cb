"""Lock files with grammars of their own, as data sources: `register(spark)`, then `spark.read.format("cargo-lock").load(path)`.

A row is a package or a dependency between two. Each file is a partition and parsed where it is read, from any file system that pyarrow opens;
a filter for one file or for one kind of rows reaches the reader, which opens no other file and yields no other row. A file is read line by line, and what is held of
it is no more than the rows asked for need. Within a file a package has
one row: later metadata goes over earlier; of several dependencies between the same two the last counts. Rows have the file's own order (seq).
"""

from __future__ import annotations

import io
import re
import tomllib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

C = F.col
#: Fixed value: the rows that go to Spark at once.
BATCH_ROWS = 10_000
SCHEMA = "file string, kind string, seq long, id string, name string, version string, src string, dst string, scope string, constraint string, resolved string, line int, meta map<string,string>"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Names and version of the root of a file that names none.
ROOTS = {"poetry-lock": "poetry-lock", "cargo-lock": "cargo-lock", "yarn-lock": "yarn-lock", "pnpm-lock": "pnpm-lock", "pyproject": "pyproject"}
RESOLVED = "resolved"
ECOSYSTEMS = {"poetry-lock": "pypi", "pyproject": "pypi", "cargo-lock": "cargo", "yarn-lock": "npm", "pnpm-lock": "npm"}
MANAGERS = {"poetry-lock": "poetry", "pyproject": "pyproject", "cargo-lock": "cargo", "yarn-lock": "yarn", "pnpm-lock": "pnpm"}
#: Scopes of groups of requirements, all others are optional.
GROUP_SCOPES = {"dev": "dev", "develop": "dev", "test": "test", "tests": "test", "build": "build"}
DIRECT = {"classification": "direct", "direct_dependency": True, "transitive_dependency": False}
TRANSITIVE = {"classification": "transitive", "direct_dependency": False, "transitive_dependency": True}


class Lock:
    """What a file says: packages by id and dependencies by their ends, in the order in which they come first. Of what is asked for (kind) it holds no more
    than its rows need: for edges no metadata, for nodes no dependencies; metadata is one tuple of names and values."""

    def __init__(self, form: str, file: str, kind: str | None = None, name: str | None = None, version: str | None = None):
        self.form, self.file, self.kind = form, file, kind
        self.common = {"ecosystem": ECOSYSTEMS[form], "source": file.rpartition("/")[2], "package_manager": MANAGERS[form]}
        self.packages: dict[str, tuple[str, str, tuple]] = {}
        self.needs: dict[tuple[str, str], tuple] = {}
        self.needed: set[str] = set()
        self.direct: dict[str, str | None] = {}
        self.alike: dict[tuple, tuple] = {}
        self.root = self.package(name or ROOTS[form], version or RESOLVED, node_type="root", classification="root", direct_dependency=False, transitive_dependency=False, dependency_scope="runtime")

    def package(self, name: str, version: str, id_: str | None = None, **meta: Any) -> str:
        id_ = id_ or f"{name}=={version}"
        known = self.packages.get(id_)
        name, version, said = known or (name, version, ())
        if self.kind == "edge":
            row = ("", version, ("dependency_scope", meta.get("dependency_scope") or dict(_pairs(said)).get("dependency_scope")))
            row = self.alike.setdefault(row, row)
        else:
            meta = {k: v for k, v in meta.items() if v not in (None, "")}
            if "node_type" not in meta and known:
                meta["node_type"] = "package"
            row = (name, version, tuple(x for pair in (dict(_pairs(said)) | meta).items() for x in pair))
        self.packages[id_] = row
        return id_

    def meta(self, id_: str) -> dict:
        own = self.common | {"node_type": "package"} | dict(_pairs(self.packages[id_][2]))
        if id_ in self.direct:
            own |= DIRECT if self.direct[id_] is None else DIRECT | {"dependency_scope": self.direct[id_]}
        return own

    def need(self, src: str, dst: str, scope: str, constraint: str = "", line: int | None = None) -> None:
        self.needed.add(dst)
        if self.kind != "node":
            self.needs[src, dst] = (scope, constraint or None, line)

    def from_root(self, dst: str, scope: str, constraint: str = "", told: str | None = None) -> None:
        """told: the scope that the package's own metadata gets."""
        if self.kind != "edge":
            self.direct[dst] = told or self.direct.get(dst)
        self.need(self.root, dst, scope, constraint)

    def orphans_from_root(self, scope: Callable[[dict], str] = lambda meta: "runtime") -> None:
        for id_ in sorted(x for x in self.packages if x not in self.needed and x != self.root):
            self.from_root(id_, scope(dict(_pairs(self.packages[id_][2]))))

    def rows(self) -> Iterator[tuple]:
        if self.kind in (None, "node"):
            for seq, (id_, (name, version, _)) in enumerate(self.packages.items()):
                yield self.file, "node", seq, id_, name, version, None, None, None, None, None, None, sorted((k, str(v)) for k, v in self.meta(id_).items())
        if self.kind in (None, "edge"):
            for seq, ((src, dst), (scope, constraint, line)) in enumerate(self.needs.items()):
                yield self.file, "edge", seq, None, None, None, src, dst, scope, constraint, self.packages[dst][1] or None, line, None


def _pairs(flat: tuple) -> Iterator[tuple]:
    return zip(flat[::2], flat[1::2])


def _add(found: dict, name: str, version: str, id_: str) -> None:
    """Ids by name and version; a name with one version, as most have, takes no dict."""
    known = found.get(name)
    if isinstance(known, dict):
        known[version] = id_
    elif known is None or known[0] == version:
        found[name] = (version, id_)
    else:
        found[name] = {known[0]: known[1], version: id_}


def _pick(found: dict, name: str, version: str) -> str | None:
    """The id of that version, else the name's only one."""
    known = found.get(name)
    if isinstance(known, dict):
        return known.get(version) or _only(known.values())
    return known[1] if known else None


def _taken(rows: deque) -> Iterator:
    """The rows from the first, each let go of before the next."""
    while rows:
        yield rows.popleft()


def _table(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def _only(ids: Iterable[str]) -> str | None:
    ids = set(ids)
    return ids.pop() if len(ids) == 1 else None


def _named(records: Any) -> list[dict]:
    if not isinstance(records, list):
        raise ValueError("package must be a list of tables")
    return [r for r in records if isinstance(r, dict) and r.get("name") is not None and r.get("version") is not None]


#: Fixed value: the lines that are parsed together, at least.
BLOCK_LINES = 5_000


def _blocks(lines: Iterable[str]) -> Iterator[dict]:
    """A TOML text's tables in blocks that end before a [[package]]. One that cannot be read by itself, as its end lies in a text of several lines, is read
    with what follows; a table must not be named twice within a block only."""
    held: list[str] = []
    least = BLOCK_LINES
    for line in lines:
        if len(held) >= least and line.startswith("[[package]]"):
            try:
                block = tomllib.loads("".join(held))
            except tomllib.TOMLDecodeError:
                least = 2 * len(held)
            else:
                yield block
                held, least = [], BLOCK_LINES
        held.append(line)
    yield tomllib.loads("".join(held))


def _records(lines: Iterable[str]) -> Iterator[dict]:
    return (r for block in _blocks(lines) for r in _named(block.get("package", [])))


def _dashed(name: str, more: str = "") -> str:
    return re.sub(f"[_{more}]", "-", name.lower())


# Poetry, pyproject


def _poetry_scope(record: dict) -> str:
    groups = record.get("groups")
    for group, scope in (("dev", "dev"), ("test", "test"), ("main", "runtime")):
        if isinstance(groups, list) and group in groups:
            return scope
    return "optional" if record.get("optional") else "runtime"


def _stated(value: Any) -> str:
    """The constraint of a Poetry requirement: its version, else where it comes from."""
    return str(next((value[k] for k in ("version", "url", "git", "path") if value.get(k)), "*")) if isinstance(value, dict) else str(value or "*")


def poetry(lines: Iterable[str], file: str, kind: str | None = None) -> Lock:
    lock, ids, wants = Lock("poetry-lock", file, kind), {}, deque()
    for r in _records(lines):
        groups, files = r.get("groups"), r.get("files") if isinstance(r.get("files"), list) else []
        category = r.get("category") or ("main" if isinstance(groups, list) and "main" in groups else None)
        hashes = ",".join(str(f["hash"]) for f in files if isinstance(f, dict) and f.get("hash"))
        name, scope = _dashed(str(r["name"]), "."), _poetry_scope(r)
        ids[name] = lock.package(
            str(r["name"]), str(r["version"]), license=r.get("license"), checksum=hashes, dependency_scope=scope, category=category, groups=groups, optional=r.get("optional"),
            python_versions=r.get("python-versions"), description=r.get("description"), artifact_count=len(files) or None, artifact_type="wheel_or_source_archive" if files else None, **TRANSITIVE,
        )
        wants.extend((name, scope, _dashed(other, "."), _stated(wanted)) for other, wanted in sorted(_table(r.get("dependencies")).items()))
    for name, scope, other, constraint in _taken(wants):
        if target := ids.get(other):
            lock.need(ids[name], target, scope, constraint)
    lock.orphans_from_root(lambda meta: meta.get("dependency_scope", "runtime"))
    return lock


REQUIREMENT = re.compile(r"(?P<name>[^\[;@=~!<>]+)(?:\[(?P<extras>[^\]]*)\])?\s*(?:@\s*(?P<url>\S+)|(?P<constraint>(?:===|==|~=|!=|<=|>=|<|>).*))?")
ARTIFACTS = {".whl": "wheel", ".tar.gz": "source_archive", ".zip": "source_archive", ".tgz": "source_archive"}


def _exact(constraint: str) -> str:
    found = re.match(r"===?\s*(.*)$", constraint)
    return found[1] if found else ""


def pyproject(lines: Iterable[str], file: str, kind: str | None = None) -> Lock:
    doc = tomllib.loads("".join(lines))
    project, tool = _table(doc.get("project")), _table(_table(doc.get("tool")).get("poetry"))
    lock = Lock("pyproject", file, kind, str(tool.get("name") or project.get("name") or ROOTS["pyproject"]), str(tool.get("version") or project.get("version") or "0.0.0"))
    scope_of = lambda group: GROUP_SCOPES.get(group.lower(), "optional")
    found = []  # scope, name, constraint, url, extras, marker
    listed = [("runtime", project.get("dependencies"))] + [(scope_of(g), rows) for g, rows in _table(project.get("optional-dependencies")).items()]
    for scope, rows in listed:
        for row in rows if isinstance(rows, list) else ():
            body, _, marker = str(row).partition(";")
            if m := REQUIREMENT.match(body.strip()):
                found.append((scope, _dashed(m["name"].strip(), "."), (m["url"] or m["constraint"] or "").strip(), m["url"] or "", m["extras"] or "", marker.strip()))
    tables = [("runtime", tool.get("dependencies"))] + [(scope_of(g), _table(x).get("dependencies")) for g, x in _table(tool.get("group")).items()]
    for scope, table in tables:
        for name, value in _table(table).items():
            if name.lower() != "python":
                where = next((str(value[k]) for k in ("url", "git", "path") if value.get(k)), "") if isinstance(value, dict) else ""
                extras = value.get("extras") if isinstance(value, dict) else None
                found.append((scope, _dashed(name, "."), _stated(value), where, ",".join(map(str, extras)) if isinstance(extras, list) else "", ""))
    del doc, project, tool, listed, tables
    found.sort(key=lambda r: r[:2])
    for scope, name, constraint, url, extras, marker in found:
        artifact = next((v for end, v in ARTIFACTS.items() if url.lower().endswith(end)), None)
        version = _exact(constraint)
        id_ = lock.package(name, version, f"{name}=={version or constraint or 'unresolved'}", constraint=constraint, source_url=url, extras=extras.replace(" ", ""), marker=marker, artifact_type=artifact, dependency_scope=scope)
        lock.from_root(id_, scope, constraint)
    return lock


# Cargo


def cargo(lines: Iterable[str], file: str, kind: str | None = None) -> Lock:
    lock, versions, wants = Lock("cargo-lock", file, kind), {}, deque()
    for r in _records(lines):
        source = str(r.get("source") or "")
        id_ = lock.package(
            str(r["name"]), str(r["version"]), source_url=re.sub(r"^(registry|git)\+", "", source), checksum=r.get("checksum"), provenance=source, cargo_source=source, cargo_checksum=r.get("checksum"),
            git_dependency=True if source.startswith("git+") or ".git" in source else None, dependency_scope="runtime", **TRANSITIVE,
        )
        _add(versions, _dashed(str(r["name"])), str(r["version"]), id_)
        wants.extend((id_, wanted) for wanted in sorted(map(str, r.get("dependencies") or ())))
    for id_, wanted in _taken(wants):
        name, version, *_ = [*wanted.split(), "", ""]
        if target := _pick(versions, _dashed(name), version):
            lock.need(id_, target, "runtime", version)
    lock.orphans_from_root()
    return lock


# Yarn, pnpm


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _split_at(key: str) -> tuple[str, str]:
    """Name and what follows the @ that is not the first character."""
    at = key.rfind("@") if not key.startswith("@") else key.find("@", key.find("/"))
    return (key[:at], key[at + 1 :]) if at > 0 else (key, "")


def _yarn_entries(lines: Iterable[str]) -> Iterator[dict]:
    entry, block = None, None
    for number, line in enumerate((x for line in lines for x in line.splitlines()), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] not in " \t":
            keys = [_bare(k) for k in re.findall(r"(?:'[^']*'|\"[^\"]*\"|[^,])+", line.rstrip()[:-1])] if line.rstrip().endswith(":") else []
            if keys:
                if entry:
                    yield entry
                entry = {"keys": keys, "name": _split_at(keys[0])[0], "line": number, "fields": {}, "needs": {}}
            block = None
        elif entry:
            name, _, value = line.strip().partition(" ")
            name, value = _bare(name.rstrip(":")), _bare(value)
            if not line.startswith("    "):
                block = name
                entry["fields"][name] = value
            elif block == "dependencies":
                entry["needs"][name] = value
    if entry:
        yield entry


def yarn(lines: Iterable[str], file: str, kind: str | None = None) -> Lock:
    lock, ids, by_name, wants = Lock("yarn-lock", file, kind), {}, {}, deque()
    for e in _yarn_entries(lines):
        version = e["fields"].get("version") or "0.0.0"
        id_ = lock.package(
            e["name"], version, source_url=e["fields"].get("resolved"), checksum=e["fields"].get("integrity"), resolved=e["fields"].get("resolved"), integrity=e["fields"].get("integrity"),
            lockfile_format="yarn-lock", package_path=f"yarn:{e['keys'][0]}", source_line=e["line"], dependency_scope="runtime", **TRANSITIVE,
        )
        ids |= dict.fromkeys(e["keys"], id_)
        _add(by_name, e["name"], id_, id_)
        wants.extend((id_, name, wanted, e["line"]) for name, wanted in sorted(e["needs"].items()))
    for id_, name, wanted, line in _taken(wants):
        if target := ids.get(f"{name}@{wanted}") or _pick(by_name, name, ""):
            lock.need(id_, target, "runtime", wanted, line)
    lock.orphans_from_root()
    return lock


def _value(text: str) -> Any:
    text = _bare(text)
    if text.startswith("{") and text.endswith("}"):
        return {_bare(k): _value(v) for k, _, v in (part.partition(":") for part in text[1:-1].split(",")) if k.strip()}
    return {"true": True, "false": False}.get(text.lower(), text)


KEY = re.compile(r"((?:'[^']*'|\"[^\"]*\"|[^:'\"])+):?(.*)$")


def _outline(lines: Iterable[str]) -> Iterator[tuple[str, str | None, Any]]:
    """Keys by indentation, as far as lock files use it: mappings and scalars. Gives each entry of a top mapping when it is complete (the mapping's key, its own
    key, its value), before them their mapping with key None, where it begins. Where a key stands is kept under its path in ''."""
    open_: list[tuple[int, str, dict]] = []  # depth, key, what is in it; a top mapping's entries are given and not kept
    for number, line in enumerate((x for line in lines for x in line.splitlines()), 1):
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, m = len(line) - len(line.lstrip(" ")), KEY.match(line.strip())
        if m is None:
            continue
        while open_ and depth <= open_[-1][0]:
            _, key, inner = open_.pop()
            if len(open_) == 1:
                yield open_[0][1], key, inner
        key, value = _bare(m[1]), _value(m[2]) if m[2].strip() else {"": number}
        if not open_:
            yield key, None, value
        elif len(open_) > 1:
            open_[-1][2][key] = value
        elif m[2].strip():
            yield open_[0][1], key, value
        if not m[2].strip():
            open_.append((depth, key, value))
    if len(open_) > 1:
        yield open_[0][1], open_[1][1], open_[1][2]


def _items(value: Any) -> list[tuple[str, Any]]:
    return sorted((k, v) for k, v in _table(value).items() if k)


def _slim(value: Any, kind: str | None) -> tuple:
    """Of a package's entry: where it stands, its lists of needs, and for its metadata where it is from, its digest and licence."""
    value = _table(value)
    found = _table(value.get("resolution")) if kind != "edge" else {}
    needs = tuple((f, tuple(_items(value[f]))) for f in PNPM_FIELDS if value.get(f) is not None)
    return value.get(""), needs, (found.get("tarball"), found.get("integrity"), value.get("license")) if kind != "edge" else None


PNPM_FIELDS = {"dependencies": "runtime", "optionalDependencies": "optional", "peerDependencies": "peer"}


def pnpm(lines: Iterable[str], file: str, kind: str | None = None) -> Lock:
    lock = Lock("pnpm-lock", file, kind)
    doc: dict[str, dict] = {"packages": {}, "snapshots": {}, "importers": {}}
    for top, key, value in _outline(lines):
        if top in doc and key is None:
            doc[top] = {k: v if top == "importers" else _slim(v, kind) for k, v in _table(value).items() if k}
        elif top in doc and key:
            doc[top][key] = value if top == "importers" else _slim(value, kind)
    packages, snapshots = doc["packages"], doc["snapshots"]
    entries, versions, nothing = deque(), {}, (None, (), (None, None, None))
    for key in sorted(packages.keys() | snapshots.keys()):
        own, more = packages.pop(key, nothing), snapshots.pop(key, nothing)
        name, version = _split_at(key.lstrip("/").split("(")[0])
        if not version:
            continue
        needs = dict(own[1]) | dict(more[1])
        tarball, integrity, license_ = own[2] or nothing[2]
        peers = ",".join(k for k, _ in needs.get("peerDependencies", ()))
        line = more[0] if own[0] is None else own[0]
        id_ = lock.package(
            name, version, source_url=tarball, checksum=integrity, resolved=tarball, integrity=integrity, license=license_, lockfile_format="pnpm-lock",
            package_path=f"pnpm:{key}", source_line=line, peer_dependencies=peers, dependency_scope="runtime", **TRANSITIVE,
        )
        _add(versions, name, version, id_)
        if needs:
            entries.append((id_, tuple((f, needs[f]) for f in PNPM_FIELDS if f in needs), line))

    def target(name: str, wanted: Any) -> str | None:
        version = str((wanted.get("version") or wanted.get("specifier") or "") if isinstance(wanted, dict) else wanted).split("(")[0]
        return _pick(versions, name, version)

    said = lambda wanted: str(wanted.get("specifier") or wanted.get("version") or "") if isinstance(wanted, dict) else str(wanted)
    for id_, needs, line in _taken(entries):
        for field, listed_ in needs:
            for name, wanted in listed_:
                if to := target(name, wanted):
                    lock.need(id_, to, PNPM_FIELDS[field], said(wanted), line)
    direct = False
    for _, importer in _items(doc["importers"]):
        for field, scope in {"dependencies": "runtime", "optionalDependencies": "optional", "devDependencies": "dev"}.items():
            for name, wanted in _items(_table(importer).get(field)):
                if to := target(name, wanted):
                    direct = True
                    lock.from_root(to, scope, said(wanted), told=scope)
    if not direct:
        lock.orphans_from_root()
    return lock


PARSERS: dict[str, Callable[[Iterable[str], str, str | None], Lock]] = {"poetry-lock": poetry, "cargo-lock": cargo, "yarn-lock": yarn, "pnpm-lock": pnpm, "pyproject": pyproject}


class FilePart(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The file, or the files of the folder and its folders whose names do not begin with a dot or underscore."""
    from pyarrow import fs

    system, root = _opened(path)
    found = system.get_file_info(root)
    if found.type == fs.FileType.File:
        return [path]
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    return sorted(path.rstrip("/") + f[len(root.rstrip("/")) :] for f in inside if not re.search(r"/[._]", f[len(root.rstrip("/")) :]))


class LockReader(DataSourceReader):
    def __init__(self, form: str, path: str):
        self.form, self.path, self.file, self.kind = form, path, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.file = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kind = f.value
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        return [FilePart(f) for f in listed(self.path) if self.file in (None, f)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        system, path = _opened(partition.uri)
        with io.TextIOWrapper(system.open_input_stream(path), "utf-8", newline="\n") as lines:
            lock = PARSERS[self.form](lines, partition.uri, self.kind)
        kinds = {"seq": pa.int64(), "line": pa.int32(), "meta": pa.map_(pa.string(), pa.string())}
        rows = lock.rows()
        while some := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for n, c in zip(NAMES, zip(*some))], NAMES)


class LockSource(DataSource):
    form = ""

    @classmethod
    def name(cls) -> str:
        return cls.form

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LockReader:
        return LockReader(self.form, self.options["path"])


class PoetryLock(LockSource):
    form = "poetry-lock"


class CargoLock(LockSource):
    form = "cargo-lock"


class YarnLock(LockSource):
    form = "yarn-lock"


class PnpmLock(LockSource):
    form = "pnpm-lock"


class Pyproject(LockSource):
    form = "pyproject"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets filters reach readers in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (PoetryLock, CargoLock, YarnLock, PnpmLock, Pyproject):
        spark.dataSource.register(source)


def _loader(form: str):
    def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        register(spark)
        rows = spark.read.format(form).load(path)
        ecosystem = F.lit(ECOSYSTEMS[form]).alias("ecosystem")
        nodes = rows.where("kind = 'node'").select(C("file").alias("graph"), "id", "name", "version", ecosystem, "meta", "seq")
        edges = rows.where("kind = 'edge'").select(C("file").alias("graph"), "src", "dst", F.lit(1).alias("rel"), "scope", "constraint", "resolved", "line", "seq")
        return nodes, edges

    return load


poetry_lock, cargo_lock, yarn_lock, pnpm_lock = map(_loader, ("poetry-lock", "cargo-lock", "yarn-lock", "pnpm-lock"))
pyproject_file = _loader("pyproject")
