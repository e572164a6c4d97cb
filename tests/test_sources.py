"""Loaders on small files written by the tests."""

import json

import pytest

from pyspark.sql import functions as F

from depgrove import sources
from depgrove.operators import joins, npm, query, reports
from depgrove.sources import lockfiles, tables

C = F.col


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def shape(found):
    nodes, edges = found
    return sorted(r.id for r in nodes.collect()), sorted((r.src, r.dst, r.rel) for r in edges.collect())


def test_requirements(spark, tmp_path):
    path = put(tmp_path, "dev-needs.txt", '# tools\nFab_Ric==3.1 --hash=sha256:0f\nocto.kit[net, tls]~=0.9; sys_platform != "win32"\nplough @ https://mirror.test/plough-4.tgz\n-c pins.txt\n--index-url https://mirror.test\n')
    rows = {r.name: r for r in tables.requirements(spark, path).collect()}
    assert set(rows) == {"fab-ric", "octo-kit", "plough"}
    assert rows["fab-ric"].constraint == "==3.1" and rows["fab-ric"].hash == "sha256:0f"
    assert rows["octo-kit"].constraint == "~=0.9" and rows["octo-kit"].extras == "net, tls" and rows["octo-kit"].marker == 'sys_platform != "win32"'
    assert rows["plough"].url == "https://mirror.test/plough-4.tgz" and {r.scope for r in rows.values()} == {"dev"}
    ids, edges = shape(sources.load(spark, "requirements", path))
    assert ids == ["dev-needs==resolved", "fab-ric==3.1", "octo-kit==~=0.9", "plough==https://mirror.test/plough-4.tgz"] and len(edges) == 3


def test_maven_tree(spark, tmp_path):
    path = put(tmp_path, "tree.txt", "[INFO] g:app:jar:1.0\n[INFO] +- g:lib:jar:1.2:compile (optional)\n[INFO] |  \\- g:base:jar:linux:2.0:runtime\n[INFO] \\- (g:old:pom:1.0:compile - omitted for conflict with 2.0)\n")
    ids, edges = shape(tables.maven_tree(spark, path))
    assert ids == ["g:app==1.0", "g:base:linux==2.0", "g:lib==1.2", "g:old:pom==1.0"]
    assert edges == [("g:app==1.0", "g:lib==1.2", 2), ("g:app==1.0", "g:old:pom==1.0", 3), ("g:lib==1.2", "g:base:linux==2.0", 1)]


def test_dot(spark, tmp_path):
    path = put(tmp_path, "g.dot", 'digraph g {\n"a" -> {\n"b"\n"c"\n}\n// "x" -> "y"\n"b" -> "c==1"\n}')
    assert shape(tables.dot(spark, path))[1] == [("a==unknown", "b==unknown", 1), ("a==unknown", "c==unknown", 1), ("b==unknown", "c==1", 1)]


def test_transaction(spark, tmp_path):
    path = put(tmp_path, "t.txt", "# plan\nInstall: kiln-tools-2:1.4-3.x86_64.rpm\nupgrade mill-1-1.noarch -> mill-2-1.noarch\nkeep x\nerase odd name\n")
    first, second, third = tables.transaction(spark, path).orderBy("idx").collect()
    assert (first.action, first.package.node, first.package.epoch, first.package.purl) == ("install", "kiln-tools==1.4-3.x86_64", "2", "pkg:rpm/kiln-tools@1.4-3?arch=x86_64&epoch=2")
    assert (second.idx, second.old.node, second.new.node, second.package) == (2, "mill==1-1.noarch", "mill==2-1.noarch", None)
    assert (third.package.name, third.package.arch, third.package.node, third.package.version) == ("odd name", "unknown", "odd name", "")


def test_cyclonedx_and_snapshot(spark, tmp_path):
    bom = {"metadata": {"component": {"name": "app", "version": "0"}}, "components": [{"bom-ref": "a==1", "name": "a", "version": "1", "purl": "pkg:npm/a@1"}, {"bom-ref": "b==2", "name": "b", "version": "2", "properties": [{"name": "depgrove:arch", "value": "any"}, {"name": "x", "value": "y"}], "licenses": [{"license": {"name": "MIT"}}]}], "dependencies": [{"ref": "a==1", "dependsOn": ["b==2", "c==3"]}]}
    nodes, edges = tables.cyclonedx(spark, put(tmp_path, "bom.json", json.dumps(bom)))
    assert {r.id: r.ecosystem for r in nodes.collect()} == {"a==1": "npm", "b==2": "generic", "app==0": "npm", "c==3": "npm"}
    assert {r.id: r.meta for r in nodes.collect()}["b==2"] == {"license": "MIT", "arch": "any", "x": "y"}
    snap = {"ecosystem": "npm", "nodes": [{"id": "a==1", "name": "a", "version": "1", "metadata": {"k": "v"}}], "edges": [{"source": "a==1", "target": "a==1", "relationshipType": 2}]}
    assert shape(sources.load(spark, "snapshot", put(tmp_path, "snap.json", json.dumps(snap)))) == (["a==1"], [("a==1", "a==1", 2)])


def test_package_lock(spark, tmp_path):
    lock = {"packages": {"": {"name": "app", "version": "1", "dependencies": {"shared": "^1", "tool": "^1", "gone": "^9"}}, "node_modules/shared": {"version": "1"}, "node_modules/tool": {"version": "1", "dependencies": {"shared": "^2"}}, "node_modules/tool/node_modules/shared": {"version": "2"}}}
    nodes, edges, missing = tables.package_lock(spark, put(tmp_path, "lock.json", json.dumps(lock)))
    assert shape((nodes, edges)) == (["app==1", "shared==1", "shared==2", "tool==1"], [("app==1", "shared==1", 1), ("app==1", "tool==1", 1), ("tool==1", "shared==2", 1)])
    assert [r.dep for r in missing.collect()] == ["gone"]
    assert [r.searched for r in npm.searched_paths(missing).collect()] == [["node_modules/gone"]]
    deep = spark.createDataFrame([("node_modules/a/node_modules/@s/b", "c")], "path string, dep string")
    assert npm.searched_paths(deep).first().searched == ["node_modules/a/node_modules/@s/b/node_modules/c", "node_modules/a/node_modules/c", "node_modules/c"]
    row = npm.diagnostics(tables.locked_packages(spark, str(tmp_path / "lock.json")), edges, missing).first()
    assert (row.packages, row.duplicates, row.conflicts, row.unresolved) == (4, 1, 1, 1)


def test_package_at_several_paths(spark, tmp_path):
    """One node, whose metadata is that of all paths, later over earlier; diagnostics count the paths."""
    at = {"": {"name": "app", "version": "1", "dependencies": {"a": "1", "b": "1"}}, "node_modules/a": {"version": "1"}, "node_modules/a/node_modules/c": {"version": "2", "integrity": "first", "license": "MIT"}, "node_modules/b": {"version": "1"}, "node_modules/b/node_modules/c": {"version": "2", "integrity": "second"}, "node_modules/c": {"version": "1"}}
    path = put(tmp_path, "package-lock.json", json.dumps({"packages": at}))
    nodes, edges, missing = tables.package_lock(spark, path)
    c = {r.id: r for r in nodes.collect()}["c==2"]
    assert nodes.count() == 5 and (c.meta["integrity"], c.meta["license"], c.meta["package_path"], c.seq) == ("second", "MIT", "node_modules/b/node_modules/c", 2)
    row = npm.diagnostics(tables.locked_packages(spark, path), edges, missing).first()
    assert (row.packages, row.duplicates, row.conflicts, row.unresolved) == (6, 1, 0, 0)


def test_package_lock_metadata(spark, tmp_path):
    lock = {"name": "app", "version": "1", "scripts": {"install": "x", "test": "y"}, "packages": {"": {"name": "app", "version": "1", "peerDependencies": {"@s/p": "2"}, "devDependencies": {"@s/p": "1", "g": "*"}}, "node_modules/@s/p": {"version": "2", "resolved": "https://registry.npmjs.org/p.tgz", "integrity": "sha", "peerDependencies": {"z": "1", "y": "1"}}, "node_modules/g": {"version": "git+ssh://h/g.git", "dev": True, "hasInstallScript": True}, "node_modules/link": {"link": True}}}
    nodes, edges, _ = tables.package_lock(spark, put(tmp_path, "package-lock.json", json.dumps(lock)))
    meta = {r.id: r.meta for r in nodes.collect()}
    assert set(meta) == {"app==1", "@s/p==2", "g==git+ssh://h/g.git"}
    assert (meta["app==1"]["node_type"], meta["app==1"]["lifecycle_scripts"], meta["app==1"]["install_scripts"]) == ("root", "install,test", "install")
    p, g = meta["@s/p==2"], meta["g==git+ssh://h/g.git"]
    assert (p["remote_tarball_domain"], p["peer_dependencies"], p["classification"], p.get("git_dependency")) == ("registry.npmjs.org", "y,z", "direct", None)
    assert (g["dependency_scope"], g["git_dependency"], g["has_install_script"]) == ("dev", "True", "True")
    assert {(r.dst, r.scope, r.constraint, r.target_path) for r in edges.collect()} == {("@s/p==2", "peer", "2", "node_modules/@s/p"), ("g==git+ssh://h/g.git", "dev", "*", "node_modules/g")}
    counters = npm.summary(nodes, edges).first()
    assert (counters.packages, counters.dependencies, counters.packagesWithoutIntegrity, counters.gitBasedDependencies, counters.devOnlyPackages, counters.peerDependencyWarnings, counters.directDependencies) == (2, 2, 1, 1, 1, 3, 2)
    assert sorted((r.finding, r.id) for r in npm.surface(nodes).collect()) == [("gitBasedDependencies", "g==git+ssh://h/g.git"), ("installScriptPackages", "g==git+ssh://h/g.git"), ("packagesWithoutIntegrity", "g==git+ssh://h/g.git")]


def test_nested_lock(spark, tmp_path):
    lock = {"name": "old", "version": "3", "dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2", "optional": True, "dependencies": {"c": {"version": "4"}}}}}, "b": {"version": "1"}}}
    found = sources.load(spark, "npm-lock", put(tmp_path, "package-lock.json", json.dumps(lock)))
    assert shape(found) == (["a==1", "b==1", "b==2", "c==4", "old==3"], [("a==1", "b==2", 1), ("b==2", "c==4", 1), ("old==3", "a==1", 1), ("old==3", "b==1", 1)])
    nodes, edges = sources.load_graph(spark, "npm-lock", put(tmp_path, "package-lock.json", json.dumps(lock)))
    assert sorted(r.package for r in query.run(nodes, edges, "reachable", "old").collect()) == ["a==1", "b==1", "b==2", "c==4"]
    assert [r.package for r in query.run(nodes, edges, "path", "old==3", "c").orderBy("position").collect()] == ["old==3", "a==1", "b==2", "c==4"]
    with pytest.raises(ValueError, match="Ambiguous node selector 'b'"):
        query.run(nodes, edges, "dependents", "b")


def test_package_json_and_registry(spark, tmp_path):
    path = put(tmp_path, "package.json", json.dumps({"name": "app", "version": "1", "dependencies": {"a": "^1"}, "devDependencies": {"a": "^2", "b": "*"}}))
    assert shape(tables.package_json(spark, path)) == (["a==^2", "app==1", "b==*"], [("app==1", "a==^2", 1), ("app==1", "b==*", 1)])
    rows = tables.registry(spark, put(tmp_path, "r.json", json.dumps({"a": {"1": {"dependencies": {"b": "*"}}, "2": {}, "3": {"dependencies": [{"name": "c", "constraint": "^1"}, {"name": "d"}]}}}))).collect()
    assert sorted((r.name, r.version, r.dependencies) for r in rows) == [("a", "1", {"b": "*"}), ("a", "2", {}), ("a", "3", {"c": "^1", "d": "*"})]


def test_rpm_repository(spark, tmp_path):
    entry = lambda names: "".join(f'<rpm:entry name="{n}"/>' for n in names)
    package = lambda n, gives, wants: f'<package type="rpm"><name>{n}</name><arch>x86_64</arch><version epoch="0" ver="1" rel="2"/><format><rpm:license>MIT</rpm:license><rpm:sourcerpm>s.src.rpm</rpm:sourcerpm><rpm:provides>{entry(gives)}</rpm:provides><rpm:requires>{entry(wants)}</rpm:requires></format></package>'
    text = '<metadata xmlns="http://x" xmlns:rpm="http://y">' + package("a", ["cap"], ["b", "cap", "rpmlib(x)"]) + package("b", ["lib"], ["cap", "none"]) + "</metadata>"
    ids, edges = shape(tables.rpm_repository(spark, put(tmp_path, "primary.xml", text)))
    assert ids == ["a==1-2.x86_64", "b==1-2.x86_64", "rpm-capability:cap", "rpm-capability:none"]
    repomd = put(tmp_path, "repomd.xml", '<repomd xmlns="http://z"><data type="filelists"><location href="f.xml"/></data><data type="primary"><location href="primary.xml"/></data></repomd>')
    assert shape(tables.rpm_repository(spark, repomd)) == (ids, edges)
    assert shape(tables.rpm_repository(spark, repomd, package_limit=1))[0] == ["a==1-2.x86_64", "rpm-capability:b", "rpm-capability:cap"]
    assert edges == [("a==1-2.x86_64", "b==1-2.x86_64", 30), ("a==1-2.x86_64", "rpm-capability:cap", 31), ("b==1-2.x86_64", "a==1-2.x86_64", 30), ("b==1-2.x86_64", "rpm-capability:none", 31)]


def test_installed(spark, tmp_path):
    path = put(tmp_path, "i.tsv", "bash\t0\t5.1-2\tx86_64\tV\tGPL\tbash.src.rpm\t1\n" + "glibc\t2.34-1\tx86_64\n")
    assert sorted((r.id, r.license) for r in tables.installed_rpms(spark, path).collect()) == [("bash==5.1-2", "GPL"), ("glibc==2.34-1", None)]


def test_installed_graph(spark, tmp_path):
    path = put(tmp_path, "i.tsv", "quern\t1\t2-1\tx86_64\tV\tGPL\tquern.src.rpm\t1\nsieve\t2-3\tnoarch\n")
    packages = tables.installed_rpms(spark, path)
    wants = spark.createDataFrame([("quern", 0, "rpmlib(a)"), ("quern", 1, "flour"), ("quern", 2, "stone"), ("sieve", 0, "flour")], "name string, position int, cap string")
    gives = spark.createDataFrame([("flour", 0, "sieve==2-3"), ("flour", 1, "quern==2-1"), ("stone", 0, "quern==2-1")], "cap string, position int, id string")
    ids, edges = shape(tables.installed_graph(packages, wants, gives))
    assert ids == ["quern==2-1", "rpm-installed==local", "sieve==2-3"]
    assert edges == [("quern==2-1", "sieve==2-3", 1), ("rpm-installed==local", "quern==2-1", 1), ("rpm-installed==local", "sieve==2-3", 1)]


def test_advisories(spark, tmp_path):
    rows = tables.advisories(spark, put(tmp_path, "a.json", json.dumps({"advisories": [{"id": "A", "package": "x", "versions": ["1"]}, {"id": "B", "packageId": "pkg:npm/%40s/p@1?x=y", "version": "1", "ranges": [{"lastAffected": "3"}]}]}))).orderBy("id").collect()
    assert [(r.id, r.package, r.versions, r.purls) for r in rows] == [("A", "x", ["1"], []), ("B", "pkg:npm/%40s/p@1?x=y", ["1"], ["pkg:npm/@s/p@1?x=y", "pkg:npm/@s/p@1"])]
    assert rows[1].ranges[0].last_affected == "3"
    with pytest.raises(Exception, match="each advisory must name"):
        tables.advisories(spark, put(tmp_path, "b.json", json.dumps([{"id": "C"}]))).collect()
    feed = {"CVE_Items": [{"id": "O", "database_specific": {"severity": "high"}, "affected": [{"package": {"ecosystem": "NPM", "name": "x"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.5"}, {"introduced": "2"}]}]}, {"package": {"ecosystem": "pypi", "name": "z"}}]}, {"cve": {"CVE_data_meta": {"ID": "CVE-1"}}, "purl": "pkg:npm/%40s/q@2", "severity": [{"type": "V3", "score": "7.5"}], "details": "d"}]}
    found = tables.osv_feed(spark, put(tmp_path, "f.json", json.dumps(feed)), "npm").orderBy("id").collect()
    assert [(r.id, r.package, r.severity, [(x.introduced, x.fixed) for x in r.ranges or []]) for r in found] == [("CVE-1", "@s/q", "7.5", []), ("O", "x", "high", [("0", "1.5"), ("2", None)])]
    nodes = spark.createDataFrame([("x==1.4", "npm", {}), ("x==1.5", "npm", {}), ("x==2.1", "pypi", {}), ("q==2", "npm", {"purl": "pkg:npm/%40s/q@2?a=b"})], "id string, ecosystem string, meta map<string,string>")
    hits = joins.advisory_matches(tables.osv_feed(spark, str(tmp_path / "f.json"), "npm"), joins.advisory_packages(nodes))
    assert sorted((r.severity, r.id) for r in hits.collect()) == [("7.5", "q==2"), ("high", "x==1.4")]


def test_build(spark, tmp_path):
    doc = {"id": 7, "release_id": 3, "created_at": "2024-01-01T00:00:00", "finished_at": "2024-01-01T00:01:30.5", "tasks": [{"id": 1, "arch": "x86_64", "status": 4, "platform": {"name": "P", "arch_list": ["x86_64", "s390x"]}, "started_at": "2024-01-01 00:00:00", "finished_at": "2024-01-01 00:00:20", "ref": {"url": "https://g.test/rpms/quern.git", "git_commit_hash": "c"}, "performance_stats": [{"statistics": {"all": {"build": {"delta": "0:00:05.5"}}}}], "test_tasks": [{"performance_stats": [{"statistics": {"t": {"delta": 2}}}]}], "artifacts": [{"id": 5, "name": "a-1-1.x86_64.rpm", "type": "rpm"}, {"id": 6, "name": "l.log", "type": "build_log"}]}], "sign_tasks": [{"id": 2, "started_at": "x"}], "test_tasks": [{"id": 9}]}
    path = put(tmp_path, "b.json", json.dumps(doc))
    ids, edges = shape(tables.build(spark, path))
    assert ids == ["albs-build:7", "albs-release:3", "albs-sign-task:2", "albs-task:1:x86_64", "albs-test-task:9", "buildenv:P:x86_64", "git-commit:c", "git:https://g.test/rpms/quern.git", "rpm:5:a-1-1.x86_64.rpm", "source:quern"]
    assert sorted(r for *_, r in edges) == [20, 21, 22, 23, 24, 25, 26, 27, 28, 28, 28]
    assert "build-log:6:l.log" in shape(tables.build(spark, path, logs=True))[0] and len(shape(tables.build(spark, path, artifact_limit=0))[0]) == 9
    b = tables.builds(spark, path)
    assert [(r.step, r.seconds) for r in npm.flat_steps(tables.build_steps(b)).collect()] == [("all.build", 5.5)]
    assert [(r.step, r.seconds) for r in npm.flat_steps(tables.build_steps(b, tests=True)).collect()] == [("t", 2.0)]
    t = b.select("build", F.explode("b.tasks").alias("t"))
    rows = reports.completeness(b.select("build", "b.released", F.size("b.sign_tasks").alias("sign_tasks"), F.size("b.test_tasks").alias("test_tasks")), t.select("build", "t.arch", "t.status", "t.platform.arch_list"))
    row = rows.first()
    assert (row.expected, row.missing, row.failed, row.unsigned, row.untested) == ("x86_64,s390x", "s390x", 1, False, False)
    times = reports.timing_summary(b.select("build", C("b.created_at").alias("created"), C("b.finished_at").alias("finished")), t.select("build", C("t.started_at").alias("started"), C("t.finished_at").alias("finished")), b.select("build", F.explode("b.sign_tasks").alias("x")).select("build", C("x.started_at").alias("started"), C("x.finished_at").alias("finished")), t.select("build", F.explode("t.artifacts").alias("a")).select("build"))
    row = times.first()
    assert (row.seconds, row.build_seconds, row.build_longest, row.sign_tasks, row.sign_seconds, row.artifacts) == (90.5, 20.0, 20.0, 1, 0.0, 2)


def lock_rows(found):
    nodes, edges = found
    return {r.id: r.meta for r in nodes.collect()}, {(r.src, r.dst): (r.scope, r.constraint, r.resolved) for r in edges.collect()}


def test_poetry_lock(spark, tmp_path):
    text = """[[package]]
name = "A_b"
version = "1"
groups = ["main"]
files = [{file = "a.whl", hash = "sha256:1"}, {file = "a.tgz", hash = "sha256:2"}]
[package.dependencies]
"c.d" = {version = ">=2", optional = true}
gone = "*"
[[package]]
name = "c-d"
version = "2"
optional = true
[[package]]
name = "no version"
"""
    nodes, edges = lock_rows(lockfiles.poetry_lock(spark, put(tmp_path, "poetry.lock", text)))
    assert set(nodes) == {"poetry-lock==resolved", "A_b==1", "c-d==2"}
    assert edges == {("A_b==1", "c-d==2"): ("runtime", ">=2", "2"), ("poetry-lock==resolved", "A_b==1"): ("runtime", None, "1")}
    assert nodes["A_b==1"] | {"checksum": "sha256:1,sha256:2", "artifact_count": "2", "category": "main", "classification": "direct", "package_manager": "poetry", "source": "poetry.lock"} == nodes["A_b==1"]
    assert nodes["c-d==2"]["dependency_scope"] == "optional" and nodes["c-d==2"]["classification"] == "transitive"


def test_cargo_lock(spark, tmp_path):
    text = '[[package]]\nname = "a"\nversion = "1"\ndependencies = ["b 2", "foo-Bar", "two"]\n' + "".join(f'[[package]]\nname = "{n}"\nversion = "{v}"\nsource = "{s}"\nchecksum = "{v}{v}"\n' for n, v, s in (("b", 1, "registry+https://r"), ("b", 2, "git+https://h/b.git"), ("foo_bar", 3, ""), ("two", 1, ""), ("two", 2, "")))
    nodes, edges = lock_rows(lockfiles.cargo_lock(spark, put(tmp_path, "Cargo.lock", text)))
    assert edges == {("a==1", "b==2"): ("runtime", "2", "2"), ("a==1", "foo_bar==3"): ("runtime", None, "3")} | {("cargo-lock==resolved", f"{n}=={v}"): ("runtime", None, str(v)) for n, v in (("a", 1), ("b", 1), ("two", 1), ("two", 2))}
    assert nodes["b==2"]["git_dependency"] == "True" and nodes["b==2"]["source_url"] == "https://h/b.git" and nodes["b==1"]["checksum"] == "11"


def test_pyproject(spark, tmp_path):
    text = """[project]
name = "plain"
dependencies = ["A_b[x, y] >= 1 ; python_version > '3'", "pin==2.0", "here @ https://h/x.whl"]
[project.optional-dependencies]
dev = ["tool"]
docs = ["sphinx<9"]
[tool.poetry]
name = "Own_Name"
version = "7"
[tool.poetry.dependencies]
python = "^3"
web = {version = "^2", extras = ["z"]}
[tool.poetry.group.test.dependencies]
probe = {git = "https://h/p.git"}
"""
    nodes, edges = lock_rows(sources.load(spark, "pyproject", put(tmp_path, "pyproject.toml", text)))
    root = "Own_Name==7"
    assert edges == {
        (root, "a-b==>= 1"): ("runtime", ">= 1", None), (root, "pin==2.0"): ("runtime", "==2.0", "2.0"), (root, "here==https://h/x.whl"): ("runtime", "https://h/x.whl", None), (root, "tool==unresolved"): ("dev", None, None),
        (root, "sphinx==<9"): ("optional", "<9", None), (root, "web==^2"): ("runtime", "^2", None), (root, "probe==https://h/p.git"): ("test", "https://h/p.git", None),
    }
    assert nodes["a-b==>= 1"]["extras"] == "x,y" and nodes["here==https://h/x.whl"]["artifact_type"] == "wheel" and nodes["web==^2"]["extras"] == "z"
    bare = lock_rows(lockfiles.pyproject_file(spark, put(tmp_path, "other.toml", "[build-system]\n")))
    assert set(bare[0]) == {"pyproject==0.0.0"} and not bare[1]


def test_yarn_lock(spark, tmp_path):
    text = '# yarn\n"@s/a@^1", "@s/a@~1":\n  version "1.1"\n  resolved "https://h/a.tgz#0"\n  integrity sha512-x\n  dependencies:\n    b "^2"\n    "@s/c" "^9"\n    gone "1"\n\nb@^2:\n  version "2.0"\n\nb@^1:\n  version "1.0"\n\n"@s/c@npm:1":\n  version "3"\n'
    nodes, edges = lock_rows(lockfiles.yarn_lock(spark, put(tmp_path, "yarn.lock", text)))
    assert edges == {("@s/a==1.1", "b==2.0"): ("runtime", "^2", "2.0"), ("@s/a==1.1", "@s/c==3"): ("runtime", "^9", "3"), ("yarn-lock==resolved", "@s/a==1.1"): ("runtime", None, "1.1"), ("yarn-lock==resolved", "b==1.0"): ("runtime", None, "1.0")}
    assert nodes["@s/a==1.1"] | {"integrity": "sha512-x", "source_line": "2", "package_path": "yarn:@s/a@^1", "lockfile_format": "yarn-lock"} == nodes["@s/a==1.1"]


def test_pnpm_lock(spark, tmp_path):
    text = """lockfileVersion: '9.0'
importers:
  .:
    dependencies:
      a:
        specifier: ^1
        version: 1.0.0(p@3.0.0)
    devDependencies:
      '@s/d':
        specifier: ^4
        version: 4.0.0
packages:
  a@1.0.0(p@3.0.0):
    resolution: {integrity: sha-a, tarball: https-a}
    license: MIT  # said by the registry
    peerDependencies:
      p: '*'
  b@2.0.0:
    resolution: {integrity: sha-b}
  '@s/d@4.0.0':
    resolution: {integrity: sha-d}
  p@3.0.0: {}
snapshots:
  a@1.0.0(p@3.0.0):
    dependencies:
      b: 2.0.0
    optionalDependencies:
      '@s/d': 4.0.0
"""
    nodes, edges = lock_rows(lockfiles.pnpm_lock(spark, put(tmp_path, "pnpm-lock.yaml", text)))
    root = "pnpm-lock==resolved"
    assert edges == {("a==1.0.0", "b==2.0.0"): ("runtime", "2.0.0", "2.0.0"), ("a==1.0.0", "@s/d==4.0.0"): ("optional", "4.0.0", "4.0.0"), ("a==1.0.0", "p==3.0.0"): ("peer", "*", "3.0.0"), (root, "a==1.0.0"): ("runtime", "^1", "1.0.0"), (root, "@s/d==4.0.0"): ("dev", "^4", "4.0.0")}
    assert nodes["a==1.0.0"]["license"] == "MIT" and nodes["a==1.0.0"]["integrity"] == "sha-a" and nodes["@s/d==4.0.0"]["dependency_scope"] == "dev" and nodes["b==2.0.0"]["classification"] == "transitive"
    old = "packages:\n  /x@1:\n    dependencies:\n      y: 2\n  /y@2:\n    dev: true\n"
    assert set(lock_rows(lockfiles.pnpm_lock(spark, put(tmp_path, "old.yaml", old)))[1]) == {("x==1", "y==2"), (root, "x==1")}


def test_lock_source_opens_what_is_asked_for(spark, tmp_path):
    for name in ("one", "two"):
        put(tmp_path, f"{name}.lock", f'[[package]]\nname = "{name}"\nversion = "1"\n')
    put(tmp_path, "_broken.lock", "not toml [")
    lockfiles.register(spark)
    rows = spark.read.format("cargo-lock").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 2 and {r.id for r in rows.where("kind = 'node'").collect()} == {"cargo-lock==resolved", "one==1", "two==1"}
    put(tmp_path, "two.lock", "broken [")  # no longer read
    assert {r.dst for r in rows.where(f"kind = 'edge' AND file = '{tmp_path}/one.lock'").collect()} == {"one==1"}
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("cargo-lock").load(str(tmp_path / "nowhere")).collect()


def test_unknown_source(spark):
    with pytest.raises(ValueError):
        sources.load(spark, "nothing", "x")
