"""Loaders: one per format, all giving nodes and edges of many files at once."""

from __future__ import annotations

from . import lockfiles, tables

LOADERS = {
    "npm-lock": lambda s, p: tables.package_lock(s, p)[:2], "package-json": tables.package_json, "requirements": tables.requirements_graph, "yarn-lock": lockfiles.yarn_lock,
    "pnpm-lock": lockfiles.pnpm_lock, "poetry-lock": lockfiles.poetry_lock, "pyproject": lockfiles.pyproject_file, "cargo-lock": lockfiles.cargo_lock, "maven-tree": tables.maven_tree,
    "cyclonedx": tables.cyclonedx, "dot": tables.dot, "rpm-repo": tables.rpm_repository, "build": tables.build, "snapshot": tables.snapshot,
}
#: Loaders of what is no graph.
ROWS = {
    "registry": tables.registry, "transaction": tables.transaction, "installed-rpms": tables.installed_rpms, "advisories": tables.advisories, "osv-feed": tables.osv_feed,
    "builds": tables.builds,
}


def load(spark, kind: str, path: str, **options):
    """Nodes and edges of the files at a path; kind: a key of LOADERS. Other files: load_rows."""
    if kind not in LOADERS:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[kind](spark, path, **options)


def load_rows(spark, kind: str, path: str, **options):
    """The rows of files that are no graph; kind: a key of ROWS."""
    if kind not in ROWS:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted(ROWS))}")
    return ROWS[kind](spark, path, **options)


def load_graph(spark, kind: str, path: str, **options):
    """The same as `load`, as the questions of operators.graph and operators.query want it: nodes with vids, edges between vids."""
    from ..operators.graph import canonical

    return canonical(*load(spark, kind, path, **options))
