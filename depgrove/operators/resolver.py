"""Choosing versions: for each root a version of every package it needs, directly or not, that all constraints hold.

Requirements are clauses: a version is not chosen, or one of the choices that its requirement leaves is. What follows from them alone holds for
all roots and is worked out for all at once, as a fixpoint of joins over the clauses: a version with a requirement none of whose choices is left
is no choice either. Then each root is searched for in a group of its own, which holds what is left of the packages it reaches: the next package
is the one that the first chosen package (by name) still needs, its newest version that fits is tried first; a dead end is traced to the choices
it follows from, these are learned as not standing together, and the search goes back to the last of them. It finds a solution if there is one,
the same that going through all choices in this order would find first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import versions as V
from . import intervals as I
from .graph import levels
from .tables import counted, written

C = F.col


def ranked_versions(registry: DataFrame) -> DataFrame:
    """name, version and rank: 0 for the newest."""
    from pyspark.sql import Window

    return registry.select("name", "version", (F.row_number().over(Window.partitionBy("name").orderBy(V.parts_key(C("version")).desc(), F.desc("version"))) - 1).alias("rank"))


def held(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """dependency, constraint, choice: of each constraint the versions that it holds. wanted: dependency, constraint; versions: name, version.

    Each alternative is a range of the versions in their order. A constraint that cannot be read is compared with each version of its package,
    as it is an error only where no alternative before holds the version."""
    wanted = written(wanted.select("dependency", "constraint").distinct().withColumn("reads", V.readable(C("constraint"))), "constraints")
    known = versions.select("name", "version").distinct()
    ends = F.transform("x", lambda b: F.struct(F.when(b["op"].startswith(">"), I.FROM).otherwise(I.TO).alias("side"), b["key"].alias("key"), b["op"].isin(">", "<=").alias("after")))
    ranges = wanted.where("reads").select("dependency", "constraint", F.posexplode(V.alternatives(C("constraint"))).alias("i", "x"))
    ranges = ranges.select(F.struct("dependency", "constraint", "i").alias("range"), C("dependency").alias("group"), ends.alias("bounds"))
    found = I.matches(known.select(C("name").alias("group"), V.parts_key(C("version")).alias("key"), C("version").alias("item")), ranges)
    plain = found.select("range.dependency", "range.constraint", C("item").alias("choice")).distinct()
    odd = wanted.where("NOT reads").join(known, C("dependency") == C("name")).where(V.allows(C("constraint"), C("version")))
    return plain.unionByName(odd.select("dependency", "constraint", C("version").alias("choice")))


def allowed(registry: DataFrame) -> DataFrame:
    """name, version, dependency, choices: for each requirement the versions that its constraint holds; none if there is none."""
    wants = registry.select("name", "version", F.explode("dependencies").alias("dependency", "constraint"))
    choices = held(wants, registry).groupBy("dependency", "constraint").agg(F.collect_list("choice").alias("choices"))
    same = F.equal_null("w.constraint", "c.constraint") & (C("w.dependency") == C("c.dependency"))
    found = wants.alias("w").join(choices.alias("c"), same, "left")
    return found.select("w.name", "w.version", "w.dependency", F.coalesce("choices", F.array().cast("array<string>")).alias("choices"))


def clauses(registry: DataFrame) -> DataFrame:
    """name, version, dependency, choice: a row for each choice of each requirement, with a null choice where it has none."""
    return allowed(registry).select("name", "version", "dependency", F.explode_outer("choices").alias("choice"))


def possible(registry: DataFrame, found: DataFrame) -> DataFrame:
    """name, version of those that can be chosen as far as each requirement by itself can tell. found: the registry's clauses."""
    left = written(registry.select("name", "version").distinct(), "versions")
    rows = written(found, "clauses")
    while True:
        still = rows.join(left, ["name", "version"], "left_semi")
        chosen = left.select(C("name").alias("dependency"), C("version").alias("choice"), F.lit(True).alias("there"))
        units = still.join(chosen, ["dependency", "choice"], "left").groupBy("name", "version", "dependency").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("open"))
        gone, n = counted(units.where("NOT open").select("name", "version").distinct(), "units")
        if not n["n"]:
            return left
        left = written(left.join(gone, ["name", "version"], "left_anti"), "versions")


class _Search:
    """One root's search. rank: versions of each package, newest first; wants: (package, version) to the choices of each package it needs."""

    def __init__(self, root: str, rank: dict[str, list[str]], wants: dict[tuple[str, str], dict[str, frozenset]]):
        self.root, self.rank, self.wants = root, rank, wants
        self.chosen: dict[str, str] = {}
        self.learned: dict[tuple[str, str], list[frozenset]] = {}
        self.steps = 0

    def _needs(self, name: str) -> dict[str, frozenset]:
        return self.wants.get((name, self.chosen[name]), {})

    def _open(self) -> tuple[str, frozenset] | None:
        """The next package, and the choices because of which it is needed."""
        if self.root not in self.chosen:
            return self.root, frozenset()
        for name in sorted(self.chosen):
            for other in sorted(self._needs(name)):
                if other not in self.chosen:
                    return other, frozenset([name])
        return None

    def _against(self, name: str, version: str) -> frozenset | None:
        """The chosen packages because of which a version cannot be chosen now, or None if it can."""
        for other in self.chosen:
            if version not in self._needs(other).get(name, (version,)):
                return frozenset([other])
        for dependency, choices in self.wants.get((name, version), {}).items():
            if dependency in self.chosen:
                if self.chosen[dependency] not in choices:
                    return frozenset([dependency])
                continue
            who = []
            for other in self.chosen:
                if (more := self._needs(other).get(dependency)) is not None:
                    choices, who = choices & more, [*who, other]
            if not choices:
                return frozenset(who)
        for together in self.learned.get((name, version), ()):
            if all(self.chosen.get(n) == v for n, v in together if n != name):
                return frozenset(n for n, _ in together if n != name)
        return None

    def solve(self) -> dict[str, str] | None:
        while (at := self._open()) is not None:
            name, because = at
            self.steps += 1
            for version in self.rank.get(name, ()):
                against = self._against(name, version)
                if against is None:
                    self.chosen[name] = version
                    break
                because |= against
            else:
                if not because:
                    return None
                together = frozenset((n, self.chosen[n]) for n in because)
                for pair in together:
                    self.learned.setdefault(pair, []).append(together)
                while self.chosen.popitem()[0] not in because:
                    pass
        return self.chosen


def _solve(table: pa.Table) -> pa.Table:
    """One root's packages: rows (root, name, version, rank, dependency, choices)."""
    rank: dict[str, dict[int, str]] = {}
    wants: dict[tuple[str, str], dict[str, frozenset]] = {}
    for r in table.to_pylist():
        rank.setdefault(r["name"], {})[r["rank"]] = r["version"]
        if r["dependency"] is not None:
            wants.setdefault((r["name"], r["version"]), {})[r["dependency"]] = frozenset(r["choices"] or ())
    root = table.column("root")[0].as_py()
    found = _Search(root, {n: [v for _, v in sorted(vs.items())] for n, vs in rank.items()}, wants).solve()
    rows = sorted(found.items()) if found else []
    return pa.table([pa.array([root] * max(1, len(rows))), pa.array([n for n, _ in rows] or [None], pa.string()), pa.array([v for _, v in rows] or [None], pa.string())], ["root", "name", "version"])


def resolve(registry: DataFrame, roots: DataFrame) -> DataFrame:
    """registry: name, version, dependencies (map of name to constraint); roots: root. Gives root, name, version of every package
    chosen; a root that cannot be resolved has one row with nulls. A root's group holds what it reaches, not the whole registry."""
    found = written(clauses(registry), "clauses")
    left = written(possible(registry, found), "possible")
    # choices that are left, of versions that are left
    choice = left.select(C("name").alias("dependency"), C("version").alias("choice"))
    wants = found.join(left, ["name", "version"], "left_semi").join(choice, ["dependency", "choice"], "left_semi").groupBy("name", "version", "dependency").agg(F.collect_set("choice").alias("choices"))
    wants = written(wants, "requirements")
    names = registry.select("name").distinct().select(F.xxhash64("name").alias("vid"), "name")
    edges = wants.select(F.xxhash64("name").alias("src"), F.xxhash64("dependency").alias("dst")).distinct()
    starts = roots.select(F.xxhash64("root").alias("qid"), F.xxhash64("root").alias("vid"), "root").distinct()
    reached = levels(edges, starts, "dependencies").select("qid", "vid").join(starts.select("qid", "root"), "qid").join(names, "vid").select("root", "name")
    ranked = ranked_versions(registry).join(left, ["name", "version"], "left_semi")
    rows = reached.join(ranked, "name").join(wants, ["name", "version"], "left")
    solved = rows.select("root", "name", "version", "rank", "dependency", "choices").groupBy("root").applyInArrow(_solve, "root string, name string, version string")
    # a root of which no version is left has no group
    lost = roots.select("root").distinct().join(left.select(C("name").alias("root")).distinct(), "root", "left_anti")
    none = F.lit(None).cast("string")
    return solved.unionByName(lost.select("root", none.alias("name"), none.alias("version")))


def resolved_edges(chosen: DataFrame, registry: DataFrame) -> DataFrame:
    """root, src, dst: the requirements between chosen packages."""
    wants = allowed(registry).select("name", "version", "dependency")
    a = chosen.join(wants, ["name", "version"]).select("root", F.concat("name", F.lit("=="), "version").alias("src"), "dependency")
    b = chosen.select("root", C("name").alias("dependency"), F.concat("name", F.lit("=="), "version").alias("dst"))
    return a.join(b, ["root", "dependency"]).select("root", "src", "dst")


def clause_counts(registry: DataFrame) -> DataFrame:
    """How large the encoding as clauses is: pairs of versions of a package, and one clause per requirement."""
    pairs = registry.groupBy("name").agg(F.count("*").alias("n")).agg(F.sum((C("n") * (C("n") - 1) / 2).cast("long")).alias("at_most_one"))
    return pairs.withColumn("requirements", allowed(registry).agg(F.count("*").alias("n")).scalar())
