"""Column functions over package names, ids, file names, licences and locations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonempty(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once however often body names it: as a plain Column it would be repeated in the plan each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_id(id_: Column) -> tuple[Column, Column]:
    """Name and version around the first ==; without one the version is empty."""
    at = F.instr(id_, "==")
    return F.when(at > 0, F.substr(id_, F.lit(1), at - 1)).otherwise(id_), F.when(at > 0, F.substr(id_, at + 2)).otherwise(F.lit(""))


def percent(c: Column, keep: str = "") -> Column:
    """Percent-encoding of everything but letters, digits and -._~, and the characters to keep."""
    out = F.regexp_replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), "%7E", "~")
    for k in keep:
        out = F.replace(out, F.url_encode(F.lit(k)), F.lit(k))
    return out


def _spaced(space: Column, name: Column) -> Column:
    """Namespace and name of a purl; the name alone without a namespace."""
    return F.when(F.length(space) > 0, F.concat(percent(space), F.lit("/"), percent(name))).otherwise(percent(name))


def purl(ecosystem: Column, name: Column, version: Column, meta: Column | None = None, namespace: Column | None = None) -> Column:
    """Package URL. An npm scope becomes the namespace; pypi and cargo names are in lower case; maven has the namespace or meta's group,
    and meta's artifact or what follows the last colon of the name, but without a group the whole name; rpm has the namespace, or
    meta's namespace or vendor, in lower case, and arch, distro and epoch of meta as qualifiers; anything else is generic."""
    ecosystem, name, version = F.lower(F.trim(ecosystem)), F.trim(name), F.trim(F.coalesce(version, F.lit("")))
    of = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("")) if meta is not None else F.lit("")
    given = F.coalesce(namespace, F.lit("")) if namespace is not None else F.lit("")
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    at = F.when(F.length(version) > 0, F.concat(F.lit("@"), percent(version))).otherwise(F.lit(""))
    scoped = (given == "") & F.startswith(name, F.lit("@")) & F.contains(name, F.lit("/"))
    before = F.concat(given, F.lit("/"))
    bare = F.when((given != "") & F.startswith(name, before), F.substr(name, F.length(before) + 1)).otherwise(name)
    npm = F.when(scoped, _spaced(F.substring_index(name, "/", 1), F.substr(name, F.instr(name, "/") + 1))).otherwise(_spaced(given, bare))
    pairs = [F.when(of(k) != "", F.concat(F.lit(f"{k}="), F.url_encode(of(k)))) for k in ("arch", "distro", "epoch")]
    tail = F.concat_ws("&", *pairs)
    tail = F.when(F.length(tail) > 0, F.concat(F.lit("?"), tail)).otherwise(F.lit(""))
    group = first(given, of("group"))
    maven = F.when(group != "", _spaced(group, first(of("artifact"), F.element_at(F.split(name, ":"), -1)))).otherwise(percent(name))
    return (
        F.when(ecosystem == "npm", F.concat(F.lit("pkg:npm/"), npm, at))
        .when(ecosystem.isin("pypi", "cargo"), F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), percent(F.lower(name)), at))
        .when(ecosystem == "maven", F.concat(F.lit("pkg:maven/"), maven, at))
        .when(ecosystem == "rpm", F.concat(F.lit("pkg:rpm/"), _spaced(F.lower(first(given, of("namespace"), of("vendor"))), name), at, tail))
        .when(ecosystem == "oci", F.concat(F.lit("pkg:oci/"), percent(name, "/:"), at))
        .otherwise(F.concat(F.lit("pkg:generic/"), percent(name), at))
    )


def purl_name(p: Column) -> Column:
    """The package's name in a purl."""
    body = F.substring_index(F.substring_index(p, "?", 1), "#", 1)
    last = F.element_at(F.split(body, "/"), -1)
    return F.substring_index(last, "@", 1)


def purl_package(p: Column) -> Column:
    """The package that a purl names, with an npm scope; empty if it is no purl."""
    path = F.regexp_replace(F.substring_index(F.regexp_replace(p, "^pkg:", ""), "?", 1), "@[^@]*$", "")
    parts = F.filter(F.transform(F.split(F.substr(path, F.instr(path, "/") + 1), "/"), lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))), lambda x: x != "")
    n = F.size(parts)
    scoped = (n >= 2) & F.startswith(F.get(parts, F.lit(0)), F.lit("@"))
    name = F.when(scoped, F.array_join(F.slice(parts, n - 1, F.lit(2)), "/")).when(n > 0, F.element_at(parts, -1)).otherwise("")
    return F.when(F.startswith(p, F.lit("pkg:")) & F.contains(path, F.lit("/")), name).otherwise("")


def purl_forms(p: Column) -> Column:
    """The purl unquoted, with and without its qualifiers; nothing if it is no purl."""
    plain = F.url_decode(F.replace(F.trim(p), F.lit("+"), F.lit("%2B")))
    forms = F.array_distinct(F.array(plain, F.substring_index(plain, "?", 1)))
    return F.when(F.startswith(p, F.lit("pkg:")), forms).otherwise(F.array().cast("array<string>"))


def _rpm_parts(filename: Column) -> tuple[Column, ...]:
    """Whether it is an rpm file, what stands before the last dot and behind it, and the parts of name-version-release, if it has them."""
    stem = F.regexp_replace(filename, r"\.rpm$", "")
    dotted = F.contains(stem, F.lit("."))
    arch = F.when(dotted, F.substring_index(stem, ".", -1))
    body = F.when(dotted, F.substr(stem, F.lit(1), F.length(stem) - F.length(arch) - 1)).otherwise(stem)
    pattern = r"^(.*)-([^-]*)-([^-]*)$"
    return F.endswith(filename, F.lit(".rpm")), body, arch, F.regexp_like(body, F.lit(pattern)), lambda i: F.regexp_extract(body, pattern, i)


def rpm_file(filename: Column) -> Column:
    """name, version, release and arch of an rpm file; of another file its name, and arch unknown. Without two dashes the name is all that
    stands before the arch."""
    is_rpm, body, arch, ok, part = _rpm_parts(filename)
    return F.struct(
        F.when(~is_rpm, filename).when(ok, part(1)).otherwise(body).alias("name"), F.when(is_rpm & ok, part(2)).otherwise("").alias("version"),
        F.when(is_rpm & ok, part(3)).otherwise("").alias("release"), F.when(is_rpm, F.coalesce(arch, F.lit("unknown"))).otherwise("unknown").alias("arch"),
    )


def timing_file(filename: Column) -> Column:
    """name and arch of a file as timings count it: no rpm, or one without an arch, is of arch non-rpm; without two dashes there is no name."""
    is_rpm, _, arch, ok, part = _rpm_parts(filename)
    return F.struct(F.when(is_rpm & ok, part(1)).otherwise("").alias("name"), F.when(is_rpm, F.coalesce(F.nullif(arch, F.lit("")), F.lit("non-rpm"))).otherwise("non-rpm").alias("arch"))


def transaction_package(text: Column) -> Column:
    """name, epoch, version, release, arch, node (the id in a graph) and purl of name-[epoch:]version-release.arch[.rpm]; null for an empty
    text. Without two dashes all of it is the name."""
    package = F.trim(text)
    pattern = r"^(.*)-([^-]*)-([^-]*)$"

    def stemmed(stem: Column) -> Column:
        arch = F.substring_index(stem, ".", -1)
        body = F.when(F.contains(stem, F.lit(".")), F.substr(stem, F.lit(1), F.length(stem) - F.length(arch) - 1)).otherwise(stem)
        return F.struct(stem.alias("stem"), F.when(F.contains(stem, F.lit(".")), arch).otherwise("unknown").alias("arch"), body.alias("body"))

    def matched(p: Column) -> Column:
        part = lambda i: F.regexp_extract(p["body"], pattern, i)
        return F.struct(p["stem"].alias("stem"), p["arch"].alias("arch"), F.regexp_like(p["body"], F.lit(pattern)).alias("ok"), part(1).alias("first"), part(2).alias("second"), part(3).alias("third"))

    def versioned(p: Column) -> Column:
        ok, second, release = p["ok"], p["second"], F.when(p["ok"], p["third"]).otherwise("")
        has = F.contains(second, F.lit(":"))
        epoch = F.when(ok & has, F.coalesce(F.nullif(F.substring_index(second, ":", 1), F.lit("")), F.lit("0"))).otherwise("0")
        version = F.when(ok & has, F.substr(second, F.instr(second, ":") + 1)).when(ok, second).otherwise("")
        return F.struct(F.when(ok, p["first"]).otherwise(p["stem"]).alias("name"), epoch.alias("epoch"), version.alias("version"), release.alias("release"), p["arch"].alias("arch"), ok.alias("ok"))

    def named(p: Column) -> Column:
        known = (p["arch"] != "") & (p["arch"] != "unknown")
        evr = F.when(p["release"] != "", F.concat(p["version"], F.lit("-"), p["release"])).otherwise(p["version"])
        full = F.when(known, F.concat(evr, F.lit("."), p["arch"])).otherwise(evr)
        node = F.when(p["ok"] & (full != ""), F.concat(p["name"], F.lit("=="), full)).otherwise(p["name"])
        shown = F.coalesce(F.when(p["ok"], F.nullif(evr, F.lit(""))), F.lit("unknown"))
        pairs = F.concat_ws("&", F.when(known, F.concat(F.lit("arch="), F.url_encode(p["arch"]))), F.when(~p["epoch"].isin("0", "(none)"), F.concat(F.lit("epoch="), F.url_encode(p["epoch"]))))
        url = F.concat(F.lit("pkg:rpm/"), percent(p["name"]), F.lit("@"), percent(shown), F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""))
        return F.struct(*[p[c].alias(c) for c in ("name", "epoch", "version", "release", "arch")], node.alias("node"), url.alias("purl"))

    found = F.regexp_replace(package, r"\.rpm$", "")
    for step in (stemmed, matched, versioned, named):
        found = bound(found, step)
    return F.when(F.length(package) > 0, found)


def nevra(text: Column) -> Column:
    """name, epoch, version, release and arch of name-[epoch:]version-release.arch."""
    pattern = r"^(.+)-(?:(\d+):)?([^-:]+)-([^-]+)\.([^.-]+)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.struct(*[part(i).alias(n) for i, n in enumerate(("name", "epoch", "version", "release", "arch"), 1)])


def artifact_kind(filename: Column) -> Column:
    return (
        F.when(F.endswith(filename, F.lit(".src.rpm")), "srpm")
        .when(~F.endswith(filename, F.lit(".rpm")), "build-log")
        .when(F.contains(filename, F.lit("-debuginfo-")) | F.contains(filename, F.lit("-debugsource-")), "debug")
        .when(F.endswith(filename, F.lit(".noarch.rpm")), "noarch")
        .otherwise("binary")
    )


#: Two orders of architectures; others follow by name.
TIMING_ORDER = ("x86_64", "aarch64", "ppc64le", "s390x", "i686", "src", "noarch")
INVENTORY_ORDER = ("x86_64", "aarch64", "ppc64le", "s390x", "i686", "noarch", "src")


def arch_rank(arch: Column, order: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), arch)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def license_text(*columns: Column) -> Column:
    return F.coalesce(*[nonempty(c) for c in columns])


def license_tokens(text: Column) -> Column:
    """The licence identifiers of an expression in lower case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9.+-]*)"), 1), F.lower)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin("and", "or", "with")))


def severity_rank(text: Column) -> Column:
    """0 unknown to 4 critical, of a word or of a score."""
    word, score = F.lower(F.trim(text)), text.try_cast("double")
    return (
        F.when(word == "critical", 4).when(word == "high", 3).when(word.isin("medium", "moderate"), 2).when(word == "low", 1)
        .when(score >= 9, 4).when(score >= 7, 3).when(score >= 4, 2).when(score > 0, 1).otherwise(0)
    )


def pypi_name(name: Column) -> Column:
    return F.translate(F.lower(name), "_.", "--")


def seconds(delta: Column) -> Column:
    """Seconds of H:M:S.f or of a number; hours and minutes are whole numbers."""
    parts = F.split(delta, ":")
    whole = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("long")
    clock = whole(0) * 3600 + whole(1) * 60 + F.trim(F.get(parts, F.lit(2))).try_cast("double")
    return F.when(F.size(parts) == 3, F.bround(clock, 6)).otherwise(delta.try_cast("double"))


def wall_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two ISO stamps; null if one is missing or cannot be read."""
    micros = lambda c: F.unix_micros(F.try_to_timestamp(F.nullif(F.trim(c), F.lit(""))))
    return F.bround((micros(finished) - micros(started)) / 1e6, 6)


def slug(text: Column) -> Column:
    """A text as part of a file name: what is no letter, digit, dot, dash or underscore becomes a dash; none of the three signs at the ends."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[.\-_]+|[.\-_]+$", ""), F.lit("")), F.lit("report"))


def changed_keys(left: Column, right: Column) -> Column:
    """The keys, in order, whose values differ between two maps."""
    keys = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))
    return F.filter(keys, lambda k: ~F.equal_null(F.try_element_at(left, k), F.try_element_at(right, k)))


#: The popular names that look-alikes are compared with.
POPULAR = ("react", "lodash", "express", "webpack", "typescript", "eslint", "axios", "next", "vite")


def lookalike(name: Column) -> Column:
    """The smallest popular name at an edit distance of one, without regard to case; null if there is none, or if the name is one itself."""
    low = F.lower(name)
    near = F.filter(F.array(*map(F.lit, sorted(POPULAR))), lambda p: F.levenshtein(low, p, 1) == 1)
    return F.when(~low.isin(*POPULAR), F.get(near, F.lit(0)))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text.cast("string")).isin("1", "true", "yes"), F.lit(False))
