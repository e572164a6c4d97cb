"""Version orders as sortable columns; the orders differ on purpose and share no key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = "decimal(38,0)"


def parts_key(version: Column) -> Column:
    """Three numbers and what follows the first dash; missing numbers are 0, only leading digits count, further numbers do not, and no
    suffix comes before any suffix."""
    main, suffix = F.substring_index(version, "-", 1), F.regexp_extract(version, r"^[^-]*-((?s:.*))$", 1)
    pieces = F.split(main, r"\.")
    number = lambda i: F.coalesce(F.regexp_extract(F.get(pieces, F.lit(i)), r"^(\d+)", 1).try_cast(BIG), F.lit(0).cast(BIG))
    return F.struct(number(0).alias("a"), number(1).alias("b"), number(2).alias("c"), suffix.alias("suffix"))


def _token_keys(version: Column, pattern: str, words_first: bool) -> Column:
    """Runs of digits and of letters in lower case; a longer row is more than its beginning."""
    digits = lambda t: t.rlike(r"^\d")
    kind = lambda t: (digits(t) if words_first else ~digits(t)).cast("int").alias("kind")
    number = lambda t: F.coalesce(F.when(digits(t), t.try_cast(BIG)), F.lit(0).cast(BIG)).alias("n")
    found = F.regexp_extract_all(version, F.lit(pattern), 1)
    return F.transform(found, lambda t: F.struct(kind(t), number(t), F.when(digits(t), "").otherwise(F.lower(t)).alias("s")))


def advisory_key(version: Column, epochs: Column | None = None) -> Column:
    """The order of advisories: a number is more than a word. Where `epochs` is true, what stands before a colon counts first, as a
    number; it is 0 without one."""
    if epochs is None:
        return F.struct(F.lit(0).cast(BIG).alias("epoch"), _token_keys(version, r"(\d+|[A-Za-z]+)", True).alias("tokens"))
    has = F.coalesce(epochs, F.lit(False)) & F.regexp_like(version, F.lit(r"^\s*\d+\s*:"))
    epoch = F.when(has, F.trim(F.substring_index(version, ":", 1)).try_cast(BIG))
    body = F.when(has, F.substr(version, F.instr(version, ":") + 1)).otherwise(version)
    return F.struct(F.coalesce(epoch, F.lit(0).cast(BIG)).alias("epoch"), _token_keys(body, r"(\d+|[A-Za-z]+)", True).alias("tokens"))


def diff_key(version: Column) -> Column:
    """The order of snapshot diffs: a word is more than a number; letters of any script."""
    return _token_keys(version, r"(\d+|[\p{L}\p{Nl}\p{No}]+)", False)


def change_kind(old: Column, new: Column) -> Column:
    a, b = diff_key(F.coalesce(old, F.lit(""))), diff_key(F.coalesce(new, F.lit("")))
    return F.when(a < b, "upgrade").when(a > b, "downgrade").otherwise("replacement")


def in_range(
    version: Column, introduced: Column, fixed: Column, last_affected: Column | None = None, limit: Column | None = None, epochs: Column | None = None
) -> Column:
    """introduced <= version < fixed, <= last_affected and < limit, as far as they are given; "0" is no lower bound, an empty bound is
    none; some bound is needed. epochs: as for advisory_key."""
    v, none = advisory_key(version, epochs), F.lit("")
    given, out = F.lit(False), F.lit(True)
    for bound, test in ((introduced, lambda b: v >= b), (fixed, lambda b: v < b), (last_affected, lambda b: v <= b), (limit, lambda b: v < b)):
        if bound is None:
            continue
        there = F.coalesce(bound, none) != ""
        free = ~there | (bound == "0") if bound is introduced else ~there
        out = out & (F.coalesce(free, F.lit(True)) | F.coalesce(test(advisory_key(bound, epochs)), F.lit(False)))
        given = given | there
    return out & given


def rpm_candidates(full: Column, version: Column, release: Column, epoch: Column, arch: Column) -> Column:
    """The spellings of an rpm's version that an advisory may use; full: as the package's id has it."""
    has = lambda c: F.length(c) > 0
    evr = F.when(has(version) & has(release), F.concat(version, F.lit("-"), release))
    with_epoch = F.when(has(epoch) & ~epoch.isin("0", "(none)"), F.concat(epoch, F.lit(":"), evr))
    bare = F.when(has(arch) & F.endswith(full, F.concat(F.lit("."), arch)), F.substr(full, F.lit(1), F.length(full) - F.length(arch) - 1))
    return F.array_distinct(F.filter(F.array_compact(F.array(full, version, evr, with_epoch, bare)), lambda x: x != ""))


def precise(candidates: Column, bounds: Column) -> Column:
    """Of an rpm's candidates those with a release or an epoch, if one of the bounds has one and there are such; else all."""
    exact = lambda x: F.contains(x, F.lit("-")) | F.contains(x, F.lit(":"))
    fine = F.filter(candidates, exact)
    return F.when(F.exists(F.array_compact(bounds), exact) & (F.size(fine) > 0), fine).otherwise(candidates)


#: Comparators, and what a constraint that holds any version looks like.
COMPARATOR = r"^(<=|>=|<|>|==|=)?\s*([A-Za-z0-9_.+\-]+)$"
ANY = ("", "*", "latest")


def allows(constraint: Column, version: Column) -> Column:
    """Whether a constraint holds a version: alternatives by ||, each ^ or ~ with a version, or a row of <=, >=, <, >, =, == and plain
    versions, parted by commas or spaces; nothing, * and latest hold any. An alternative that cannot be read is an error, unless one
    before it holds the version."""
    v, nil = parts_key(version), F.lit(0).cast(BIG)
    below = lambda a, b, c: F.struct(a.cast(BIG).alias("a"), b.cast(BIG).alias("b"), c.cast(BIG).alias("c"), F.lit("").alias("suffix"))

    def one(token: Column) -> Column:
        op, k = F.regexp_extract(token, COMPARATOR, 1), parts_key(F.regexp_extract(token, COMPARATOR, 2))
        return F.when(op == ">=", v >= k).when(op == "<=", v <= k).when(op == ">", v > k).when(op == "<", v < k).otherwise(v == k)

    def alternative(part: Column) -> Column:
        text = F.trim(part)
        k = parts_key(F.trim(F.substr(text, F.lit(2))))
        caret = F.when(k["a"] > 0, below(k["a"] + 1, nil, nil)).when(k["b"] > 0, below(nil, k["b"] + 1, nil)).otherwise(below(nil, nil, k["c"] + 1))
        tokens = F.filter(F.split(text, r"[,\s]+"), lambda t: t != "")
        unread = F.exists(tokens, lambda t: ~F.regexp_like(t, F.lit(COMPARATOR)))
        return (
            F.when(text.isin(*ANY), True)
            .when(F.startswith(text, F.lit("^")), (v >= k) & (v < caret))
            .when(F.startswith(text, F.lit("~")), (v >= k) & (v < below(k["a"], k["b"] + 1, nil)))
            .when(unread, F.raise_error(F.concat(F.lit("unsupported version constraint: "), text)).cast("boolean"))
            .otherwise(F.forall(tokens, one))
        )

    return F.exists(F.split(F.coalesce(constraint, F.lit("*")), r"\|\|"), alternative)


def readable(constraint: Column) -> Column:
    """Whether all alternatives of a constraint can be read."""

    def one(part: Column) -> Column:
        text = F.trim(part)
        tokens = F.filter(F.split(text, r"[,\s]+"), lambda t: t != "")
        return text.isin(*ANY) | F.startswith(text, F.lit("^")) | F.startswith(text, F.lit("~")) | F.forall(tokens, lambda t: F.regexp_like(t, F.lit(COMPARATOR)))

    return F.forall(F.split(F.coalesce(constraint, F.lit("*")), r"\|\|"), one)


def alternatives(constraint: Column) -> Column:
    """The alternatives of a readable constraint, each as the bounds (array of operators <, <=, >, >= and keys) that `allows` tests."""
    nil = F.lit(0).cast(BIG)
    below = lambda a, b, c: F.struct(a.cast(BIG).alias("a"), b.cast(BIG).alias("b"), c.cast(BIG).alias("c"), F.lit("").alias("suffix"))
    bound = lambda op, key: F.struct((F.lit(op) if isinstance(op, str) else op).alias("op"), key.alias("key"))

    def token(t: Column) -> Column:
        op, k = F.regexp_extract(t, COMPARATOR, 1), parts_key(F.regexp_extract(t, COMPARATOR, 2))
        return F.when(op.isin(">=", "<=", ">", "<"), F.array(bound(op, k))).otherwise(F.array(bound(">=", k), bound("<=", k)))

    def one(part: Column) -> Column:
        text = F.trim(part)
        k = parts_key(F.trim(F.substr(text, F.lit(2))))
        caret = F.when(k["a"] > 0, below(k["a"] + 1, nil, nil)).when(k["b"] > 0, below(nil, k["b"] + 1, nil)).otherwise(below(nil, nil, k["c"] + 1))
        tokens = F.filter(F.split(text, r"[,\s]+"), lambda t: t != "")
        all_ = F.flatten(F.transform(tokens, token))
        return (
            F.when(text.isin(*ANY), F.slice(F.array(bound(">=", k)), 1, 0))
            .when(F.startswith(text, F.lit("^")), F.array(bound(">=", k), bound("<", caret)))
            .when(F.startswith(text, F.lit("~")), F.array(bound(">=", k), bound("<", below(k["a"], k["b"] + 1, nil))))
            .otherwise(all_)
        )

    return F.transform(F.split(F.coalesce(constraint, F.lit("*")), r"\|\|"), one)
