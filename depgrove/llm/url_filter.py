"""URL filtering with a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 the other keys of the universe that level 1 wrongly holds; level 3 the listed keys that
level 2 wrongly holds; and so on until a level holds no key wrongly. Over that universe (all keys that the urls give) membership is
then exact, and a url is judged with a few bit tests on its own columns. Only DataFrame functions are used: bits are set with bit_or,
and a level, written once as one row, reaches the tests as a scalar subquery. A list whose first level would need more than MAX_BITS
bits is dealt with in groups of hosts, by the host's hash: each group has a universe and cascades of its own, so no level that is sent
to the tasks is larger, however long the list.

Defined results: a null url, or one without ://, has an empty host and path and fits no rule; repeated rows are judged one by one;
listed hosts that are null, repeated, or no url's host change nothing; an empty table gives an empty result; other columns of the
inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: A host with one of these labels is on the list of blocked hosts.
BLOCKED_LABELS = ("casino", "clickbait", "linkfarm", "malware", "phishing", "pills", "spam", "spam-farm", "warez")

#: A level holds at most so many bits; longer lists are split into groups of hosts.
MAX_BITS = 1 << 26


def _after(url: Column) -> Column:
    """What follows the first ://; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _position(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits))


def _size(n_in: int, n_out: int, level: int) -> tuple[int, int]:
    """Bits and hashes of a level that holds n_in keys against n_out others."""
    rate = 0.5 if level else min(0.5, max(1e-6, math.sqrt(0.5) * n_in / max(1, n_out)))
    return 64 * math.ceil(max(64.0, n_in * 1.4427 * math.log2(1 / rate)) / 64), max(1, round(math.log2(1 / rate)))


class Cascade:
    """Exact membership of a key, for keys of the universe. keys: distinct key, listed (boolean); it is read once for each level."""

    def __init__(self, keys: DataFrame):
        self.levels = []
        inside, outside = keys.where("listed").select("key"), keys.where("NOT listed").select("key")
        n_in, n_out = inside.count(), outside.count()
        while n_in:
            level = len(self.levels)
            bits, hashes = _size(n_in, n_out, level)
            self.levels.append((written(self._filled(inside, level, bits, hashes), "url-level"), level, bits, hashes))
            wrong = outside.where(self._holds(F.col("key"), -1))
            inside, outside, n_out = wrong, inside, n_in
            n_in = inside.count() if n_out else 0

    @staticmethod
    def _filled(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
        """One row with the level's bits, 64 in a word."""
        spark = keys.sparkSession
        at = keys.select(F.explode(F.array(*[_position(F.col("key"), level, j, bits) for j in range(hashes)])).alias("at"))
        some = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
        none = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
        words = some.unionByName(none).groupBy("word").agg(F.bit_or("bit").alias("bit"))
        return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("bits"))

    def _holds(self, key: Column, which: int) -> Column:
        filled, level, bits, hashes = self.levels[which]
        words = filled.scalar()
        out = F.lit(True)
        for j in range(hashes):
            at = _position(key, level, j, bits)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
            out = out & (F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(bit) != 0)
        return out

    def contains(self, key: Column) -> Column:
        """True if the key is listed."""
        out = F.lit(False)
        for which in reversed(range(len(self.levels))):
            out = self._holds(key, which) & ~out
        return out


def candidates(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> list[Column]:
    """The keys that a rule for this url could have: each end of the host with each beginning of the path up to a slash, as deep as
    the deepest rule; null where the path has no such beginning."""
    rules = list(rules)
    labels, slashes = max(r[0].count(".") for r in rules) + 1, max(r[1].count("/") for r in rules)
    found = []
    for s in range(1, slashes + 1):
        begins = F.concat(F.substring_index(path, "/", s), F.lit("/"))
        found += [F.when(F.startswith(path, begins), F.concat(F.substring_index(host, ".", -n), begins)) for n in range(1, labels + 1)]
    return found


def labelled_hosts(hosts: DataFrame, labels: Iterable[str] = BLOCKED_LABELS) -> DataFrame:
    """The hosts that have one of the labels."""
    return hosts.where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels))))


def judge(pages: DataFrame, rules=RULES, listed_hosts: DataFrame | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict of each url. The longest rule that fits decides; else a host that is listed is blocked and
    any other allowed. Rule paths end in a slash. listed_hosts: a table with a column host; by default the hosts of the pages that
    have one of BLOCKED_LABELS."""
    urls = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    hosts = urls.select("host").distinct()
    lists = listed_hosts.select("host").where("host IS NOT NULL") if listed_hosts is not None else labelled_hosts(hosts)
    marked = hosts.withColumn("listed", F.lit(0)).withColumn("own", F.lit(1)).unionByName(lists.withColumn("listed", F.lit(1)).withColumn("own", F.lit(0)))
    marked = marked.groupBy("host").agg(F.max("listed").alias("listed"), F.max("own").alias("own")).where("own = 1").select("host", (F.col("listed") == 1).alias("listed"))
    marked = written(marked, "url-hosts")
    n, n_in = marked.agg(F.count("*"), F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0))).first()
    groups = max(1, math.ceil(1.1 * _size(n_in, n - n_in, 0)[0] / max_bits)) if n_in else 1
    if groups == 1:
        return _judged(urls, marked, rules)
    of = F.pmod(F.xxhash64("host", F.lit(3)), F.lit(groups))
    parts = [written(_judged(urls.where(of == g), marked.where(of == g), rules), "url-group") for g in range(groups)]
    return reduce(DataFrame.unionByName, parts)


def _judged(urls: DataFrame, hosts: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """hosts: host, listed; all hosts of the urls."""
    keys = candidates(F.col("host"), F.col("path"), rules)
    listed = {v: [h + p for h, p, verdict in rules if verdict == v] for v in ("block", "allow")}
    of_host = lambda c: F.concat(F.lit("="), c)  # noqa: E731  no rule's key begins so
    of_rules = urls.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct()
    universe = written(
        of_rules.select("key", F.col("key").isin(listed["block"]).alias("block"), F.col("key").isin(listed["allow"]).alias("allow")).unionByName(
            hosts.select(of_host("host").alias("key"), F.col("listed").alias("block"), F.lit(False).alias("allow"))
        ),
        "url-keys",
    )
    of_list = {v: Cascade(universe.select("key", F.col(v).alias("listed"))) for v in listed}
    rows = urls.withColumn("on_list", of_list["block"].contains(of_host(F.col("host"))))
    found = [F.when(of_list[v].contains(k), F.struct(F.length(k).alias("n"), k.alias("key"), F.lit(v).alias("verdict"))) for k in keys for v in listed]
    rows = rows.withColumn("found", F.greatest(*found))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("on_list"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("found.key").alias("rule"), verdict.alias("verdict"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP3_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN list_has_any(string_split(host, '.'), ['casino', 'clickbait', 'linkfarm', 'malware', 'phishing', 'pills', 'spam', 'spam-farm', 'warez']) THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""
