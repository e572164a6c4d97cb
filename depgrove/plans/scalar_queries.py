"""Registered queries for column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import versions as V
from .derive import table, with_

C = F.col


def _pairs(spark, sf):
    """Each package beside the part that follows it: two versions of different parts."""
    p = table(spark, sf, "part")
    a = p.select(C("p_partkey").alias("k"), F.concat((C("p_size") % 5).cast("string"), F.lit("."), (C("p_partkey") % 10).cast("string"), F.when(C("p_size") % 3 == 0, "RC1").otherwise("")).alias("v"))
    b = p.select((C("p_partkey") - 1).alias("k"), F.concat((C("p_size") % 5).cast("string"), F.lit("."), (C("p_partkey") % 10).cast("string"), F.when(C("p_size") % 3 == 1, ".beta").otherwise("")).alias("w"))
    return a.join(b, "k")


def _order(key):
    return lambda s, d: _pairs(s, d).select("k", "v", "w", F.when(key(C("v")) < key(C("w")), -1).when(key(C("v")) > key(C("w")), 1).otherwise(0).alias("cmp"))


PAIRS = """a AS (SELECT p_partkey AS k, concat(p_size % 5, '.', p_partkey % 10, CASE WHEN p_size % 3 = 0 THEN 'RC1' ELSE '' END) AS v FROM part),
 b AS (SELECT p_partkey - 1 AS k, concat(p_size % 5, '.', p_partkey % 10, CASE WHEN p_size % 3 = 1 THEN '.beta' ELSE '' END) AS w FROM part)"""


def _cmp(word_first: str) -> str:
    key = lambda c: f"list_transform(regexp_extract_all({c}, '\\d+|[A-Za-z]+'), lambda t: {{'i': {word_first}, 'n': coalesce(TRY_CAST(t AS BIGINT), 0), 's': CASE WHEN regexp_matches(t, '^[0-9]') THEN '' ELSE lower(t) END}})"
    return f"WITH {PAIRS} SELECT k, v, w, CASE WHEN {key('v')} < {key('w')} THEN -1 WHEN {key('v')} > {key('w')} THEN 1 ELSE 0 END::INT AS cmp FROM a JOIN b USING (k)"


def _purl(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", C("p_name").alias("name"), (C("p_size").cast("string")).alias("version"), F.element_at(F.array(*map(F.lit, ("npm", "pypi", "rpm", "maven", "oci", "cargo", "other"))), (C("p_partkey") % 7 + 1).cast("int")).alias("eco"))
    name = F.when(C("eco") == "npm", F.concat(F.lit("@Sc~/"), "name")).when(C("eco") == "maven", F.concat(F.lit("Org.x:"), "name")).when(C("eco") == "oci", F.concat(F.lit("reg/img:"), "name")).otherwise(C("name"))
    meta = F.create_map(*map(F.lit, ("arch", "x86_64", "vendor", "Alma Linux", "epoch", "1", "distro", "el 9"))).cast("map<string,string>")
    grouped = F.when((C("eco") == "maven") & (C("p_partkey") % 2 == 0), F.map_concat(meta, F.create_map(F.lit("group"), F.lit("Org.x")))).otherwise(meta)
    return p.withColumn("full", name).select("p_partkey", N.purl(C("eco"), C("full"), C("version"), grouped).alias("purl"))


def _allows(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat((C("p_size") % 4).cast("string"), F.lit("."), (C("p_partkey") % 6).cast("string"), F.lit("."), (C("p_size") % 3).cast("string")).alias("version"))
    rules = F.array(*map(F.lit, ("^1.2.0", "~2.1", ">=1.0.0, <2.3.0", "0.1.0 || 3.2.1", "*", "==1.1.1", "^0.2.1")))
    return p.withColumn("constraint", F.element_at(rules, (C("p_partkey") % 7 + 1).cast("int"))).select("p_partkey", V.allows(C("constraint"), C("version")).alias("allowed"))


NUM = "(split_part(version, '.', 1)::INT * 10000 + split_part(version, '.', 2)::INT * 100 + split_part(version, '.', 3)::INT)"

def _typos(spark, sf):
    """Popular names with one character taken out, or none, some with one more at the end: a name for each part."""
    key = C("p_partkey").cast("int")
    base, cut = F.get(F.array(*map(F.lit, N.POPULAR)), key % len(N.POPULAR)), F.floor(key / len(N.POPULAR)).cast("int") % 12
    text = F.concat(F.substr(base, F.lit(1), cut), F.substr(base, cut + 2), F.when(key % 5 == 0, "s").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", F.when(key % 2 == 0, F.upper(text)).otherwise(text).alias("name"))


QUERIES = {
    "purl": _purl,
    "id_split": lambda s, d: table(s, d, "packages").select(F.concat("id", F.lit("==x")).alias("id")).select("id", N.split_id(C("id"))[0].alias("name"), N.split_id(C("id"))[1].alias("version")),
    "rpm_filename": lambda s, d: table(s, d, "artifacts").select("filename").distinct().select("filename", N.rpm_file(C("filename")).alias("f")).select("filename", "f.*"),
    "nevra": lambda s, d: table(s, d, "artifacts").select(F.concat("name", F.lit("-1:"), "version", F.lit("-"), "release", F.lit("."), "arch").alias("text")).distinct().select("text", N.nevra(C("text")).alias("n")).select("text", "n.*"),
    "constraint_allows": _allows,
    "version_order": lambda s, d: table(s, d, "packages").select("version").distinct().select("version", F.struct(V.parts_key(C("version"))["a"], V.parts_key(C("version"))["b"], V.parts_key(C("version"))["c"]).alias("k")).select("version", (C("k.a") * 10000 + C("k.b") * 100 + C("k.c")).cast("int").alias("position")),
    "advisory_version_cmp": _order(V.advisory_key),
    "diff_version_cmp": _order(V.diff_key),
    "version_change_kind": lambda s, d: _pairs(s, d).groupBy(V.change_kind(C("v"), C("w")).alias("kind")).agg(F.count("*").alias("n")),
    "range_match": lambda s, d: table(s, d, "part").select("p_partkey", F.concat((C("p_size") % 7).cast("string"), F.lit("."), (C("p_partkey") % 10).cast("string")).alias("version")).select("p_partkey", V.in_range(C("version"), F.lit("1.5"), F.lit("4.2")).alias("affected")),
    "version_candidates": lambda s, d: table(s, d, "artifacts").select("version", "release", "arch").distinct().select("version", "release", "arch", F.array_join(V.rpm_candidates(F.concat("version", F.lit("-"), "release", F.lit("."), "arch"), C("version"), C("release"), F.when(C("arch") == "noarch", "2").otherwise("0"), C("arch")), "|").alias("candidates")),
    "severity_rank": lambda s, d: table(s, d, "advisories").select("advisory", N.severity_rank(C("severity")).alias("rank")),
    "purl_candidates": lambda s, d: table(s, d, "packages").select("id", F.array_join(N.purl_forms(F.concat(F.lit("pkg:rpm/a%2Bb/"), "name", F.lit("?arch=src"))), "|").alias("forms"), N.purl_name(F.concat(F.lit("pkg:npm/"), "name", F.lit("@"), "version", F.lit("?x=1"))).alias("purl_name")),
    "license_tokens": lambda s, d: table(s, d, "packages").where("license IS NOT NULL").select("id", F.array_join(N.license_tokens(C("license")), ",").alias("tokens")),
    "edit_distance": lambda s, d: table(s, d, "documents").select("doc_id", F.lower(F.regexp_extract("text", r"^(\w+)", 1)).alias("w")).select("doc_id", "w", (F.levenshtein("w", F.lit("then"), 1) >= 0).alias("near")).where(F.length("w") > 0),
    "lookalikes": lambda s, d: _typos(s, d).select("p_partkey", "name", N.lookalike(C("name")).alias("target")),
    "arch_order": lambda s, d: table(s, d, "artifacts").select("arch").distinct().select("arch", N.arch_rank(C("arch"), N.TIMING_ORDER).cast("long").alias("timing"), N.arch_rank(C("arch"), N.INVENTORY_ORDER).cast("long").alias("inventory")),
    "durations": lambda s, d: table(s, d, "events").select("event_id", N.seconds(F.concat((C("event_id") % 3).cast("string"), F.lit(":"), (C("event_id") % 60).cast("string"), F.lit(":"), F.lit("07.5"))).alias("seconds"), ((F.unix_micros(C("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6).alias("wall")),
    "pypi_names": lambda s, d: table(s, d, "packages").select("id", N.pypi_name(F.concat(F.lit("A_"), "name", F.lit(".x"))).alias("normal")),
    "artifact_kinds": lambda s, d: table(s, d, "artifacts").groupBy(N.artifact_kind(C("filename")).alias("kind")).agg(F.count("*").alias("n")),
    "changed_keys": lambda s, d: _meta_changes(s, d),
    "wall_seconds": lambda s, d: table(s, d, "events").select("event_id", N.wall_seconds(F.date_format(C("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(C("event_id") % 5 == 0, "never").otherwise("2025-01-01 00:00:00.25")).alias("seconds")),
    "timing_files": lambda s, d: table(s, d, "artifacts").select("filename").distinct().withColumn("filename", F.when(F.length("filename") % 4 == 0, F.concat("filename", F.lit(".log"))).otherwise(C("filename"))).select("filename", N.timing_file(C("filename")).alias("f")).select("filename", "f.*"),
    "slugs": lambda s, d: table(s, d, "pages").select("page_id", N.slug(C("url")).alias("slug")),
    "transaction_packages": lambda s, d: table(s, d, "artifacts").select("name", "version", "release", "arch").distinct().select(F.concat("name", F.lit("-3:"), "version", F.lit("-"), "release", F.lit("."), "arch", F.lit(".rpm")).alias("text")).select("text", N.transaction_package(C("text")).alias("p")).select("text", "p.*"),
}


def _meta_changes(spark, sf):
    l, r = table(spark, sf, "lefts"), table(spark, sf, "rights")
    meta = lambda df, a: df.select("id", F.map_filter(F.create_map(F.lit("license"), "license", F.lit("ecosystem"), "ecosystem"), lambda k, v: v.isNotNull()).alias(a))
    both = meta(l, "l").join(meta(r, "r"), "id").select("id", F.array_join(N.changed_keys(C("l"), C("r")), ",").alias("changed"))
    return both.where("changed <> ''")


PK = with_("packages")

SQL = {
    "purl": f"""WITH p AS (SELECT p_partkey, p_name AS name, p_size::VARCHAR AS version, p_partkey % 7 AS e, replace(p_name, ' ', '%20') AS n FROM part)
      SELECT p_partkey, CASE e WHEN 0 THEN concat('pkg:npm/%40Sc~/', n, '@', version) WHEN 1 THEN concat('pkg:pypi/', lower(n), '@', version)
        WHEN 2 THEN concat('pkg:rpm/alma%20linux/', n, '@', version, '?arch=x86_64&distro=el+9&epoch=1')
        WHEN 3 THEN concat('pkg:maven/Org.x', CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '%3A' END, n, '@', version)
        WHEN 4 THEN concat('pkg:oci/reg/img:', n, '@', version) WHEN 5 THEN concat('pkg:cargo/', lower(n), '@', version) ELSE concat('pkg:generic/', n, '@', version) END AS purl FROM p""",
    "id_split": PK + "SELECT concat(id, '==x') AS id, name, concat(version, '==x') AS version FROM packages",
    "rpm_filename": with_("artifacts") + """SELECT DISTINCT filename, regexp_extract(filename, '^(.*)-([^-]*)-([^-]*)[.]([^.]*)[.]rpm$', 1) AS name, regexp_extract(filename, '^(.*)-([^-]*)-([^-]*)[.]([^.]*)[.]rpm$', 2) AS version,
      regexp_extract(filename, '^(.*)-([^-]*)-([^-]*)[.]([^.]*)[.]rpm$', 3) AS release, regexp_extract(filename, '^(.*)-([^-]*)-([^-]*)[.]([^.]*)[.]rpm$', 4) AS arch FROM artifacts""",
    "nevra": with_("artifacts") + "SELECT DISTINCT concat(name, '-1:', version, '-', release, '.', arch) AS text, name, '1' AS epoch, version, release, arch FROM artifacts",
    "constraint_allows": f"""WITH p AS (SELECT p_partkey, concat(p_size % 4, '.', p_partkey % 6, '.', p_size % 3) AS version FROM part)
      SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN {NUM} >= 10200 AND {NUM} < 20000 WHEN 1 THEN {NUM} >= 20100 AND {NUM} < 20200 WHEN 2 THEN {NUM} >= 10000 AND {NUM} < 20300
        WHEN 3 THEN {NUM} IN (100, 30201) WHEN 4 THEN true WHEN 5 THEN {NUM} = 10101 ELSE {NUM} >= 201 AND {NUM} < 300 END AS allowed FROM p""",
    "version_order": PK + f"SELECT DISTINCT version, {NUM} AS position FROM packages",
    "advisory_version_cmp": _cmp("regexp_matches(t, '^[0-9]')::INT"),
    "diff_version_cmp": _cmp("regexp_matches(t, '^[A-Za-z]')::INT"),
    "version_change_kind": "WITH c AS (" + _cmp("regexp_matches(t, '^[A-Za-z]')::INT") + ") SELECT CASE cmp WHEN -1 THEN 'upgrade' WHEN 1 THEN 'downgrade' ELSE 'replacement' END AS kind, count(*) AS n FROM c GROUP BY 1",
    "range_match": "SELECT p_partkey, (p_size % 7) * 10 + p_partkey % 10 BETWEEN 15 AND 41 AS affected FROM part",
    "version_candidates": with_("artifacts") + "SELECT DISTINCT version, release, arch, concat(version, '-', release, '.', arch, '|', version, '|', version, '-', release, CASE WHEN arch = 'noarch' THEN concat('|2:', version, '-', release) ELSE '' END) AS candidates FROM artifacts",
    "severity_rank": with_("advisories") + "SELECT advisory, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS rank FROM advisories",
    "purl_candidates": PK + "SELECT id, concat('pkg:rpm/a+b/', name, '?arch=src|pkg:rpm/a+b/', name) AS forms, name AS purl_name FROM packages",
    "license_tokens": PK + """SELECT id, CASE license WHEN 'MIT OR Apache-2.0' THEN 'mit,apache-2.0' WHEN 'BSD-3-Clause AND MIT' THEN 'bsd-3-clause,mit' ELSE lower(license) END AS tokens FROM packages WHERE license IS NOT NULL""",
    "edit_distance": r"SELECT doc_id, w, levenshtein(w, 'then') <= 1 AS near FROM (SELECT doc_id, lower(regexp_extract(text, '^([A-Za-z0-9_]+)', 1)) AS w FROM documents) WHERE length(w) > 0",
    "lookalikes": """WITH pop AS (SELECT unnest(['react', 'lodash', 'express', 'webpack', 'typescript', 'eslint', 'axios', 'next', 'vite']) AS p), b AS (SELECT p_partkey, ['react', 'lodash', 'express', 'webpack', 'typescript', 'eslint', 'axios', 'next', 'vite'][p_partkey % 9 + 1] AS base, p_partkey // 9 % 12 AS cut FROM part),
      n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(x) ELSE x END AS name FROM (SELECT p_partkey, concat(substr(base, 1, cut), substr(base, cut + 2), CASE WHEN p_partkey % 5 = 0 THEN 's' ELSE '' END) AS x FROM b))
      SELECT p_partkey, name, CASE WHEN lower(name) NOT IN (SELECT p FROM pop) THEN (SELECT min(p) FROM pop WHERE levenshtein(lower(name), p) = 1) END AS target FROM n""",
    "arch_order": with_("artifacts") + "SELECT DISTINCT arch, CASE arch WHEN 'x86_64' THEN 1 WHEN 'aarch64' THEN 2 WHEN 'src' THEN 6 WHEN 'noarch' THEN 7 ELSE 8 END::BIGINT AS timing, CASE arch WHEN 'x86_64' THEN 1 WHEN 'aarch64' THEN 2 WHEN 'noarch' THEN 6 WHEN 'src' THEN 7 ELSE 8 END::BIGINT AS inventory FROM artifacts",
    "durations": "SELECT event_id, ((event_id % 3) * 3600 + (event_id % 60) * 60 + 7.5)::DOUBLE AS seconds, epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6 AS wall FROM events",
    "pypi_names": PK + "SELECT id, concat('a-', lower(name), '-x') AS normal FROM packages",
    "artifact_kinds": with_("artifacts") + "SELECT CASE WHEN arch = 'src' THEN 'srpm' WHEN filename LIKE '%-debuginfo-%' THEN 'debug' WHEN arch = 'noarch' THEN 'noarch' ELSE 'binary' END AS kind, count(*) AS n FROM artifacts GROUP BY 1",
    "wall_seconds": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(TIMESTAMP '2025-01-01 00:00:00.25' - date_trunc('second', ts)) / 1e6 END AS seconds FROM events",
    "timing_files": with_("artifacts").rstrip() + """, f AS (SELECT DISTINCT filename, regexp_extract(filename, '^(.*)-[^-]*-[^-]*[.][^.]*[.]rpm$', 1) AS name, arch FROM artifacts)
      SELECT CASE WHEN length(filename) % 4 = 0 THEN concat(filename, '.log') ELSE filename END AS filename, CASE WHEN length(filename) % 4 = 0 THEN '' ELSE name END AS name, CASE WHEN length(filename) % 4 = 0 THEN 'non-rpm' ELSE arch END AS arch FROM f""",
    "slugs": "SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'report') AS slug FROM pages",
    "transaction_packages": with_("artifacts") + """SELECT DISTINCT concat(name, '-3:', version, '-', release, '.', arch, '.rpm') AS text, name, '3' AS epoch, version, release, arch, concat(name, '==', version, '-', release, '.', arch) AS node,
      concat('pkg:rpm/', name, '@', version, '-', release, '?arch=', arch, '&epoch=3') AS purl FROM artifacts""",
    "changed_keys": with_("lefts", "rights") + """SELECT l.id, concat_ws(',', CASE WHEN l.ecosystem IS DISTINCT FROM r.ecosystem THEN 'ecosystem' END, CASE WHEN l.license IS DISTINCT FROM r.license THEN 'license' END) AS changed
      FROM lefts l JOIN rights r ON l.id = r.id WHERE l.ecosystem IS DISTINCT FROM r.ecosystem OR l.license IS DISTINCT FROM r.license""",
}
