"""The dependency-graph tables that the queries use, derived from the driver's tables by SQL that Spark and the oracle both read (`requires`, in Spark, by
a plan of its own).

{name} stands for a table. vid: kind * 1,000,000,000 + key, so insertion order is by kind, then key.
"""

from __future__ import annotations

import os
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

SQL = {
    "nodes": """
      SELECT 1000000000 + c_custkey AS vid, concat('customer:', c_custkey) AS id, 'customer' AS kind FROM {customer}
      UNION ALL SELECT 2000000000 + o_orderkey, concat('order:', o_orderkey), 'order' FROM {orders}
      UNION ALL SELECT 3000000000 + p_partkey, concat('part:', p_partkey), 'part' FROM {part}
      UNION ALL SELECT 4000000000 + s_suppkey, concat('supplier:', s_suppkey), 'supplier' FROM {supplier}
      UNION ALL SELECT 5000000000 + n_nationkey, concat('nation:', n_nationkey), 'nation' FROM {nation}
      UNION ALL SELECT 6000000000 + r_regionkey, concat('region:', r_regionkey), 'region' FROM {region}""",
    "edges": """
      SELECT 1000000000 + o_custkey AS src, 2000000000 + o_orderkey AS dst, 1 AS rel FROM {orders}
      UNION ALL SELECT DISTINCT 2000000000 + l_orderkey, 3000000000 + l_partkey, 2 FROM {lineitem}
      UNION ALL SELECT DISTINCT 3000000000 + l_partkey, 4000000000 + l_suppkey, 3 FROM {lineitem}
      UNION ALL SELECT 4000000000 + s_suppkey, 5000000000 + s_nationkey, 4 FROM {supplier}
      UNION ALL SELECT 1000000000 + c_custkey, 5000000000 + c_nationkey, 5 FROM {customer}
      UNION ALL SELECT 5000000000 + n_nationkey, 6000000000 + n_regionkey, 6 FROM {nation}""",
    "pnodes": "SELECT p_partkey AS vid, concat('p', p_partkey) AS id FROM {part}",
    "pedges": """
      SELECT DISTINCT src, dst, 1 AS rel FROM (
        SELECT p_partkey AS src, (7 * p_partkey + 1) % (SELECT count(*) FROM {part}) AS dst FROM {part}
        UNION ALL SELECT p_partkey, (13 * p_partkey + 5) % (SELECT count(*) FROM {part}) FROM {part}
        UNION ALL SELECT p_partkey, (p_partkey + 1) % (SELECT count(*) FROM {part}) FROM {part}) WHERE src <> dst""",
    "packages": """
      SELECT concat(name, '==', version) AS id, name, version, min(p_partkey) AS vid, max_by(ecosystem, p_partkey) AS ecosystem,
             nullif(max_by(coalesce(license, '?'), p_partkey), '?') AS license, max_by(p_brand, p_partkey) AS brand, max_by(p_size, p_partkey) AS size FROM (
        SELECT p_partkey, p_brand, p_size, replace(p_name, ' ', '-') AS name, concat(p_size % 5, '.', p_partkey % 10, '.', p_size) AS version,
               CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'rpm' WHEN p_brand IN ('Brand#4', 'Brand#5') THEN 'pypi' ELSE 'npm' END AS ecosystem,
               CASE p_type WHEN 'ECONOMY' THEN 'MIT' WHEN 'LARGE' THEN 'GPL-3.0-only' WHEN 'MEDIUM' THEN 'MIT OR Apache-2.0' WHEN 'PROMO' THEN NULL
                           WHEN 'SMALL' THEN 'BSD-3-Clause AND MIT' ELSE '' END AS license FROM {part}) AS t GROUP BY name, version""",
    "advisories": """
      SELECT concat('ADV-', p_brand) AS advisory, min(replace(p_name, ' ', '-')) AS package, concat(min(p_size) % 5, '.0') AS introduced,
             concat(max(p_size) % 5, '.', max(p_partkey) % 10, '.0') AS fixed, 'npm' AS ecosystem,
             CASE count(*) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE '9.8' END AS severity FROM {part} GROUP BY p_brand""",
    "requires": """
      SELECT DISTINCT a.pkg, b.cap FROM (SELECT DISTINCT l_orderkey, l_partkey AS pkg FROM {lineitem}) AS a
      JOIN (SELECT DISTINCT l_orderkey, l_partkey AS other, p_brand AS cap FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) AS b
      ON a.l_orderkey = b.l_orderkey AND a.pkg <> b.other""",
    "provides": "SELECT p_partkey AS pkg, p_brand AS cap FROM {part} WHERE p_size = 7 AND p_brand <> 'Brand#7'",
    "lefts": "SELECT id, name, version, license, ecosystem FROM ({packages}) AS l WHERE vid % 7 <> 0",
    "rights": """
      SELECT concat(name, '==', version) AS id, name, version, license, ecosystem FROM (
        SELECT name, CASE WHEN vid % 11 = 0 THEN concat(version, '.1') ELSE version END AS version, CASE WHEN vid % 13 = 0 THEN 'ISC' ELSE license END AS license,
               ecosystem FROM ({packages}) AS r WHERE vid % 5 <> 0) AS t""",
    "artifacts": """
      SELECT l_orderkey AS build, l_linenumber AS task, l_partkey AS part, replace(p_name, ' ', '-') AS name, concat(p_size, '.', l_partkey % 10) AS version,
             concat(l_linenumber, '.el9') AS release,
             CASE l_partkey % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'noarch' WHEN 2 THEN 'x86_64' WHEN 3 THEN 'aarch64' ELSE 'riscv64' END AS arch,
             concat(replace(p_name, ' ', '-'), CASE WHEN l_partkey % 9 = 0 THEN '-debuginfo' ELSE '' END, '-', p_size, '.', l_partkey % 10, '-', l_linenumber, '.el9.',
                    CASE l_partkey % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'noarch' WHEN 2 THEN 'x86_64' WHEN 3 THEN 'aarch64' ELSE 'riscv64' END, '.rpm') AS filename,
             l_returnflag AS status, l_linestatus AS signed, l_quantity AS seconds FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "logs": """
      SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, event_id, concat(CASE event_type WHEN 'error' THEN 'error: ' WHEN 'click' THEN 'warning: ' WHEN 'view' THEN 'file not found ' ELSE 'ok ' END, props) AS line
      FROM {events}""",
    "paths": "SELECT page_id, url FROM {pages}",
}


def _filled(name: str, tables: dict[str, str]) -> str:
    text = SQL[name]
    while "{packages}" in text:
        text = text.replace("{packages}", SQL["packages"])
    return text.format(**tables)


def requires(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The table `requires`: a line meets the brands of its order, not its other lines, and goes to its part with all of them in a row. Of the parts that
    have a brand the first and the last count: they are the line's own where no other has it."""
    brands = part.where("p_partkey IS NOT NULL").select(C("p_partkey").alias("pkg"), C("p_brand").alias("cap"), F.lit(True).alias("known"))
    lines = lineitem.where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL").select("l_orderkey", C("l_partkey").alias("pkg")).join(brands, "pkg", "left")
    same, order, known = Window.partitionBy("l_orderkey", "cap"), Window.partitionBy("l_orderkey"), F.when(C("known"), C("pkg"))
    ends = lines.repartition("l_orderkey").select("l_orderkey", "pkg", "cap", F.min(known).over(same).alias("first"), F.max(known).over(same).alias("last"))
    held = ends.select("pkg", F.collect_set(F.when(C("first").isNotNull(), F.struct("cap", "first", "last"))).over(order).alias("held"))
    caps = F.transform(F.filter("held", lambda x: (x["first"] != C("pkg")) | (x["last"] != C("pkg"))), lambda x: x["cap"])
    return held.select("pkg", caps.alias("caps")).where(F.size("caps") > 0).repartition("pkg").select("pkg", F.explode("caps").alias("cap")).distinct()


def table(spark, sf_dir: str, name: str, distinct: bool = True):
    """A driver table or a derived one. distinct False: rows may occur several times, for callers that merge them anyway."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "requires":
        return requires(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))
    used = [t for t in TABLES if f"{{{t}}}" in SQL[name] or ("{packages}" in SQL[name] and f"{{{t}}}" in SQL["packages"])]
    text = _filled(name, {t: f"{{{t}}}" for t in TABLES})
    return spark.sql(text if distinct else text.replace("SELECT DISTINCT", "SELECT"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


@cache
def derived(name: str) -> str:
    """The derived table as SQL for the oracle."""
    return _filled(name, {t: t for t in TABLES})


def with_(*names: str) -> str:
    """WITH and the derived tables, for an oracle."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({derived(n)})" for n in names) + os.linesep
