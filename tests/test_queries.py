"""Every registered query with SQL has a query of that name, and they agree on the smallest tables."""

import os

import pytest

DIR = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
@pytest.mark.parametrize("name", ["most_depended_upon", "requires_providers", "license_summary", "diff_classification", "advisory_matches", "purl", "npm_summary", "advisory_affected", "loaded_dot_reachable", "dependency_path_report", "report_counters", "report_status", "report_checks", "report_findings"])
def test_query_and_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = lambda frame: sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))
    assert rows(df.toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
def test_requires_holds_all_orders(spark):
    from depgrove.plans.derive import table

    brand = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{DIR}/part.parquet").collect()}
    orders = {}
    for r in spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    expected = {(a, brand[b]) for parts in orders.values() for a in parts for b in parts if a != b and b in brand}
    found = [tuple(r) for r in table(spark, DIR, "requires").select("pkg", "cap").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
