"""Every registered query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from fieldmark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return cols, sorted(repr([plain(v) for v in r]) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


def test_spanish_addresses_with_house_numbers_of_five_digits(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"create view one as select * from '{SF}/supplier.parquet'")
    con.sql(f"copy (select one.* replace (s_suppkey + shift as s_suppkey) from one, (select unnest([0, 9994, 54321, 99998]) as shift)) to '{tmp_path}/supplier.parquet'")
    con.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
    assert rows(registry.queries()["es_address"](spark, str(tmp_path)).toPandas()) == rows(con.sql(registry.oracle_sql()["es_address"]).df())


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_clusters_of_all_markers(spark):
    got = registry.queries()["marker_clusters"](spark, SF).collect()
    placed = registry.table(spark, SF, "customer").where("c_custkey % 181 <> 90 and c_custkey * 7 % 361 <> 180").count()
    assert {z: sum(r.n for r in got if r.zoom == z) for z in (3, 2)} == {3: placed, 2: placed}


def test_every_query_has_sql_or_a_test():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"marker_clusters"}
