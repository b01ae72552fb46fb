"""Queries against their DuckDB oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each shape; all of them run in the driver's check.
CHOSEN = ["prp_dom", "prp_fp_dif", "prp_key", "prp_npa2", "prp_spo2", "cls_int1", "cls_maxqc3", "cax_adc", "scm_svf1", "eq_diff1", "dt_type2", "dt_eq", "closure_geography", "same_as_components"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("query", CHOSEN)
def test_query(spark, duck, query):
    ours = __spark_entry__.queries()[query](spark, SF).toPandas()
    theirs = duck.sql(__spark_entry__.oracle_sql()[query]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours)
    assert sorted(ours[columns].itertuples(index=False, name=None)) == sorted(theirs[columns].itertuples(index=False, name=None))


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["s", "p", "o"]
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
