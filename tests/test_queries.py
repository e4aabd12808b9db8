"""Every registered query with SQL is compared with DuckDB on the smallest tables."""

import duckdb
import pytest

from graphloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(str(tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r)) for r in frame[cols].itertuples(index=False, name=None))


#: Long loops of supersteps, whose operators tests/test_partition.py and the shorter queries cover.
LONG = {"balance_clusters", "clusters_hem", "clusters_lp_hubs", "clusters_overlaid", "partition_frames", "refine_colored", "refine_jet"}


@pytest.mark.parametrize("name", sorted(set(registry.SQL) - LONG))
def test_query_matches_sql(spark, sf, db, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(db.execute(registry.SQL[name]).df())


def test_entry_and_queries_import():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark).toPandas()
    assert sorted(out["block"]) == [0, 1, 2, 3] and out["n_nodes"].sum() == 210
