"""Queries of the subpackage that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", ["op2_cross_polytope_dedup", "op3_target_mixing", "op4_minhash_dedup", "op5_warc_round_trip", "op9_tiered_sharding",
    "op10_suffix_dedup"])
def test_against_oracle(spark, name):
    import duckdb

    from folia.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in place)) for r in want.fetchall())


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
