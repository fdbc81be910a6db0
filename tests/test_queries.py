"""Every registered query with an oracle against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op"))
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(NAMES) > 70


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SMALL)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert ours == sorted(repr(tuple(r[k] for k in place)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["tile_coverage", "p95_white_point", "ink_fraction", "page_class_ladder"])
def test_pixels_of_odd_vectors(spark, tmp_path, name):
    """Components whose pixel depends on single precision, and vectors that are repeated, short, long, empty or hold no number."""
    import duckdb

    near = [0.17843136, 0.19411764, 0.20980391, 0.22549018]
    vectors = [[x] * 64 for x in near] + [near * 16, near * 5, near * 40, [], None, [None, float("nan"), float("inf"), float("-inf")] * 16]
    rows = [(k, v, 0) for k, v in enumerate(vectors)] + [(0, near * 16, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
