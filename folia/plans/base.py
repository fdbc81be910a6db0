"""Registration of queries, and the tables they share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, task_rows: int) -> DataFrame:
    """Rows dealt over a task for every ``task_rows`` of them, where much is made of a row that takes few bytes of its table."""
    return rows.repartition(max(1, -(-rows.count() // task_rows)))


def numbered(rows: DataFrame, task_rows: int = 1 << 16) -> DataFrame:
    """(file, doc_id, page_no): rows of (file, doc_id) numbered by doc_id from 0 in each file, without any text.

    doc_ids fall into ranges; a range is numbered by itself and moved by the
    counts of the file's ranges before, so one file's rows spread over tasks.
    """
    from pyspark.sql import Window as W

    r = rows.withColumn("range", F.floor(F.col("doc_id") / task_rows))
    counts = r.groupBy("file", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = r.withColumn("at", F.row_number().over(W.partitionBy("file", "range").orderBy("doc_id")) - 1).join(counts.select("file", "range",
        before.alias("before")), ["file", "range"])
    return placed.select("file", "doc_id", (F.col("before") + F.col("at")).alias("page_no"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of one file a source, numbered by doc_id from 0; texts are joined to their numbers."""
    d = load(spark, sf_dir, "documents")
    numbers = numbered(d.select(F.col("source").alias("file"), "doc_id"))
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(numbers, "doc_id").select("file", "page_no", "doc_id", "text")


PAGES = "pages_ AS (SELECT source AS file, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS page_no, doc_id, coalesce(text, '') AS text FROM documents)"
NORM = "replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
EVEN = "list_sort(list_distinct(list_transform(range(0, least({n}, {k})), i -> CAST(round_even(i * ({n} - 1.0) / greatest(1, least({n}, {k}) - 1), 0) AS BIGINT))))"
