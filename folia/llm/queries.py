"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame.

Each one applies its operator, with the parameters meant for production, to its
whole table, and derives the digest columns from the operator's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_llr_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op2_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op3_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken_per_document

    return taken_per_document(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), sequence=4096, end_id=1)


def op8_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    rows, told = sharded(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "lang", "source", "n_chars", *[F.lit(v).cast("long").alias(k) for k, v in told.items()],
            F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), length=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_llr_quality_rules, op2_cross_polytope_dedup, op3_target_mixing, op4_minhash_dedup, op5_warc_round_trip,
    op6_html_main_text, op7_sum_of_squares_packing, op8_nb_svm_quality, op9_tiered_sharding, op10_suffix_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op2_cross_polytope_dedup": oracles.EMBEDDINGS,
    "op3_target_mixing": oracles.MIXING,
    "op4_minhash_dedup": oracles.DOCUMENTS,
    "op10_suffix_dedup": oracles.REPEATS,
    "op9_tiered_sharding": """
        WITH d AS (SELECT *, CAST('0x' || substr(md5(concat_ws('-', doc_id)), 1, 12) AS BIGINT) % 84 AS share FROM documents)
        SELECT doc_id, lang, source, n_chars, octet_length(encode(text)) AS n_bytes, sha256(text) AS text_sha256,
               (SELECT count(DISTINCT CASE WHEN share < 7 THEN share ELSE 7 + share % 14 END) FROM d) AS n_arrivals,
               (SELECT count(*) FROM documents) AS version_rows, 0::BIGINT AS n_full_tiers, 0::BIGINT AS n_oversized
        FROM d
    """,
    "op5_warc_round_trip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
}
