"""From raw documents to packed training sequences.

Each stage takes (spark, documents, sf_dir), works on all rows its predecessor
kept and returns rows with the columns of ``documents``, the last one packed
pieces.  Stages are written as Parquet in the shared folder and read again, so a
lost executor costs the tasks it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folia.llm.classifier import good_documents
from folia.llm.minhash import one_of_each_group
from folia.llm.mixing import mixed_documents
from folia.llm.packing import pack_documents
from folia.llm.runtime import discard_since, materialize, written
from folia.llm.suffix_dedup import documents_without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, predicts to be good."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of five-word shingles): that with the smallest doc_id."""
    return one_of_each_group(docs, words=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier in the corpus."""
    return documents_without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix of sources takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: Hashing, suffix arrays and the tokenizer have no SQL form; the test compares each stage with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; once a stage is written, what it and those before needed is deleted."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
            discard_since(spark, mark, docs)
    return docs
