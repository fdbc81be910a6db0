"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words are hashed to BUCKETS buckets each.  Two
multinomials over the buckets, one of trusted texts and one of the whole corpus,
give every n-gram a log ratio; a text's score is the mean over its n-grams, and
texts below a fixed threshold go.

All of it is DataFrame functions.  What is collected is one number a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
BUCKETS = 8192
SCALE = 1000
THRESHOLD = -0.1
#: Trusted ids (16 MB) up to which they are broadcast; more meet the documents by a shuffle.
BROADCAST_IDS = 1_000_000


def bind(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three which the array holds twice or more.

    Windows are sorted by hash; equal neighbours are repeats, and each repeat
    adds as many words as it reaches past the one before it.
    """
    n = F.size(words)
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    same = lambda s, k, x: F.coalesce(F.get(s, k).h == x.h, F.lit(False))
    repeats = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)), lambda x: x.i))
    covered = lambda p: F.when(F.size(p) > 1, F.aggregate(
        F.sequence(F.lit(1), F.size(p) - 1), F.lit(3).cast("long"), lambda m, k: m + F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)))).otherwise(F.lit(0).cast("long"))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(bind(windows, lambda s: bind(repeats(s), covered)))


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, words, and the base columns of every row of (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"), text.alias("text"))
    d = d.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets_at(words: Column, i: Column) -> tuple[Column, Column]:
    """Buckets of the word at i, and of it with its successor (the last word's pair ends the text)."""
    one = F.pmod(F.xxhash64(F.get(words, i)), F.lit(BUCKETS))
    two = F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(BUCKETS)) + BUCKETS
    return one.cast("int"), two.cast("int")


def places(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))


def bucket_counts(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows, and of those whose doc_id is in ``trusted``."""
    good = trusted.select("doc_id", F.lit(1).alias("good"))
    good = F.broadcast(good) if trusted.count() <= BROADCAST_IDS else good.hint("merge")
    flagged = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words")).join(good, "doc_id", "left")
    grams = F.flatten(F.transform(places(F.col("words")), lambda i: F.array(*buckets_at(F.col("words"), i))))
    return flagged.select("good", F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))


def log_ratios(counts: DataFrame) -> list[int]:
    """The log ratio of each bucket in thousandths; all 0 where nothing is trusted."""
    raw, target = [1.0] * (2 * BUCKETS), [1.0] * (2 * BUCKETS)
    for bucket, r, t in counts.collect():
        raw[bucket] += r
        target[bucket] += t
    out = [0] * (2 * BUCKETS)
    for k in (0, BUCKETS):
        all_raw, all_target = sum(raw[k : k + BUCKETS]), sum(target[k : k + BUCKETS])
        if all_target > BUCKETS:
            out[k : k + BUCKETS] = [round(SCALE * math.log(t / all_target * all_raw / r)) for r, t in zip(raw[k : k + BUCKETS], target[k : k + BUCKETS])]
    return out


def scored(counted: DataFrame, ratios: list[int]) -> DataFrame:
    """``counted`` rows with score, the mean log ratio of a row's n-grams, 0 for a row without words."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    value = lambda b: F.get(table, b)

    def gain(total, i):
        one, two = buckets_at(F.col("words"), i)
        return total + value(one) + value(two)

    total = F.aggregate(places(F.col("words")), F.lit(0).cast("long"), gain)
    return counted.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") * SCALE)).otherwise(F.lit(0.0)))


def quality_rules(documents: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, score and verdict of every row of (doc_id, text); other columns are ignored.

    ``trusted`` names the trusted texts by doc_id; both models count every row
    that is theirs.  Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, score and kept: false where the
    base rules fail, else score >= threshold.  A null text is an empty one.
    Repeated rows and null doc_ids are judged like any other row.  With nothing
    trusted every score is 0, and above a negative threshold.  An empty table
    gives an empty table.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    ratios = log_ratios(bucket_counts(documents, ids))
    out = scored(base_counts(documents), ratios)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
