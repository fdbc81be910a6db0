"""A quality classifier: naive Bayes log-count ratios feeding a linear hinge model.

Features are indicators of hashed n-grams of the whole text: byte trigrams,
words, and triples of "same word as the one before" flags.  Every indicator is
scaled by the log ratio of its smoothed counts in the two classes; the linear
model over the scaled indicators is fitted by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U64, text_blocks, word_hashes
from .runtime import discard, free_name, materialize

#: Bytes of text whose trigrams are hashed at once, and indicators of a class that the driver takes at most.
AT_ONCE, MOST_INDICATORS = 1 << 20, 16 << 20
BYTE_BITS, WORD_BITS = 16, 16
DIMENSION = (1 << BYTE_BITS) + (1 << WORD_BITS) + 8


def indicator_rows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every indicator that is set, in order of text."""
    texts = len(offsets) - 1
    flags = np.zeros((texts, DIMENSION), bool)
    owner = np.repeat(np.arange(texts, dtype=np.uint8 if texts < 256 else np.int64), np.diff(offsets))
    for a in range(0, len(buf) - 2, AT_ONCE):
        b = buf[a : a + AT_ONCE + 2].astype(np.uint32)
        gram = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        mine, last = owner[a : a + len(gram)], owner[a + 2 : a + 2 + len(gram)]
        inside = mine == last
        flags[mine[inside], ((gram * np.uint32(2654435761)) >> np.uint32(32 - BYTE_BITS))[inside]] = True
    w, at = word_hashes(buf, offsets)
    if len(w):
        of = np.repeat(np.arange(texts), np.diff(at))
        flags[of, (1 << BYTE_BITS) + (w >> U64(64 - WORD_BITS)).astype(np.int64)] = True
        again = np.zeros(len(w), np.int64)
        again[1:] = (w[1:] == w[:-1]) & (of[1:] == of[:-1])
        if len(w) > 2:
            triple = again[:-2] * 4 + again[1:-1] * 2 + again[2:]
            inside = of[:-2] == of[2:]
            flags[of[:-2][inside], (1 << BYTE_BITS) + (1 << WORD_BITS) + triple[inside]] = True
    where = np.flatnonzero(flags.ravel())
    return where // DIMENSION, where % DIMENSION


def indicator_parts(buf: np.ndarray, offsets: np.ndarray, texts: int = 128):
    """indicator_rows of at most ``texts`` texts at a time, which bounds their flags, and their number."""
    for a in range(0, len(offsets) - 1, texts):
        b = min(len(offsets) - 1, a + texts)
        yield *indicator_rows(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, DIMENSION), smooth)
    for r, g in zip(rows, good):
        counts[int(g), r] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, sign: np.ndarray, cost: float, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + cost * sum of hinge losses.

    Row i has the value values[f] at each feature f of rows[i], and a constant 1.
    """
    w, bias = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([(values[r] ** 2).sum() + 1 for r in rows])
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            r = rows[i]
            v = values[r]
            gradient = sign[i] * (w[r] @ v + bias) - 1
            after = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = (after - alpha[i]) * sign[i]
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = after
        if moved < 1e-6:
            break
    return w, bias


def train(documents: DataFrame, labels: DataFrame, per_class: int = 3000, cost: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights by feature, and bias, learnt from (doc_id, text) and (doc_id, good 0/1).

    At most ``per_class`` labelled documents of each class are used, those whose
    doc_id has the smallest hash, and of those no more than the first with
    MOST_INDICATORS indicators (64 MB) in all.  So what the driver holds is
    bounded.  Of rows that repeat a doc_id one counts.  With one class only, or
    none, the weights are 0 and the bias tells the class.
    """
    spark = documents.sparkSession
    usable = labels.where("doc_id IS NOT NULL AND good IN (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))
    picked = []
    for good in (0, 1):
        picked += [(r[0], good) for r in usable.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id").collect()]
    weights = np.zeros(DIMENSION, np.float32)
    if not picked:
        return weights, 0.0
    chosen = spark.createDataFrame(picked, "doc_id long, good int").coalesce(1)

    def run(batches):
        for batch in batches:
            good = batch.column("good").to_pylist()
            for row, buf, offsets in text_blocks(batch.column("text"), 1 << 20):
                packed = []
                for text, feature, n in indicator_parts(buf, offsets):
                    cut = np.searchsorted(text, np.arange(n + 1))
                    packed += [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(packed)), pa.array(good[row : row + len(packed)], pa.int32()),
                    pa.array(packed, pa.binary())], ["doc_id", "good", "features"])

    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one = sample.groupBy("doc_id", "good").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = materialize(one.select("doc_id", "text", "good").mapInArrow(run, "doc_id long, good int, features binary"), "indicators")
    fits, upto = [], {0: 0, 1: 0}  # at most 2 * per_class rows of four numbers
    for _, doc_id, kind, n in sorted(found.select(F.xxhash64("doc_id"), "doc_id", "good", F.length("features") / 4).collect()):
        upto[kind] += n
        if upto[kind] <= MOST_INDICATORS:
            fits.append((doc_id,))
    taken = found.join(F.broadcast(spark.createDataFrame(fits, "doc_id long")), "doc_id")
    got = sorted((r[0], r[1], bytes(r[2])) for r in taken.select("doc_id", "good", "features").collect())
    discard(found)
    rows = [np.frombuffer(f, np.int32) for _, _, f in got]
    good = np.array([g for _, g, _ in got], np.int64)
    if not len(rows) or good.min() == good.max():
        return weights, 0.0 if not len(rows) else float(2 * good[0] - 1)
    ratios = log_count_ratios(rows, good)
    w, bias = dual_coordinate_descent(rows, ratios, 2 * good - 1, cost)
    return (w * ratios).astype(np.float32), bias


def score(rows: DataFrame, weights: np.ndarray, bias: float, name: str = "score") -> DataFrame:
    """``rows``, which have a text, with a logistic of the margin, 0 to 1, as the column ``name``."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for _, buf, offsets in text_blocks(batch.column("text"), 1 << 20):
                out += [np.bincount(text, shared.value[feature], m) for text, feature, m in indicator_parts(buf, offsets)]
            chance = 1 / (1 + np.exp(-np.clip(2 * (np.concatenate(out) + bias), -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance)], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(documents: DataFrame, labels: DataFrame, per_class: int) -> tuple[np.ndarray, float]:
    """train() on (doc_id, quality) labels whose doc_id is not held out."""
    return train(documents, labels.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")), per_class)


def quality_scores(documents: DataFrame, labels: DataFrame, per_class: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents (doc_id, text).

    ``labels`` has (doc_id, quality).  Rows whose crc32(doc_id as text) mod 3 is
    1 are held out of learning.  A null or empty text scores by the bias alone;
    repeated rows score alike; a null doc_id is scored and not held out.
    Without labels every score is 0.5.  An empty table gives an empty table.
    """
    weights, bias = fitted(documents, labels, per_class)
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights, bias)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, per_class: int = 3000) -> DataFrame:
    """The rows of ``documents``, all columns, that quality_scores() predicts to be good."""
    weights, bias = fitted(documents, labels, per_class)
    name = free_name("score", *documents.columns)
    return score(documents, weights, bias, name).where(F.col(name) >= 0.5).drop(name)
