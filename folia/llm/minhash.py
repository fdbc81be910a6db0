"""Near-duplicate documents by one-permutation MinHash.

1. Every whole text becomes the set of its distinct word shingles, as 64-bit
   hashes.  One permutation splits the hash range into bins; each bin keeps its
   minimum and an empty bin borrows from a bin that a second hash of (bin,
   attempt) picks (optimal densification).
2. Documents with equal sets form a class and go on as one row.
3. Bands of the signature make buckets.  In a bucket every class is paired
   with the smallest one only (a star), so pairs grow with the bucket, not with
   its square.  Pairs are confirmed on full sets, and confirmed links joined to
   components.
4. A star can miss a link between two of its points.  So in buckets that still
   hold several components, the rows outside the largest are compared, in blocks,
   with all rows by full signature; what could be linked across components forms
   families, inside which every such pair is confirmed on full sets, again in
   blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, ascii_lower, mix64, signed, text_blocks, word_hashes
from .runtime import discard, materialize, release_shuffles

BINS = 128
ROWS_PER_BAND = 5
#: Rows of a bucket, and texts of a family, that a task compares with as many others.
BLOCK = 512
FAMILY = 400
SIGNATURE = "doc_id long, n_shingles long, set_hi long, set_lo long, signature binary"


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text with fewer words than a shingle has its whole sequence as the only
    one; a text without words has none.
    """
    low = ascii_lower(buf)
    w, at = word_hashes(low, offsets)
    weights = mix64(np.arange(1, words + 1, dtype=U64)) | U64(1)
    rolled = np.zeros(max(0, len(w) - words + 1), U64)
    for k in range(words):
        rolled += w[k : k + len(rolled)] * weights[k]
    rolled = mix64(rolled)
    for i in range(len(offsets) - 1):
        a, b = at[i], at[i + 1]
        n = b - a
        if n >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif n:
            yield mix64(np.array([(w[a:b] * weights[:n]).sum() + U64(n)], U64))
        else:
            yield np.zeros(0, U64)


_EDGES = np.arange(BINS, dtype=U64) << U64(64 - BINS.bit_length() + 1)
_PROBES = [(mix64(np.arange(BINS, dtype=U64) * U64(1_000_003) + U64(k + 1)) >> U64(32)).astype(np.int64) % BINS for k in range(64)]


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature (16 bits a bin) of sorted distinct hashes."""
    at = np.searchsorted(hashes, _EDGES)
    full = np.diff(np.append(at, len(hashes))) > 0
    low = np.zeros(BINS, U64)
    low[full] = hashes[at[full]]
    source = np.arange(BINS)
    missing = np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(missing):
            break
        pick = probe[missing]
        hit = full[pick]
        source[missing[hit]] = pick[hit]
        missing = missing[~hit]
    else:  # few bins are full: the next full one serves
        some = np.flatnonzero(full)
        source[missing] = some[np.searchsorted(some, missing) % len(some)]
    return (mix64(low[source]) >> U64(48)).astype(np.uint16)


def signatures(documents: DataFrame, words: int) -> DataFrame:
    """SIGNATURE rows of (doc_id, text), one for each row."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, buf, offsets in text_blocks(batch.column("text")):
                n, hi, lo, sig = [], [], [], []
                for s in shingle_sets(buf, offsets, words):
                    key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    n.append(len(s)), hi.append(key[0]), lo.append(key[1])
                    sig.append(one_permutation(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(n)), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary())],
                    ["doc_id", "n_shingles", "set_hi", "set_lo", "signature"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURE)


def bands(classes: DataFrame) -> DataFrame:
    """(band, doc_id, n): the buckets of each class."""
    count = BINS // ROWS_PER_BAND

    def run(batches):
        for batch in batches:
            m = len(batch)
            if not m:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(m, BINS)
            part = sig[:, : count * ROWS_PER_BAND].reshape(m, count, ROWS_PER_BAND).astype(U64)
            key = np.zeros((m, count), U64)
            for k in range(ROWS_PER_BAND):
                key = mix64(key * U64(0x9E3779B97F4A7C15) + part[:, :, k] + U64(1))
            key = mix64(key + np.arange(count, dtype=U64) * U64(0xD6E8FEB86659FD93))
            ids, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), count) for c in ("doc_id", "n_shingles"))
            yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), pa.array(ids), pa.array(n)], ["band", "doc_id", "n"])

    return classes.select("doc_id", "n_shingles", "signature").mapInArrow(run, "band long, doc_id long, n long")


def least_share(n: np.ndarray, percent: int) -> np.ndarray:
    """The share of equal bins below which a pair whose smaller set has ``n`` shingles is not confirmed.

    4.5 standard deviations under the threshold; a set fills no more bins than
    it has shingles, so small sets get more room.
    """
    p = percent / 100
    return p - 4.5 * np.sqrt(p * (1 - p) / np.clip(n, 1, BINS))


def similar_enough(sa: np.ndarray, sb: np.ndarray, least) -> np.ndarray:
    return (sa == sb).mean(axis=-1) >= least


def passing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and signatures leave the threshold possible."""
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("signature").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches):
        for batch in batches:
            m = len(batch)
            if m:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(m, BINS) for c in ("sa", "sb"))
                n = np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                ok = pa.array(similar_enough(sa, sb, least_share(n, percent)))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return wide.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, documents: DataFrame, words: int, percent: int, chunk: int = 64) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full shingle sets.

    The texts of the paired documents are sent to groups of one ``a`` and up to
    about ``chunk`` of its partners, so a hub's partners spread over tasks.
    """
    salt = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("k") / chunk)).cast("long"))
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("k")), "a")
    tasks = materialize(sized.select("a", "b", salt.alias("part")), "pairs")
    needs = tasks.select(F.col("b").alias("doc_id"), "a", "part", F.lit(True).alias("partner")).union(
        tasks.select(F.col("a").alias("doc_id"), "a", "part", F.lit(False).alias("partner")).distinct())
    sent = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needs.hint("merge"), "doc_id").repartition(
        F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "partner", "doc_id")

    def run(batches):
        group, hub = None, None
        for batch in batches:
            keys = list(zip(batch.column("a").to_pylist(), batch.column("part").to_pylist()))
            ids, partner = batch.column("doc_id").to_pylist(), batch.column("partner").to_pylist()
            found = []
            for row, buf, offsets in text_blocks(batch.column("text")):
                for i, s in enumerate(shingle_sets(buf, offsets, words), row):
                    if not partner[i]:
                        group, hub = keys[i], s
                    elif keys[i] == group:
                        both = len(np.intersect1d(hub, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(hub) + len(s) - both):
                            found.append((keys[i][0], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return sent.select("a", "part", "partner", "doc_id", "text").mapInArrow(run, "a long, b long").distinct()


class Roots:
    """A small union-find in which each item starts under a root it is given."""

    def __init__(self, root):
        names, self.of = np.unique(np.asarray(root), return_inverse=True)
        self.up = list(range(len(names)))

    def find(self, item: int) -> int:
        k = int(self.of[item])
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Deal the rows of each ``key`` to pairs (x, y) of blocks of about ``size``; ``k`` is the key's row count."""
    rows = rows.withColumn("blocks", F.ceil(F.col("k") / size).cast("long")).withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("other", "blocks", "k")


def in_stranger_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Deal (key, doc_id, root, ...) so that every pair of different roots of a key meets in one group (key, x, y).

    The rows outside a key's most frequent root are strangers.  They ask, in
    blocks x, the blocks y of all rows; rows that are asked have ``asks`` false.
    So a key's main part is copied once for each block of strangers, not for
    each block of its own.  Keys with one root drop out.
    """
    per = rows.groupBy(key, "root").agg(F.count("*").alias("n"))
    of = per.groupBy(key).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("k"), F.max("n").alias("m")).where("k > m")
    of = of.select(key, "main", F.ceil(F.col("k") / size).cast("long").alias("ys"), F.ceil((F.col("k") - F.col("m")) / size).cast("long").alias("xs"))
    block = lambda salt, count: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.col(count))
    every = lambda count, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), f)
    place = lambda x, y, asks: F.struct(x.alias("x"), y.alias("y"), F.lit(asks).alias("asks"))
    asked = every("xs", lambda x: place(x, block(1, "ys"), False))
    asking = F.when(F.col("stranger"), every("ys", lambda y: place(block(2, "xs"), y, True))).otherwise(F.array().cast("array<struct<x:long,y:long,asks:boolean>>"))
    placed = rows.join(of, key).withColumn("stranger", F.col("root") != F.col("main")).withColumn("at", F.explode(F.concat(asked, asking)))
    return placed.select("*", "at.x", "at.y", "at.asks").drop("main", "xs", "ys", "at")


def close_pairs(table: pa.Table, sig: np.ndarray, n: np.ndarray, percent: int):
    """(i, array of j) of a group's askers and the rows of other roots whose signatures leave the threshold possible.

    Two strangers ask each other; the one with the smaller doc_id counts.
    """
    root, ids = (table.column(c).to_numpy() for c in ("root", "doc_id"))
    asks, stranger = (table.column(c).to_numpy() for c in ("asks", "stranger"))
    asked = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks).tolist():
        j = asked[(root[asked] != root[i]) & (~stranger[asked] | (ids[asked] > ids[i]))]
        j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
        if len(j):
            j = j[similar_enough(sig[j], sig[i], least_share(np.minimum(n[j], n[i]), percent))]
            if len(j):
                yield i, j


def families(band_rows: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(id, family): groups in which every pair that the stars could have missed lies.

    In each bucket that still holds several components the pairs across them
    are compared by signature, in blocks, and joined to local clusters; only a
    star of each cluster leaves the task.
    """
    state = band_rows.join(roots.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    rows = in_stranger_blocks(state, "band", BLOCK).join(classes.select("doc_id", "signature"), "doc_id")

    def compare(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(table.num_rows, BINS)
        ids, n = (table.column(c).to_numpy() for c in ("doc_id", "n"))
        local = Roots(ids)
        for i, js in close_pairs(table, sig, n, percent):
            for j in js.tolist():
                local.join(i, j)
        low = np.unique(ids)[[local.find(i) for i in range(table.num_rows)]]
        far = low != ids
        return pa.table({"u": ids[far], "v": low[far]})

    columns = ("band", "x", "y", "asks", "stranger", "doc_id", "root", "n", "signature")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much to compare
    stars = rows.select(*columns).repartition(spread, "band", "x", "y").groupBy("band", "x", "y").applyInArrow(compare, "u long, v long")
    return connected_components(stars).withColumnRenamed("root", "family")


def late_links(family: DataFrame, roots: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) across components inside families, on full sets.

    A family goes to tasks in blocks of at most about FAMILY texts that ask and
    are asked; a pair whose components a task has joined already is not tested
    again.
    """
    rooted = family.withColumnRenamed("id", "doc_id").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    members = materialize(in_stranger_blocks(rooted.withColumn("root", F.coalesce("root", "doc_id")), "family", FAMILY), "members")
    sent = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members.hint("merge"), "doc_id")

    def verify(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        sets = [s for _, buf, offsets in text_blocks(table.column("text")) for s in shingle_sets(buf, offsets, words)]
        full = np.array([len(s) > 0 for s in sets])
        sig = np.stack([one_permutation(s) if len(s) else np.zeros(BINS, np.uint16) for s in sets])
        n = np.array([len(s) for s in sets])
        local, found = Roots(table.column("root").to_numpy()), []
        for i, js in close_pairs(table, sig, n, percent):
            for j in js.tolist():
                if full[i] and full[j] and local.find(i) != local.find(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        local.join(i, j)
                        found.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    columns = ("family", "x", "y", "asks", "stranger", "doc_id", "root", "text")
    return sent.select(*columns).groupBy("family", "x", "y").applyInArrow(verify, "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """Components of documents linked by shingle-set similarity.

    Input (doc_id, text), other columns are ignored.  Returns (doc_id,
    n_shingles, component_id, kept) for every input row; component_id is the
    smallest doc_id reachable by links, itself included.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their distinct shingles of ``words`` words (A-Z lower-cased, words are runs
    of bytes other than space and 0x09-0x0D).  Fewer words make one shingle.  A
    null or wordless text has an empty set, links with nothing and is kept.
    Rows that repeat a doc_id are judged each by its own text.  A null doc_id takes part in
    nothing: its component is null and it is kept.  An empty table gives an
    empty table.
    """
    spark = documents.sparkSession
    sig = materialize(signatures(documents, words), "signatures")
    usable = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(
        usable.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")),
        "classes")
    band_rows = materialize(bands(classes), "bands")
    hubs = band_rows.groupBy("band").agg(F.min("doc_id").alias("a"), F.count("*").alias("k")).where("k > 1")
    shared = band_rows.join(hubs.select("band", "a"), "band")
    stars = shared.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    tested = materialize(passing(stars, classes, percent), "stars")
    links = materialize(confirmed(tested, documents, words, percent), "links")
    release_shuffles(spark)
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    family = materialize(families(band_rows, classes, roots, percent), "families")
    if family.take(1):
        late = materialize(late_links(family, roots, documents, words, percent), "links")
        if late.take(1):
            roots = connected_components(links.union(late).select(F.col("a").alias("u"), F.col("b").alias("v")))
    discard(band_rows, tested, family)
    release_shuffles(spark)
    out = sig.select("doc_id", "n_shingles", "set_hi", "set_lo").join(
        classes.select("set_hi", "set_lo", F.col("doc_id").alias("v")), ["set_hi", "set_lo"], "left").join(
        roots.select(F.col("id").alias("v"), "root"), "v", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "v", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each_group(documents: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``documents``, all columns, that near_duplicates() keeps, one for each doc_id.

    Of rows that repeat a doc_id that stays whose text has the smallest hash,
    whatever the run.  Rows with a null doc_id all stay.
    """
    kept = near_duplicates(documents, words, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    whole = documents.select(F.col("doc_id").cast("long").alias("kept_id"), F.col("text").alias("kept_text"), F.struct("*").alias("whole"))
    named = whole.join(kept, "kept_id", "left_semi").groupBy("kept_id").agg(F.min_by("whole", F.struct(F.xxhash64("kept_text"), "kept_text")).alias("whole"))
    return named.select("whole.*").union(documents.where("doc_id IS NULL"))
