"""Near-duplicate embeddings by cross-polytope hashing.

A table's code joins HASHES cross-polytope hashes: the vector is turned by
three rounds of random signs and a fast Hadamard transform, and hashed to the
signed axis nearest to it.  Every vector is stored in one bucket a table and
looks into PROBES buckets, the likeliest by distance lost.

1. Buckets hold ids and sketches of 64 signs only.  Rows that no other row of
   their bucket comes near by sketch drop out, which are nearly all that meet
   by chance.
2. The rest fetch their vectors, and pairs are verified by cosine in double
   precision.  A pair can meet in several buckets; it counts in the first only,
   which both sides can tell from their codes.  So no pair leaves a task: a task
   returns counts, and a spanning forest of what it has linked.
3. Buckets of more than BLOCK rows go to tasks as pairs of blocks.

At cosine 0.95 a table finds a pair of 64 dimensions with probability 0.59, one
of 768 with 0.39; eleven tables, and nineteen, miss 5 and 8 in 100,000.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .kernels import U64, mix64
from .minhash import in_blocks
from .runtime import discard, materialize

HASHES, PROBES, DEPTH, SKETCH = 3, 4, 4, 64
BLOCK = 2000
#: Rows that a task turns, and verifies, at once.
AT_ONCE = 2048


def tables(dimensions: int) -> int:
    return 11 if dimensions <= 64 else 19


def hadamard(n: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, in single precision."""
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def turned(vectors: np.ndarray, number: int) -> np.ndarray:
    """Each row under rotation ``number``: three rounds of signs and a Walsh-Hadamard transform, not normalised.

    The transform is fast: a row is a grid of about sqrt(n) by sqrt(n), and the
    small transform goes over its rows, then over its columns.  Axes come out
    in the grid's other order, which is the same for every row.
    """
    v, n = vectors, vectors.shape[1]
    across = 1 << ((n.bit_length() - 1) // 2)
    down = n // across
    rows, columns = hadamard(across), hadamard(down)
    for turn in range(3):
        salt = U64((number * 3 + turn) * n + 99)
        v = v * np.where(mix64(np.arange(n, dtype=U64) + salt) >> U64(63), np.float32(1), np.float32(-1))
        v = (v.reshape(-1, across) @ rows).reshape(-1, down, across).transpose(0, 2, 1).reshape(-1, down)
        v = (v @ columns).reshape(-1, n)
    return v


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sketches) of unit vectors: 32-bit codes of the buckets (row, table, probe), their own first, and 64 signs."""
    n, d = unit.shape
    width = max(8, 1 << (d - 1).bit_length())
    wide = np.zeros((n, width), np.float32)
    wide[:, :d] = unit
    ranks = np.array(list(itertools.product(range(DEPTH), repeat=HASHES)))
    out = np.zeros((n, tables(d), PROBES), np.uint32)
    row = np.arange(n)
    for t in range(tables(d)):
        cost, code = np.zeros((n, len(ranks)), np.float32), np.full((n, len(ranks)), t + 1, U64)
        for k in range(HASHES):
            v = turned(wide, t * HASHES + k)
            size = np.abs(v)
            axes, tops = np.zeros((n, DEPTH), U64), np.zeros((n, DEPTH), np.float32)
            for r in range(DEPTH):
                best = size.argmax(1)
                tops[:, r] = size[row, best]
                axes[:, r] = 2 * best + (v[row, best] > 0)
                size[row, best] = -1
            cost += ((tops[:, :1] - tops) ** 2)[:, ranks[:, k]]
            code = code * U64(2 * width) + axes[:, ranks[:, k]]
        pick = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        out[:, t] = (mix64(np.take_along_axis(code, pick, 1)) >> U64(32)).astype(np.uint32)
    signs = np.concatenate([turned(wide, tables(d) * HASHES + k) > 0 for k in range(-(-SKETCH // width))], 1)[:, :SKETCH]
    return out, np.packbits(signs, axis=1).view(">u8").astype(U64).ravel()


def sketch_limit(least: float) -> int:
    """Differing signs that a pair with cosine ``least`` exceeds less than once in 10 million."""
    p = math.acos(max(-1.0, min(1.0, least))) / math.pi
    tail, k = 1.0, -1
    while tail > 1e-7 and k < SKETCH:
        k += 1
        tail -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k


def cells(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and the offsets of its rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def units(column, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of a binary column of equally long vectors."""
    x = cells(column)[0].view(kind).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


CLASS = "id long, copies long, vector binary, codes binary, sketch long"


def with_codes(classes: DataFrame, kind: str) -> DataFrame:
    """CLASS rows of (id, copies, embedding)."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                for a in range(0, len(rows), AT_ONCE):
                    part = batch.take(pa.array(rows[a : a + AT_ONCE]))
                    x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
                    vectors = pa.array([r.tobytes() for r in x], pa.binary())
                    code, sketch = codes(units(vectors, kind))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("copies"), vectors, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(sketch.view(np.int64))],
                        ["id", "copies", "vector", "codes", "sketch"])

    return classes.mapInArrow(run, CLASS)


def bucket_rows(classes: DataFrame, width: int) -> DataFrame:
    """(key, doc_id, stored, sketch): the buckets that a class is stored in or looks into.

    A key holds the dimensions, the table and the code.
    """

    def run(batches):
        for batch in batches:
            lengths = np.diff(cells(batch.column("vector"))[1]) // width
            for d in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                n, t = len(part), tables(int(d))
                code = cells(part.column("codes"))[0].view(np.uint32).reshape(n, t, PROBES).astype(np.int64)
                key = code | (np.arange(t, dtype=np.int64) << 32)[None, :, None] | (int(d) << 40)
                once = np.ones(key.shape, bool)  # probes of one row whose codes are equal look into one bucket
                for p in range(1, PROBES):
                    once[:, :, p] = (key[:, :, p, None] != key[:, :, :p]).all(2)
                row, _, probe = np.nonzero(once)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[once]), pa.array(part.column("id").to_numpy()[row]), pa.array(probe == 0), pa.array(part.column("sketch").to_numpy()[row])],
                    ["key", "doc_id", "stored", "sketch"])

    return classes.select("id", "vector", "codes", "sketch").mapInArrow(run, "key long, doc_id long, stored boolean, sketch long")


def grouped(batches, names: tuple[str, ...], at_once: int):
    """Tables of whole groups, equal in all of ``names``, of about ``at_once`` rows or one group; rows come sorted by them."""
    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size >= at_once:
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(c).to_numpy() for c in names]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            if len(new):
                yield table.slice(0, int(new[-1]))
                held = table.slice(int(new[-1])).to_batches()
                size = sum(map(len, held))
    if held:
        yield pa.Table.from_batches(held)


def neighbours(table: pa.Table, names: tuple[str, ...]):
    """(i, j) arrays of rows of one group, as all rows that are 1 apart, then 2, and so on."""
    columns = [table.column(c).to_numpy() for c in names]
    new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
    group, n, apart = np.cumsum(new), table.num_rows, 1
    i = np.arange(n)
    while True:
        i = i[i + apart < n]
        i = i[group[i] == group[i + apart]]
        if not len(i):
            return
        yield i, i + apart
        apart += 1


def paired(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """True where one row of a pair is stored and the pair is this pair of blocks' own."""
    stored, mine, x, y = (table.column(c).to_numpy() for c in ("stored", "mine", "x", "y"))
    return (stored[i] | stored[j]) & ((x[i] == y[i]) | (mine[i] != mine[j]))


GROUP = ("key", "x", "y")


def near_by_sketch(rows: DataFrame, least: float) -> DataFrame:
    """Rows (key, x, y, mine, doc_id, stored, sketch) whose sketch comes near another's of their group, without the sketch."""
    limit = sketch_limit(least)

    def run(batches):
        for table in grouped(batches, GROUP, 1 << 16):
            sketch = table.column("sketch").to_numpy().view(U64)
            near = np.zeros(table.num_rows, bool)
            for i, j in neighbours(table, GROUP):
                ok = paired(table, i, j) & (np.bitwise_count(sketch[i] ^ sketch[j]) <= limit)
                near[i[ok]] = near[j[ok]] = True
            yield from table.filter(pa.array(near)).drop_columns(["sketch"]).combine_chunks().to_batches()

    return rows.select(*GROUP, "mine", "doc_id", "stored", "sketch").mapInArrow(run, "key long, x long, y long, mine long, doc_id long, stored boolean")


def counted_here(key: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """True where the bucket ``key`` is the first in which two rows with the given codes (pair, table, probe) meet."""
    into, back = (own[:, :, :1] == other).any(2), (other[:, :, :1] == own).any(2)
    table = (into | back).argmax(1)
    at = np.arange(len(own))
    never = np.uint32(2**32 - 1)
    one = np.where(into[at, table], own[at, table, 0], never)
    two = np.where(back[at, table], other[at, table, 0], never)
    return ((key >> 32) & 255 == table) & ((key & (2**32 - 1)) == np.minimum(one, two))


OUT = "id long, links long, other long"


def verified(rows: DataFrame, least: float, kind: str) -> DataFrame:
    """(id, links, null) counts and (id, null, other) forests of the pairs in the groups of (key, x, y, mine, doc_id, stored, copies, vector, codes)."""

    def linked(table: pa.Table, counts: np.ndarray, edges: list):
        """Count the links of a table of vectors of one size; ids of a spanning forest go to ``edges``."""
        n = table.num_rows
        ids, copies, key = (table.column(c).to_numpy() for c in ("doc_id", "copies", "key"))
        unit = units(table.column("vector").chunk(0), kind)
        code = cells(table.column("codes").chunk(0))[0].view(np.uint32).reshape(n, -1, PROBES)
        label = np.arange(n)
        for i, j in neighbours(table, GROUP):
            ok = paired(table, i, j) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
            i, j = i[ok], j[ok]
            ok = counted_here(key[i], code[i], code[j])
            i, j = i[ok], j[ok]
            np.add.at(counts, i, copies[j])
            np.add.at(counts, j, copies[i])
            apart = label[i] != label[j]
            for a, b in zip(i[apart].tolist(), j[apart].tolist()):
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    edges.append((ids[a], ids[b]))

    def run(batches):
        for table in grouped(batches, GROUP, AT_ONCE):
            size = table.column("key").to_numpy() >> 40
            counts, edges = np.zeros(table.num_rows, np.int64), []
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                part = np.zeros(len(rows), np.int64)
                linked(table.take(pa.array(rows)).combine_chunks(), part, edges)
                counts[rows] = part
            id_, place = np.unique(table.column("doc_id").to_numpy(), return_inverse=True)
            links = np.zeros(len(id_), np.int64)
            np.add.at(links, place, counts)
            id_, links = id_[links > 0], links[links > 0]
            a, b = ([int(e[k]) for e in edges] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*id_.tolist(), *a], pa.int64()), pa.array([*links.tolist(), *[None] * len(a)], pa.int64()), pa.array([*[None] * len(id_), *b], pa.int64())],
                ["id", "links", "other"])

    return rows.select(*GROUP, "mine", "doc_id", "stored", "copies", "vector", "codes").mapInArrow(run, OUT)


def linked_vectors(embeddings: DataFrame, least: float = 0.95) -> DataFrame:
    """Links of vectors with a cosine of at least ``least``, and their components.

    Input (vec_id, embedding), other columns are ignored.  Returns (vec_id,
    n_links, component_id, kept) for every row: n_links counts the other rows
    that are linked to it, component_id is the smallest vec_id that links reach.
    A vector that is null, empty, zero, or holds a null or non-finite component
    links with nothing; nor do vectors of different sizes.  Equal vectors, by
    128 bits of hashes, are one class, and count as linked rows.  Rows that
    repeat a vec_id with the same vector count as rows of their own; with other
    vectors, classes that have it as their smallest id share their links.  A null
    vec_id takes part in nothing.  An empty table gives an empty table.
    """
    element = getattr(embeddings.schema["embedding"].dataType, "elementType", T.DoubleType())
    kind, width = ("<f4", 4) if isinstance(element, T.FloatType) else ("<f8", 8)
    e = F.col("embedding").cast("array<float>" if width == 4 else "array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    same = rows.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    members = materialize(same, "vectors")
    classes = materialize(with_codes(members.select("id", "copies", "embedding"), kind), "codes")
    buckets = bucket_rows(classes, width)
    shared = buckets.groupBy("key").agg(F.count("*").alias("k"), F.max("stored").alias("any")).where("k > 1 AND any").select("key", "k")
    meeting = in_blocks(buckets.join(shared.hint("shuffle_merge"), "key"), BLOCK)
    spread = meeting.repartition(*GROUP).sortWithinPartitions(*GROUP, "doc_id")
    near = near_by_sketch(spread, least).join(classes.withColumnRenamed("id", "doc_id"), "doc_id")
    found = materialize(verified(near.repartition(*GROUP).sortWithinPartitions(*GROUP, "doc_id"), least, kind), "links")
    discard(classes)
    roots = connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v")))
    links = found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    told = members.select("h1", "h2", "id", "copies").join(links, "id", "left").join(roots, "id", "left").select(
        "h1", "h2", F.lit(True).alias("sound"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    out = rows.select("vec_id", "h1", "h2", "sound").join(told, ["h1", "h2", "sound"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
