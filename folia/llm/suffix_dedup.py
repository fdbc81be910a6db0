"""Removal of repeated byte strings by enhanced suffix arrays.

Every window of ``length`` bytes has one anchor: the leftmost of its
``SEED``-byte grams with the smallest hash.  Equal windows have equal anchors
at equal places, so windows need to be compared only within an anchor's group.
Grams that a bounded sample shows to be common are taken only where a window has
no other: so the ends of a passage that many texts hold are anchored in what
stands beside it, not all at one gram.  This orders grams, and drops none.
An anchor and all windows that it owns make a region of at most
``2 * length - SEED`` bytes.

1. Tasks reduce their regions to the first of each (anchor, region hash) and
   mark the others, which equal an earlier one, as covered.  What is left is
   packed into one binary row a bucket, grouped by anchor and reduced again.
   So a passage that every document holds is one region a task.
2. Anchors with several different regions remain.  Their first regions' bytes
   are cut from the texts and meet by anchor.  A suffix array with longest
   common prefixes over each bucket yields its common-prefix intervals of at
   least ``length`` bytes; every interval's occurrences but the first are
   covered.
3. An anchor with more than HOT different regions would be one large array.
   Its regions are cut into windows of ``length`` bytes instead, which spread by
   what they hold and are reduced like regions in step 1.
4. Covered spans go back to their documents, which drop them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix64, prefix_hash, signed, sliding, span_hash, text_blocks
from .runtime import materialize, release_shuffles

SEED = 24
#: Texts in the sample of common grams, the share that makes one common, bits of their table.
SAMPLE, COMMON, TABLE_BITS = 2_000, 0.01, 24
#: Regions that a task holds before it reduces them, that one suffix array takes, and that an anchor may have to be in one.
HELD, AT_ONCE, HOT = 400_000, 8_000, 8_000
#: Bytes of text whose regions make a bucket, and of a long text that are hashed at once.
BUCKET_BYTES, PIECE = 4 << 20, 1 << 19
#: What one region is, within a bucket's binary row.
REGION = np.dtype([("anchor", "<u8"), ("body", "<u8"), ("doc", "<i8"), ("twin", "<i8"), ("start", "<u4"), ("size", "<u2"), ("at", "<u2")])


def common_grams(documents: DataFrame, rows: int, texts: int = SAMPLE, share: float = COMMON) -> np.ndarray | None:
    """A table of 2**TABLE_BITS flags, by the first bits of their hashes, of grams in ``share`` of a sample of texts.

    About ``texts`` rows with the smallest hashes of (doc, twin) are the sample,
    which bounds what is counted and collected.  None where no gram is common.
    """
    if not rows:
        return None
    picked = documents.where(F.pmod(F.xxhash64("doc", "twin"), F.lit(1 << 20)) < max(1, round((1 << 20) * min(1.0, texts / rows))))

    def run(batches):
        for batch in batches:
            for _, buf, offsets, _ in pieces_of(batch.column("text"), SEED):
                found = [np.zeros(0, U64)]
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    if b - a >= SEED:
                        prefix, at = prefix_hash(buf[a:b]), np.arange(b - a - SEED + 1)
                        found.append(np.unique(span_hash(prefix, at, at + SEED) >> U64(64 - TABLE_BITS)))
                slot, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n.astype(np.int64))], ["slot", "n"])

    counts = picked.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    least = max(8, math.ceil(share * min(texts, rows)))
    slots = [r[0] for r in counts.where(F.col("n") >= least).select("slot").collect()]
    if not slots:
        return None
    table = np.zeros(1 << TABLE_BITS, bool)
    table[slots] = True
    return table


def regions(buf: np.ndarray, offsets: np.ndarray, length: int, common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, size, anchor place in it, anchor hash, body hash) of all regions.

    start is an offset in the text.  Each window of ``length`` bytes of a text
    lies in exactly one region.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(U64), none.view(U64)
    prefix = prefix_hash(buf)
    at = np.arange(n - SEED + 1)
    gram = span_hash(prefix, at, at + SEED)
    key = (gram & U64(0x7FFFFFFF00000000)) | at.astype(U64)
    if common is not None:
        key |= common[gram >> U64(64 - TABLE_BITS)].astype(U64) << U64(63)
    pick = (sliding(key, length - SEED + 1, np.minimum) & U64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.arange(len(pick))
    valid = np.flatnonzero(owner[: len(pick)] == owner[windows + length - 1])
    if not len(valid):
        return none, none, none, none, none.view(U64), none.view(U64)
    where, text = pick[valid], owner[valid]
    fresh = np.ones(len(valid), bool)
    fresh[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(valid)) - 1
    start, end, anchor = valid[first], valid[last] + length, where[first]
    text = text[first]
    body = mix64(span_hash(prefix, start, end) + (anchor - start).astype(U64))
    return text, start - offsets[text], end - start, anchor - start, gram[anchor], body


def pieces_of(column, length: int):
    """(row, bytes, offsets, start) over a string column like text_blocks(), long texts in pieces that overlap by length - 1.

    A window lies in one piece.  A region that a piece's end cuts is two
    smaller ones, which only sends them to the suffix array.
    """
    for row, buf, offsets in text_blocks(column, PIECE):
        if len(buf) <= 2 * PIECE:
            yield row, buf, offsets, 0
            continue
        for a in range(0, len(buf) - length + 1, PIECE):
            part = buf[a : a + PIECE + length - 1]
            yield row, part, np.array([0, len(part)]), a


def first_of_each(rows: np.ndarray) -> np.ndarray:
    """True where a region is the first, by document and start, of its anchor and body; rows are sorted so."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["body"][1:] != rows["body"][:-1])
    return new


def covered_by_first(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """True where a region equals an earlier one; the first region itself, read from a row that repeats, doesn't."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    itself = np.ones(len(rows), bool)
    for c in ("doc", "twin", "start"):
        itself &= rows[c] == rows[c][first]
    return ~itself


def in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["start"], rows["twin"], rows["doc"], rows["body"], rows["anchor"]))]


def packed_spans(rows: np.ndarray) -> dict:
    """One binary row of (start, end) longs for each document of ``rows``."""
    out = {"doc": [], "twin": [], "kind": [], "bucket": [], "packed": []}
    if len(rows):
        rows = rows[np.lexsort((rows["start"], rows["twin"], rows["doc"]))]
        cut = np.flatnonzero(np.append(True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["twin"][1:] != rows["twin"][:-1])))
        ends = np.append(cut[1:], len(rows))
        start = rows["start"].astype(np.int64)
        spans = np.stack([start, start + rows["size"]], 1)
        for a, b in zip(cut, ends):
            out["doc"].append(int(rows["doc"][a])), out["twin"].append(int(rows["twin"][a]))
            out["kind"].append(0), out["bucket"].append(-1), out["packed"].append(merged(spans[a:b]).tobytes())
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) pairs; overlapping and touching pairs join."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


OUT = "doc long, twin long, kind int, bucket int, packed binary"


def as_batch(out: dict) -> pa.RecordBatch:
    kinds = {"doc": pa.int64(), "twin": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "packed": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))


def first_and_covered(rows: np.ndarray, buckets: int):
    """Batches of OUT: spans of ``rows`` that equal an earlier one, and a binary row of first regions for each bucket."""
    rows = in_order(rows)
    new = first_of_each(rows)
    spans = packed_spans(rows[covered_by_first(rows, new)])
    spans["bucket"] = [x % buckets for x in spans["doc"]]
    yield as_batch(spans)
    rows = rows[new]
    bucket = (rows["anchor"] % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(cut[1:], len(rows))
    m = len(cut)
    yield as_batch({"doc": [None] * m, "twin": [None] * m, "kind": [1] * m, "bucket": bucket[cut].tolist(), "packed": [rows[a:b].tobytes() for a, b in zip(cut, ends)]})


def local_regions(documents: DataFrame, length: int, buckets: int, rows: int) -> DataFrame:
    """kind 0: covered spans of a document, in any bucket; kind 1: a bucket's first regions."""
    table = common_grams(documents, rows)
    common = None if table is None else documents.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches):
        held: list[np.ndarray] = []
        flags = None if common is None else np.unpackbits(common.value).astype(bool)
        for batch in batches:
            docs, twins = (batch.column(c).to_numpy() for c in ("doc", "twin"))
            for row, buf, offsets, from_ in pieces_of(batch.column("text"), length):
                text, start, size, at, anchor, body = regions(buf, offsets, length, flags)
                if len(text):
                    r = np.empty(len(text), REGION)
                    r["anchor"], r["body"], r["doc"], r["twin"] = anchor, body, docs[row + text], twins[row + text]
                    r["start"], r["size"], r["at"] = start + from_, size, at
                    held.append(r)
                if sum(map(len, held)) > HELD:
                    yield from first_and_covered(np.concatenate(held), buckets)
                    held.clear()
        if held:
            yield from first_and_covered(np.concatenate(held), buckets)

    return documents.mapInArrow(run, OUT)


def hot_windows(documents: DataFrame, hot: DataFrame, length: int, buckets: int) -> DataFrame:
    """Like local_regions(), of the windows of hot anchors' regions (doc, twin, packed): each is a region of its own.

    A window's two halves are hashed apart, and make its anchor and its body.
    """
    per_doc = hot.groupBy("doc", "twin").agg(F.collect_list("packed").alias("wanted"))

    def run(batches):
        held, half = [], length // 2
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc", "twin", "wanted"))
            for doc, twin, wanted, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist()):
                rows = np.frombuffer(b"".join(wanted), REGION)
                for a, n in merged(np.stack([rows["start"], rows["start"] + rows["size"].astype(np.int64)], 1).astype(np.int64)).tolist():
                    for b in range(a, n - length + 1, PIECE):
                        prefix = prefix_hash(np.frombuffer(text[b : min(n, b + PIECE + length - 1)], np.uint8))
                        at = np.arange(len(prefix) - length)
                        r = np.empty(len(at), REGION)
                        r["anchor"], r["body"] = span_hash(prefix, at, at + half), span_hash(prefix, at + half, at + length)
                        r["anchor"] = mix64(r["anchor"] + r["body"] * U64(3))
                        r["doc"], r["twin"], r["start"], r["size"], r["at"] = doc, twin, b + at, length, 0
                        held.append(r)
                if sum(map(len, held)) > HELD:
                    yield from first_and_covered(np.concatenate(held), buckets)
                    held.clear()
        if held:
            yield from first_and_covered(np.concatenate(held), buckets)

    return documents.join(per_doc, ["doc", "twin"]).select("doc", "twin", "text", "wanted").mapInArrow(run, OUT)


def reduced_regions(local: DataFrame) -> DataFrame:
    """kind 0: covered spans, those from before too; kind 2: regions whose anchors have several bodies; kind 3: more than HOT."""

    def reduce(table: pa.Table) -> pa.Table:
        is_span = pa.compute.equal(table.column("kind"), 0)
        before, table = table.filter(is_span), table.filter(pa.compute.invert(is_span))
        if not table.num_rows:
            return before
        rows = in_order(np.concatenate([np.frombuffer(x, REGION) for x in table.column("packed").to_pylist()]))
        new = first_of_each(rows)
        out = packed_spans(rows[covered_by_first(rows, new)])
        rows = rows[new]
        same = np.append(False, rows["anchor"][1:] == rows["anchor"][:-1])
        open_ = rows[same | np.append(same[1:], False)]
        _, which, bodies = np.unique(open_["anchor"], return_inverse=True, return_counts=True)
        hot = bodies[which] > HOT if len(open_) else np.zeros(0, bool)
        for kind, part in ((2, open_[~hot]), (3, open_[hot])):
            part = part[np.lexsort((part["start"], part["twin"], part["doc"]))]
            if not len(part):
                continue
            cut = np.flatnonzero(np.append(True, (part["doc"][1:] != part["doc"][:-1]) | (part["twin"][1:] != part["twin"][:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(part))):
                out["doc"].append(int(part["doc"][a])), out["twin"].append(int(part["twin"][a]))
                out["kind"].append(kind), out["bucket"].append(table.column("bucket")[0].as_py()), out["packed"].append(part[a:b].tobytes())
        return pa.Table.from_batches([*before.to_batches(), as_batch(out)])

    return local.groupBy("bucket").applyInArrow(reduce, OUT)


# Enhanced suffix array -------------------------------------------------------


def suffix_array(data: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``start`` in order of their first ``depth`` bytes, and common prefixes.

    The second array holds, for each suffix but the first, the length of the
    common prefix with its predecessor, up to ``depth``.  Every start must leave
    ``depth`` bytes.  Ranks of 8-byte strings are doubled, and the common
    prefixes are read off the ranks of each doubling.
    """
    n = len(data)
    if not len(start):
        return start, np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.zeros(n, U64)
    for k in range(8):
        first = (first << U64(8)) | padded[k : k + n].astype(U64)
    ranks = [np.unique(first, return_inverse=True)[1].astype(np.int64)]
    width = 8
    while width * 2 <= depth:
        r = ranks[-1]
        after = np.concatenate([r[width:], np.zeros(min(width, n), np.int64)])[:n]
        ranks.append(np.unique(r * (r.max() + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    r = ranks[-1]
    full = r[start] * (r.max() + 1) + r[start + depth - width]
    order = np.argsort(full, kind="stable")
    sa, full = start[order], full[order]
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 8 << k
        for _ in range(2 if k == len(ranks) - 1 else 1):
            fits = lcp + step <= depth
            eq = fits & (ranks[k][np.where(fits, a, 0)] == ranks[k][np.where(fits, b, 0)])
            a[eq] += step
            b[eq] += step
            lcp[eq] += step
    for _ in range(8):
        fits = lcp < depth
        eq = fits & (data[np.where(fits, a, 0)] == data[np.where(fits, b, 0)])
        a[eq] += 1
        b[eq] += 1
        lcp[eq] += 1
    lcp[full[1:] == full[:-1]] = depth
    return sa, lcp


def common_prefix_intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix interval tree's nodes of at least ``least``.

    ``lcp[i]`` belongs to suffixes i and i + 1.  One scan with a stack closes an
    interval where the common prefix falls below its depth.
    """
    out, stack = [], []
    for i, h in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > h:
            depth, first = stack.pop()
            out.append((depth, first, i))
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, first))
    return out


def maximal_groups(data: bytes, begin: np.ndarray, end: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(length, all starts) of the maximal repeats of at least ``least`` bytes in the
    bodies [begin, end) of ``data``; a repeat never crosses a body's ends.

    Suffixes are sorted by their first ``least`` bytes at once.  A run of equal
    ones whose left bytes agree is no maximal repeat, nor is anything below it in
    the tree, so only runs with differing (or missing) left bytes are sorted on
    and scanned.
    """
    per = np.maximum(end - begin - least + 1, 0)
    body = np.repeat(np.arange(len(begin)), per)
    if not len(body):
        return []
    start = begin[body] + np.arange(len(body)) - np.repeat(np.cumsum(per) - per, per)
    buf = np.frombuffer(data, np.uint8)
    stop_at = np.zeros(len(buf), np.int64)
    stop_at[start] = end[body]
    left = np.full(len(buf), -1, np.int16)
    inner = start[start > begin[body]]
    left[inner] = buf[inner - 1]
    sa, lcp = suffix_array(buf, start, least)
    runs = np.flatnonzero(np.diff(np.concatenate([[0], (lcp >= least).astype(np.int8), [0]])))
    first, last = runs[::2], runs[1::2]
    if not len(first):
        return []
    lefts = left[sa]
    lo, hi = (f.reduceat(np.append(lefts, lefts[-1:]), np.stack([first, last + 1], 1).ravel())[::2] for f in (np.minimum, np.maximum))
    out = []
    for a, b in zip(first[(lo < 0) | (lo != hi)].tolist(), last[(lo < 0) | (lo != hi)].tolist()):
        at = sa[a : b + 1].tolist()
        rest = sorted((data[s + least : stop_at[s]], s) for s in at)
        deeper = [least + shared_prefix(x, y) for (x, _), (y, _) in zip(rest, rest[1:])]
        at = np.array([s for _, s in rest])
        for depth, i, j in common_prefix_intervals(deeper, least):
            group = at[i : j + 1]
            sides = left[group]
            if sides.min() < 0 or sides.min() != sides.max():
                out.append((depth, np.sort(group)))
    return out


def shared_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[:mid] == y[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, all (text, start)) of the maximal repeats of a small list of texts."""
    end = np.cumsum([len(t) for t in texts])
    begin = end - np.array([len(t) for t in texts])
    found = []
    for h, starts in maximal_groups(b"".join(texts), begin, end, least):
        of = np.searchsorted(end, starts, side="right")
        found.append((h, sorted(zip(of.tolist(), (starts - begin[of]).tolist()))))
    return sorted(found)


def covered_by_intervals(rows: np.ndarray, bodies: list[bytes], length: int) -> np.ndarray:
    """Spans, as REGION rows, of the maximal repeats' occurrences that are not the first."""
    sizes = np.array([len(b) for b in bodies])
    end = np.cumsum(sizes)
    begin = end - sizes
    turn = np.empty(len(rows), np.int64)
    turn[np.lexsort((rows["start"], rows["twin"], rows["doc"]))] = np.arange(len(rows))
    late, depth = [], []
    for h, starts in maximal_groups(b"".join(bodies), begin, end, length):
        of = np.searchsorted(end, starts, side="right")
        order = np.lexsort((starts, turn[of]))[1:]
        late.append(starts[order]), depth.append(np.full(len(order), h))
    if not late:
        return rows[:0]
    at, depth = np.concatenate(late), np.concatenate(depth)
    of = np.searchsorted(end, at, side="right")
    out = rows[of].copy()
    out["start"] += (at - begin[of]).astype(np.uint32)
    out["size"] = depth
    return out


def cut_bodies(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bucket, packed, body): each wanted document's regions of a bucket with their bytes.

    Of neighbouring rows that repeat only one is cut; interval_spans() drops what is left of them.
    """
    per_doc = wanted.groupBy("doc", "twin").agg(F.collect_list(F.struct("bucket", "packed")).alias("wanted"))

    def run(batches):
        last = None
        for batch in batches:
            out = [[], [], []]
            keys = zip(batch.column("doc").to_pylist(), batch.column("twin").to_pylist())
            for key, text, wants in zip(keys, batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
                if key == last:
                    continue
                last = key
                for w in wants:
                    rows = np.frombuffer(w["packed"], REGION)
                    out[0].append(w["bucket"]), out[1].append(w["packed"])
                    out[2].append(b"".join([text[s : s + n] for s, n in zip(rows["start"].tolist(), rows["size"].tolist())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "packed", "body"])

    return documents.join(per_doc, ["doc", "twin"]).select("doc", "twin", "text", "wanted").mapInArrow(run, "bucket int, packed binary, body binary")


def interval_spans(cut: DataFrame, length: int) -> DataFrame:
    def scan(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, REGION) for x in table.column("packed").to_pylist()]
        rows = np.concatenate(parts)
        bodies = []
        for part, data in zip(parts, table.column("body").to_pylist()):
            ends = np.cumsum(part["size"])
            bodies += [data[e - n : e] for e, n in zip(ends.tolist(), part["size"].tolist())]
        order = np.lexsort((rows["start"], rows["twin"], rows["doc"], rows["anchor"]))
        fresh = np.ones(len(order), bool)  # a region of a row that repeats comes once
        fresh[1:] = np.any([rows[c][order[1:]] != rows[c][order[:-1]] for c in ("anchor", "doc", "twin", "start")], axis=0)
        order = order[fresh]
        keys = rows["anchor"][order]
        found, a = [], 0
        while a < len(order):  # whole anchors, about 1 MB of bodies at a time
            b = min(len(order), a + AT_ONCE)
            while b < len(order) and keys[b] == keys[b - 1]:
                b += 1
            part = order[a:b]
            found.append(covered_by_intervals(rows[part], [bodies[i] for i in part.tolist()], length))
            a = b
        return pa.Table.from_batches([as_batch(packed_spans(np.concatenate(found)))])

    return cut.groupBy("bucket").applyInArrow(scan, OUT)


def repeated_spans(documents: DataFrame, length: int = 100) -> DataFrame:
    """(doc, twin, packed): for each text with such bytes, the spans that repeat an earlier string.

    ``documents`` has (doc, twin, text); (doc, twin) is the order of texts.
    Rows with the same (doc, twin) count as one.
    """
    spark = documents.sparkSession
    rows, size = documents.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(64, -(-(size or 0) // BUCKET_BYTES))
    reduced = materialize(reduced_regions(local_regions(documents, length, buckets, rows)), "anchors")
    release_shuffles(spark)
    wanted = reduced.where("kind = 2").select("doc", "twin", "bucket", "packed")
    late = interval_spans(cut_bodies(documents, wanted), length)
    hot = reduced.where("kind = 3").select("doc", "twin", "packed")
    if hot.take(1):
        late = late.union(reduced_regions(hot_windows(documents, hot, length, buckets)).where("kind = 0"))
    late = materialize(late, "spans")
    release_shuffles(spark)
    spans = reduced.where("kind = 0").union(late)
    return spans.groupBy("doc", "twin").agg(F.collect_list("packed").alias("packed"))


def keyed_texts(documents: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, the order (doc, twin) of texts, text, and the carried columns."""
    number = F.col("doc_id").cast("long")
    return documents.select(
        number.alias("doc_id"), F.coalesce(number, F.lit(2**63 - 1)).alias("doc"),
        F.xxhash64("text").alias("twin"), F.coalesce("text", F.lit("")).alias("text"), *carry)


def kept_bytes(text: bytes, packed) -> tuple[bytes, int]:
    """What the spans leave of a text, and the number of maximal spans."""
    if not packed:
        return text, 0
    cuts = merged(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in packed])).tolist()
    at, parts = 0, []
    for a, b in cuts:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]]), len(cuts)


def without_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """Texts without the bytes that a string of ``length`` bytes which also starts earlier covers.

    Input (doc_id, text), other columns are ignored.  Earlier means in a
    document with a smaller doc_id, or in the same one at a smaller start.
    Strings are judged on the input and never cross documents; overlaps count.
    Returns (doc_id, n_bytes, n_removed, n_spans, kept binary) for each row.  A
    null text is empty and loses nothing, nor does one shorter than ``length``.
    Of rows that repeat a doc_id those with other texts are in order of the
    text's hash; equal rows count as one and get the same result.  A null doc_id
    comes last.  An empty table gives an empty table.
    """
    keyed = keyed_texts(documents, [])
    spans = repeated_spans(keyed.select("doc", "twin", "text"), length)

    def run(batches):
        for batch in batches:
            n, gone, runs, kept = [], [], [], []
            for text, packed in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("packed").to_pylist()):
                left, cuts = kept_bytes(text, packed)
                n.append(len(text)), gone.append(len(text) - len(left)), runs.append(cuts), kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return keyed.join(spans, ["doc", "twin"], "left").select("doc_id", "text", "packed").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def documents_without_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """``documents`` with their texts as without_repeats() leaves them, and the same columns.

    Bytes of a character that a removed span cuts go too.  n_chars, where there
    is such a column, is the new length.  A document stays even if nothing of
    its text does.
    """
    carry = [c for c in documents.columns if c not in ("doc_id", "text")]
    keyed = keyed_texts(documents, [F.col(c).alias(f"_{k}") for k, c in enumerate(carry)])
    spans = repeated_spans(keyed.select("doc", "twin", "text"), length)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            left = [kept_bytes(t, p)[0].decode("utf-8", "ignore") for t, p in zip(texts, batch.column("packed").to_pylist())]
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, "text", pa.array(left, pa.string())).drop_columns(["packed"])

    names = ["doc_id", "text", *[f"_{k}" for k in range(len(carry))]]
    rows = keyed.join(spans, ["doc", "twin"], "left").select(*names, "packed")
    out = rows.mapInArrow(run, rows.drop("packed").schema)
    kinds = {f.name: f.dataType for f in documents.schema}
    back = {"doc_id": F.col("doc_id").cast(kinds["doc_id"]), "text": F.col("text")} | {c: F.col(f"_{k}") for k, c in enumerate(carry)}
    if "n_chars" in carry:
        back["n_chars"] = F.length("text").cast(kinds["n_chars"])
    return out.select(*[back[c].alias(c) for c in documents.columns])
