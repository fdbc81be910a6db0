"""Mixing sources to target weights in fixed-length blocks of words.

Each source's words are laid end to end and cut into blocks of ``block`` words.
A source's target asks for a number of block slots, rounded.  For every output
shard the number of slots that each source gets is drawn: a source's slots fall
on the shards like balls, so its counts are multinomial, and their sum is the
source's slots, which keeps the mix at its target.  Running sums of the counts
give each shard a range of every source's slots.  Slot j of a source takes the
block that a pseudorandom permutation of its block numbers has at j; a new
permutation begins when the source is used up.  Slots and blocks meet by index.

All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
#: Groups of a source's rows at least, and rows a group about: places are summed within groups, then over them.
SPREAD, SPREAD_ROWS = 1024, 1 << 16
#: Slots of an output shard about, slots drawn at once, shards whose ranges are summed together.
SHARD_SLOTS, CHUNK, SHARDS_AT_ONCE = 1 << 14, 1 << 14, 4096


def scrambled(*parts: Column) -> Column:
    """A pseudorandom number of 48 bits, from MD5, which any SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10).cast("long")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sized_documents(documents: DataFrame, carry: list[Column], spread: int) -> DataFrame:
    """(doc_id, s_null, s_key, size, spread) of each row, and the carried columns."""
    number = F.col("doc_id").cast("long")
    return documents.select(
        number.alias("doc_id"), F.col("source").isNull().alias("s_null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.pmod(F.when(number.isNull(), F.xxhash64("text")).otherwise(scrambled(number)), F.lit(spread)).alias("spread"), *carry)


def ranked_sources(parts: DataFrame) -> DataFrame:
    """(s_null, s_key, source_size, rank, weight): sources numbered from 1 in order, null last.

    Ranges of sources are numbered apart and moved by the counts of the ranges
    before, so sources may be many; what is broadcast is one row a range.
    """
    sizes = parts.groupBy("s_null", "s_key").agg(F.sum("part").alias("source_size"))
    ranges = materialize(sizes.repartitionByRange(partitions(parts), "s_null", "s_key").withColumn("range", F.spark_partition_id()), "sources")
    before = ranges.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("range").orderBy("s_null", "s_key"))
    out = ranges.withColumn("place", place).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("place"))
    return out.select("s_null", "s_key", "source_size", "rank", ((F.col("rank") - 1) % 3 + 1).alias("weight"))


def source_targets(parts: DataFrame, block: int, limit: int = 3) -> DataFrame:
    """One row a source: its size, target, number of blocks and of slots.

    ``parts`` has (s_null, s_key, part) sums.  Weights are 1, 2, 3, repeating,
    by the order of sources.  Sources whose share exceeds ``limit`` times their
    size are full; what they leave is shared anew by the others, until no more
    fill up.  A round is one aggregate, and no round is needed twice for a source.
    """
    s = materialize(ranked_sources(parts), "ranks").withColumn("cap", F.col("source_size") * limit)
    total, weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    left = total = total or 0
    weights = weights or 0
    while True:
        full = F.col("cap").cast("double") * F.lit(float(weights)) <= F.lit(float(left)) * F.col("weight")
        caps, others = s.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if (total - (caps or 0), others or 0) == (left, weights) or not others:
            break
        left, weights = total - (caps or 0), others
    level = (F.lit(left) * F.col("weight")).cast("double") / F.lit(weights)
    s = s.withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(level))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"),
        F.col("blocks") * limit)).otherwise(F.lit(0).cast("long"))
    return materialize(s.select("s_null", "s_key", "rank", "source_size", "target", "blocks", slots.alias("slots")), "targets")


def permuted(rows: DataFrame, j: Column, n: Column, *salts: Column) -> DataFrame:
    """``rows`` with ``at``, the place of j under a pseudorandom permutation of 0..n-1, one for each of ``salts``.

    A four-round Feistel network over a grid of about sqrt(n) by sqrt(n) cells
    permutes the grid; cells beyond n walk on until they fall inside.  Fewer than
    sqrt(n) cells lie beyond.  A walk that sixteen steps don't end, which takes
    luck of 1 in 10**19, raises.
    """
    across = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    down = F.ceil(n / across).cast("long")

    def network(y: Column) -> Column:
        left, right = F.floor(y / down).cast("long"), y % down
        left = (left + scrambled(*salts, F.lit(1), right) % across) % across
        right = (right + scrambled(*salts, F.lit(2), left) % down) % down
        left = (left + scrambled(*salts, F.lit(3), right) % across) % across
        right = (right + scrambled(*salts, F.lit(4), left) % down) % down
        return left * down + right

    first = F.col("first_step")
    last = F.aggregate(F.sequence(F.lit(1), F.lit(16)), first, lambda y, _: F.when(y < n, y).otherwise(network(y)))
    rows = rows.withColumn("first_step", network(j)).withColumn("at", F.when(first < n, first).otherwise(last)).drop("first_step")
    return rows.withColumn("at", F.when(F.col("at") < n, F.col("at")).otherwise(F.raise_error(F.lit("a permutation did not settle"))))


def shard_counts(targets: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(rank, shard, count): the drawn number of slots of each source in each output shard.

    Each of a source's slots falls on one of the shards, all alike; a shard's
    counts are multinomial in proportion to the sources' slots, and a source's
    counts add up to its slots.
    """
    total = targets.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    chunks = targets.where("slots > 0").select("rank", "slots", F.explode(F.sequence(F.lit(0).cast("long"),
        F.floor((F.col("slots") - 1) / CHUNK).cast("long"))).alias("chunk"))
    chunks = chunks.repartition(partitions(targets), "rank", "chunk")
    slots = chunks.select("rank", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("ball"))
    return slots.groupBy("rank", (scrambled(F.lit(seed), F.col("rank"), F.col("ball")) % shards).alias("shard")).agg(F.count("*").alias("count"))


def shard_ranges(counts: DataFrame) -> DataFrame:
    """(rank, shard, begin, count): the range of its source's slots that a shard takes, by running sums over shards."""
    c = counts.withColumn("group", F.floor(F.col("shard") / SHARDS_AT_ONCE).cast("long"))
    groups = c.groupBy("rank", "group").agg(F.sum("count").alias("n"))
    before = lambda column, over: F.coalesce(F.sum(column).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = groups.select("rank", "group", before("n", W.partitionBy("rank").orderBy("group")).alias("base"))
    placed = c.withColumn("inner", before("count", W.partitionBy("rank", "group").orderBy("shard"))).join(base, ["rank", "group"])
    return placed.select("rank", "shard", (F.col("base") + F.col("inner")).alias("begin"), "count")


def slot_blocks(targets: DataFrame, counts: DataFrame, seed: int = 0) -> DataFrame:
    """(rank, shard, slot, turn, at): the block number ``at`` that each slot of each source takes, and the shard it is in."""
    ranges = shard_ranges(counts).join(targets.select("rank", "blocks"), "rank")
    slots = ranges.repartition(partitions(targets), "rank", "shard").withColumn("slot", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("count") - 1)))
    slots = slots.withColumn("turn", F.floor(F.col("slot") / F.col("blocks")).cast("long"))
    placed = permuted(slots, F.col("slot") % F.col("blocks"), F.col("blocks"), *([F.lit(seed)] if seed else []), F.col("rank"), F.col("turn"))
    return placed.select("rank", "shard", "slot", "turn", "at")


def _mixed(documents: DataFrame, carry: list[str], block: int, shard_slots: int, seed: int) -> DataFrame:
    """mixed() with the carried columns as _0, _1 and so on, so that no name can clash."""
    kept = [F.col(f"`{c.replace('`', '``')}`").alias(f"_{k}") for k, c in enumerate(carry)]
    spread = SPREAD
    rows = documents.count()
    while spread * SPREAD_ROWS < rows:
        spread *= 2
    docs = sized_documents(documents, kept, spread)
    parts = materialize(sized_documents(documents, [], spread).groupBy("s_null", "s_key", "spread").agg(F.sum("size").alias("part")), "parts")
    targets = source_targets(parts, block)
    base = F.sum("part").over(W.partitionBy("s_null", "s_key").orderBy("spread").rowsBetween(W.unboundedPreceding, -1))
    places = parts.withColumn("base", F.coalesce(base, F.lit(0))).join(targets.drop("slots"), ["s_null", "s_key"])
    text = [f"_{carry.index('text')}"] if "text" in carry else []
    order = W.partitionBy("s_null", "s_key", "spread").orderBy("doc_id", "size", *text).rowsBetween(W.unboundedPreceding, -1)
    laid = docs.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(places.drop("part"), ["s_null", "s_key", "spread"])
    laid = laid.withColumn("start", F.col("base") + F.col("before"))
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    cells = laid.where("size > 0").select("rank", "start", "size", F.explode(F.sequence(first, last)).alias("at"))
    begin, end = F.greatest(F.col("start"), F.col("at") * block), F.least(F.col("start") + F.col("size"), (F.col("at") + 1) * block)
    cells = cells.select("rank", "start", "at", (begin - F.col("start")).alias("first"), (end - begin).alias("words"))
    slots = slot_blocks(targets, materialize(shard_counts(targets, shard_slots, seed), "counts"), seed)
    times = slots.groupBy("rank", "at").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    taken = cells.join(times.hint("merge"), ["rank", "at"]).groupBy("rank", "start").agg(
        F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("segments"), F.min("shard").alias("first_shard"))
    taken = taken.withColumn("worded", F.lit(True))
    out = laid.withColumn("worded", F.col("size") > 0).join(taken.hint("merge"), ["rank", "start", "worded"], "left")
    return out.select("doc_id", "size", "source_size", "target", "segments", "first_shard", *[f"_{k}" for k in range(len(carry))])


def mixed(documents: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """How often the mix takes each part of each row of (doc_id, text, source); other columns are ignored.

    Returns (doc_id, size, source_size, target, segments, first_shard) for every
    row.  segments is an array of (first, words, times): ``words`` words from
    word ``first`` on are taken ``times`` times, at most 3.  Its order is by
    first.  first_shard is the smallest output shard that takes any of them.

    size counts the runs of bytes other than space and 0x09-0x0D (null: 0).
    Targets share all sizes by the weights 1, 2, 3, repeating over the sources
    in code-point order, null last; they stop at 3 times their source's size and
    the rest is shared anew.  Rows without words get no segments.  Rows that
    repeat a doc_id are separate rows, and so is each with a null doc_id.  An
    empty table gives an empty table.  The same rows give the same mix.
    """
    return _mixed(documents, [], block, shard_slots, seed)


def words_taken() -> Column:
    return F.coalesce(F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + s.words * s.times), F.lit(0))


def taken_per_document(documents: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard) of mixed()."""
    return mixed(documents, block, shard_slots, seed).select("doc_id", "size", "source_size", "target", words_taken().alias("taken"), "first_shard")


def mixed_documents(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as rows of ``documents``' columns.

    A row stands once for each time that any of its words is taken; its text is
    then the words taken that often, in order, and n_chars (where there is such
    a column) the new length.  A text that is taken whole keeps its white space.
    Other columns may have any names.
    """
    carry = documents.columns
    kinds = {f.name: f.dataType for f in documents.schema}
    named = {c: F.col(f"_{k}") for k, c in enumerate(carry)}
    rows = _mixed(documents, carry, block, SHARD_SLOTS, 0)
    most = F.array_max(F.transform("segments", lambda s: s.times))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    part = F.filter("segments", lambda s: s.times >= F.col("copy"))
    whole = F.aggregate(part, F.lit(0).cast("long"), lambda n, s: n + s.words) == F.col("size")
    words = F.array_remove(F.split(named["text"], r"[\x20\x09-\x0D]+"), "")
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(part,
        lambda s: F.slice(w, (s["first"] + 1).cast("int"), s.words.cast("int")))), " "))[0]
    rows = rows.withColumn("mix_text", F.when(whole, named["text"]).otherwise(cut))
    named["text"] = F.col("mix_text")
    if "n_chars" in carry:
        named["n_chars"] = F.length("mix_text").cast(kinds["n_chars"])
    return rows.select(*[named[c].alias(c) for c in carry])
