"""Joins and multiset operators between a source and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..session import kept, shared_folder


def before_after(before: DataFrame, after: DataFrame, key: str = "rel") -> DataFrame:
    """Rows of AFTER with their BEFORE row; outputs without a source drop out."""
    left = before.select(F.col(key), *[F.col(c).alias(f"{c}_before") for c in before.columns if c != key])
    right = after.select(F.col(key), *[F.col(c).alias(f"{c}_after") for c in after.columns if c != key])
    return right.join(left, key)


def still_to_do(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return sources.join(done.select(key).distinct(), key, "left_anti")


def retry_routes(entries: DataFrame, catalog: DataFrame, root: str) -> DataFrame:
    """(entry, src, route): job, missing or foreign for each failed entry of a report."""
    absolute = F.col("entry").startswith("/")
    foreign = absolute & ~F.col("entry").startswith(root.rstrip("/") + "/")
    src = F.when(absolute, F.col("entry")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("entry")))
    known = catalog.select(F.col("path").alias("src"), F.lit(True).alias("known")).distinct()
    rows = entries.distinct().withColumn("src", src).join(known, "src", "left")
    return rows.select("entry", "src", F.when(foreign, "foreign").when(F.col("known").isNull(), "missing").otherwise("job").alias("route"))


def two_sided(rows: DataFrame, keys: list[str], left: Column) -> DataFrame:
    """(keys, a, b): how often each key stands on the side where ``left`` holds, and on the other; one pass, one shuffle."""
    return rows.groupBy(*keys).agg(F.count_if(left).alias("a"), F.count_if(~left).alias("b"))


def multiset_difference(rows: DataFrame, keys: list[str], left: Column) -> DataFrame:
    """Copies of each key that one side has more of: (keys, lost, added); rows belong to the left side or the right."""
    gap = F.col("a") - F.col("b")
    return two_sided(rows, keys, left).select(*keys, F.greatest(gap, F.lit(0)).alias("lost"), F.greatest(-gap, F.lit(0)).alias("added")).where("lost > 0 OR added > 0")


def word_recall(rows: DataFrame, before: Column, key: str = "rel", least: int = vocab.RECALL_WORDS) -> DataFrame:
    """(key, words_before, recall) of (key, word) rows of both sides; recall is null for fewer than ``least`` words before."""
    both = two_sided(rows, [key, "word"], before).where("a > 0").groupBy(key).agg(F.sum("a").alias("words_before"), F.sum(F.least("a", "b")).alias("shared"))
    return both.select(key, "words_before", F.when(F.col("words_before") >= least, F.col("shared") / F.col("words_before")).alias("recall"))


def inherited(defects: DataFrame, source_defects: DataFrame, group: list[str], signature: str) -> DataFrame:
    """(group, n_defects, inherited): a group's defects are inherited if its source has all their signatures."""
    have = source_defects.select(*group, signature).distinct().withColumn("known", F.lit(1))
    marked = defects.join(have, [*group, signature], "left")
    return marked.groupBy(*group).agg(F.count("*").alias("n_defects"), F.bool_and(F.col("known").isNotNull()).alias("inherited"))


def reachable(edges: DataFrame, roots: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Nodes that edges (src, dst) reach from roots (node), roots included, with the step that reaches them; cycles are fine.

    Edges are written once, and each round joins only the last round's new nodes.  State is written to the shared
    checkpoint folder, so plans stay short.  Raises where ``rounds`` are not
    enough; it never returns a part.
    """
    spark = edges.sparkSession
    home, kind = shared_folder(spark, "reach"), edges.schema["dst"].dataType.simpleString()
    edges = kept(edges.select("src", "dst").distinct(), "edges")
    read = lambda path: spark.read.schema(f"node {kind}, step int").parquet(path)
    roots.select(F.col("node").cast(kind).alias("node")).distinct().write.parquet(f"{home}/step=0")
    for k in range(1, rounds):
        seen = read(home)
        new = seen.where(F.col("step") == k - 1).join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new.join(seen.select("node"), "node", "left_anti").write.parquet(f"{home}/step={k}")
        if not spark.read.schema(f"node {kind}").parquet(f"{home}/step={k}").take(1):
            return read(home)
    raise RuntimeError(f"nodes were still found after {rounds} rounds")


def render_mode_asof(ops: DataFrame) -> DataFrame:
    """The last mode set before each show operator of a stream, 0 by default: (stream, pos, mode)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("stream").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    set_ = F.when(F.col("kind") == "mode", F.col("arg").cast("int"))
    return ops.withColumn("mode", F.coalesce(F.last(set_, ignorenulls=True).over(w), F.lit(0))).where("kind = 'show'").select("stream", "pos", "mode")


def shows_in_blocks(shows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Show operators (stream, pos) with the block [start, stop) of their stream that holds them."""
    b, s = blocks.alias("b"), shows.alias("s")
    return s.join(b,
        (F.col("s.stream") == F.col("b.stream")) & (F.col("b.start") <= F.col("s.pos")) & (F.col("s.pos") < F.col("b.stop"))).select("s.stream",
        "s.pos", "b.start", "b.stop")


def covered_by_last_image(ops: DataFrame) -> DataFrame:
    """Show operators and whether an image is drawn after them in the stream: (stream, pos, hidden)."""
    last = ops.where("kind = 'image'").groupBy("stream").agg(F.max("pos").alias("last_image"))
    return ops.where("kind = 'show'").join(last, "stream", "left").select("stream", "pos", F.coalesce(F.col("pos") < F.col("last_image"), F.lit(False)).alias("hidden"))
