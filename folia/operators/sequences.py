"""Runs, windows, orders and groups over pages and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import common_prefix, lead_rank, page_extension, page_tokens, to_separator


def equal_runs(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, first, last, value): maximal runs of neighbours with equal values."""
    w = W.partitionBy(group).orderBy(order)
    turn = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    runs = rows.withColumn("_run", F.sum(turn).over(w))
    return runs.groupBy(group, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias(value)).drop("_run")


def shard_bands(bands: DataFrame, shards: int, least: int = vocab.SHARD_PAGES) -> DataFrame:
    """Bands cut into at most ``shards`` about equal pieces of at least ``least`` pages."""
    n = F.col("last") - F.col("first") + 1
    k = F.greatest(F.lit(1), F.least(F.lit(shards), F.floor(n / least)))
    step = F.ceil(n / k).cast("long")
    return bands.withColumn("_step", step).withColumn("_s", F.explode(F.sequence(F.col("first").cast("long"), F.col("last").cast("long"), F.col("_step")))).withColumn(
        "last", F.least(F.col("_s") + F.col("_step") - 1, F.col("last").cast("long"))).withColumn("first", F.col("_s")).drop("_s", "_step")


def seek_windows(files: DataFrame, size: int = vocab.SEEK_PAGES) -> DataFrame:
    """(file, start, pages): slices of at most ``size`` pages of (file, n_pages)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_pages") - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    return files.withColumn("start", F.explode(starts)).select("file", "start", F.least(F.lit(size), F.col("n_pages") - F.col("start")).cast("long").alias("pages"))


def segments(pages: DataFrame, group: str, order: str, joined: str) -> DataFrame:
    """(group, first, last, joined): runs of ``joined`` pages as one segment, every other page alone."""
    w = W.partitionBy(group).orderBy(order)
    turn = F.when(F.col(joined) & F.coalesce(F.lag(joined).over(w), F.lit(False)), 0).otherwise(1)
    return pages.withColumn("_run", F.sum(turn).over(w)).groupBy(group, "_run").agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.first(joined).alias(joined)).drop("_run")


def first_seen(rows: DataFrame, content: str, order: str, name: str) -> DataFrame:
    """Adds duplicate_of: the first name seen with the same content, null for the first itself.

    The first of each content is found by an aggregate and joined, so a content
    that very many rows share is not gathered in one task.
    """
    first = rows.where(F.col(content).isNotNull()).groupBy(content).agg(F.min(F.struct(order, name)).alias("_first"))
    out = rows.join(first, content, "left")
    return out.withColumn("duplicate_of", F.when(F.col("_first")[order] != F.col(order), F.col("_first")[name])).drop("_first")


def duplicate_sets(rows: DataFrame, content: str, name: str, shown: int = 20) -> DataFrame:
    """(content, name, first, copies, duplicate_of): every member of a set with its first name and its size.

    duplicate_of names the first ``shown`` other members, which is what a report
    shows; the whole set is the rows with the same ``first``.  So output grows
    with the rows, however large a set is, and a set is never held in one task.
    """
    keep = shown + 1
    named = rows.where(F.col(content).isNotNull())
    few = named.groupBy(content, F.spark_partition_id().alias("_task")).agg(F.count("*").alias("k"), F.slice(F.array_sort(F.collect_list(name)), 1, keep).alias("names"))
    sets = few.groupBy(content).agg(F.sum("k").alias("copies"), F.slice(F.array_sort(F.flatten(F.collect_list("names"))), 1, keep).alias("names")).where("copies > 1")
    told = named.join(sets, content)
    others = F.slice(F.filter("names", lambda x: x != F.col(name)), 1, shown)
    return told.select(content, name, F.get("names", F.lit(0)).alias("first"), "copies",
        F.array_join(F.transform(others, lambda x: x.cast("string")), "; ").alias("duplicate_of"))


def eta(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Seconds left after each completion of (group, order, bytes, elapsed, total_bytes, n_files).

    By bytes done; by files where bytes say nothing; 0 at the end.
    """
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    r = rows.withColumn("done", F.sum("bytes").over(w)).withColumn("i", F.count("*").over(w))
    by_bytes = (F.col("total_bytes") - F.col("done")) * (F.col("elapsed") / F.col("done"))
    by_files = (F.col("n_files") - F.col("i")) * (F.col("elapsed") / F.col("i"))
    going = (F.col("i") < F.col("n_files")) & (F.col("elapsed") > 0)
    value = F.when(going & (F.col("done") > 0) & (F.col("total_bytes") > F.col("done")), by_bytes).when(going, by_files).otherwise(F.lit(0.0))
    return r.withColumn("eta", value).withColumn("shown", F.col("eta") >= 30)


def section_bookmarks(parts: DataFrame) -> DataFrame:
    """(folder, section, page): the page on which each section of (folder, ord, section, pages) begins.

    Folders with fewer than two sections have none; parts without a section
    count their pages only.
    """
    w = W.partitionBy("folder").orderBy("ord")
    placed = parts.withColumn("page", F.coalesce(F.sum("pages").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1)
    first = placed.where("section IS NOT NULL").groupBy("folder", "section").agg(F.min(F.struct("ord", "page")).alias("at"))
    several = first.groupBy("folder").agg(F.count("*").alias("k")).where("k > 1").select("folder")
    return first.join(several, "folder", "left_semi").select("folder", "section", F.col("at.page").cast("long").alias("page"))


def round_robin(rows: DataFrame, group: str, size: str, name: str, n: int) -> DataFrame:
    """The biggest of every group, then the second biggest, until n rows."""
    w = W.partitionBy(group).orderBy(F.desc(size), name)
    lead = rows.groupBy(group).agg(F.max(F.struct(F.col(size).alias("s"))).alias("_lead"))
    turns = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).join(lead, group)
    return turns.orderBy("turn", F.desc("_lead"), group).limit(n).drop("_lead")


def folder_affixes(parts: DataFrame, folder: str, stem: str) -> DataFrame:
    """(folder, prefix, suffix) that all stems of a folder share, cut at a separator.

    The common prefix of all is that of the smallest and the largest, so two
    minima and maxima are enough.
    """
    back = F.reverse(stem)
    d = parts.groupBy(folder).agg(F.count("*").alias("n"), F.min(stem).alias("a"), F.max(stem).alias("b"), F.min(back).alias("c"), F.max(back).alias("d"))
    many = lambda x: F.when(F.col("n") > 1, x).otherwise("")
    return d.select(folder, many(to_separator(common_prefix(F.col("a"), F.col("b")))).alias("prefix"),
        many(F.reverse(to_separator(common_prefix(F.col("c"), F.col("d"))))).alias("suffix"))


def natural_order(parts: DataFrame, folder: str, name: str, affixes: DataFrame | None = None) -> DataFrame:
    """Adds lead and place: each name's place in its folder, front matter first, then by page tokens."""
    if affixes is None:
        rows = parts.withColumn("lead", lead_rank(F.col(name)))
    else:
        rows = parts.join(affixes, folder).withColumn("lead", lead_rank(F.col(name), F.col("prefix"), F.col("suffix"))).drop("prefix", "suffix")
    w = W.partitionBy(folder).orderBy("lead", "_tokens", F.lower(name), name)
    return rows.withColumn("_tokens", page_tokens(F.col(name))).withColumn("place", F.row_number().over(w).cast("long")).drop("_tokens")


def collected_parts(catalog: DataFrame, recursive: bool = False) -> DataFrame:
    """Image and PDF parts of a folder's catalog (rel, ...) with place: files and subfolders together in natural order, level by level.

    Without ``recursive`` only the folder's own files count.  One merge has one folder, so
    its names are put in order together.
    """
    parts = catalog.where(page_extension(F.col("rel")) != "")
    if not recursive:
        parts = parts.where(~F.contains("rel", F.lit("/")))
    keys = F.transform(F.split("rel", "/"), lambda name: F.struct(page_tokens(name).alias("tokens"), F.lower(name).alias("low"), name.alias("name")))
    return parts.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(keys)).cast("long"))


def order_by_doc_id(parts: DataFrame, folder: str, doc_id: str, name: str) -> DataFrame:
    """Adds place: by publisher's id if every part of the folder has one, else by name."""
    whole = parts.groupBy(folder).agg((F.count(doc_id) == F.count("*")).alias("_whole"))
    w = W.partitionBy(folder).orderBy(F.when(F.col("_whole"), F.col(doc_id)), page_tokens(F.col(name)), name)
    return parts.join(whole, folder).withColumn("place", F.row_number().over(w).cast("long")).withColumnRenamed("_whole", "by_doc_id")


def page_identity_groups(parts: DataFrame) -> DataFrame:
    """Parts (folder, name, key, area, is_pdf) of groups with one key, and what becomes of each.

    The largest stays alone if every other is at most half its area; otherwise,
    or if one is a PDF or unreadable (area 0), all stay.
    """
    top = parts.groupBy("folder", "key").agg(F.count("*").alias("k"), F.max(F.struct("area", "name")).alias("best"), F.bool_or("is_pdf").alias("pdf")).where("k > 1")
    m = parts.join(top, ["folder", "key"])
    rest = F.col("name") != F.col("best.name")
    clear = m.groupBy("folder", "key").agg(F.bool_and(~rest | ((F.col("area") > 0) & (F.col("best.area") >= 2 * F.col("area")))).alias("clear"))
    fate = F.when(F.col("pdf") | ~F.col("clear"), "keep all").when(rest, "drop").otherwise("keep")
    return m.join(clear, ["folder", "key"]).select("folder", "key", "name", fate.alias("fate"))
