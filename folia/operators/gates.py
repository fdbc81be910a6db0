"""Text gates on pages (folder or file, page_no from 0, text) and size gates on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.numbers import even_sample
from ..functions.text import lines, norm_line


def sampled_pages(pages: DataFrame, k: int = vocab.SAMPLE_PAGES) -> DataFrame:
    """The pages of every file that an even sample of k takes; file sizes are counted, not windowed."""
    sizes = pages.groupBy("file").agg(F.count("*").alias("n_pages"))
    picks = sizes.select("file", "n_pages", F.explode(even_sample(F.col("n_pages"), k)).alias("page_no"))
    return pages.join(picks, ["file", "page_no"])


def boilerplate_lines(pages: DataFrame, share: float = vocab.BOILER_SHARE) -> DataFrame:
    """(file, line, n_on): lines on at least ``share`` of a file's pages with text.

    A file needs three such pages, and has none at all if they are more than
    four lines or 400 characters: that is a template, not a stamp.
    """
    worded = pages.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    sizes = worded.groupBy("file").agg(F.count("*").alias("with_text")).where(F.col("with_text") >= vocab.BOILER_PAGES)
    on = worded.select("file", F.explode(F.array_distinct(F.transform(lines(F.col("text")), norm_line))).alias("line")).where("line <> ''")
    # a line on too few pages of the smallest file drops out before it is sent to its file
    often = on.groupBy("file", "line").agg(F.count("*").alias("n_on")).where(F.col("n_on") >= share * vocab.BOILER_PAGES)
    common = often.join(sizes, "file").where(F.col("n_on") >= F.col("with_text") * F.lit(share))
    guard = common.groupBy("file").agg(F.count("*").alias("k"),
        F.sum(F.length("line")).alias("chars")).where((F.col("k") <= vocab.BOILER_LINES) & (F.col("chars") <= vocab.BOILER_CHARS))
    return common.join(guard.select("file"), "file", "left_semi").select("file", "line", "n_on")


def net_text(pages: DataFrame, boiler: DataFrame) -> DataFrame:
    """Pages with ``net``, their text without the file's boilerplate lines."""
    per_file = boiler.groupBy("file").agg(F.collect_set("line").alias("boiler"))
    drop = lambda line: F.array_contains(F.coalesce(F.col("boiler"), F.array().cast("array<string>")), norm_line(line))
    return pages.join(per_file, "file", "left").withColumn("net", F.array_join(F.filter(lines(F.col("text")), lambda x: ~drop(x)), "\n")).drop("boiler")


def has_text(sample: DataFrame, covered: float = vocab.SEARCHABLE_SHARE) -> DataFrame:
    """(file, readable, worded, searchable) from sampled pages with ``net``."""
    worded = F.count_if(F.length(F.trim("net")) >= vocab.SEARCHABLE_CHARS)
    return sample.groupBy("file").agg(F.count("*").alias("readable"), worded.alias("worded")).withColumn(
        "searchable", (F.col("readable") > 0) & (F.col("worded") >= F.lit(covered) * F.col("readable")))


def has_text_first_pages(pages: DataFrame) -> DataFrame:
    """The older gate: characters on the first six pages."""
    chars = F.sum(F.when(F.col("page_no") < vocab.TRIAGE_PAGES, F.length(F.trim("text"))).otherwise(0))
    return pages.groupBy("file").agg(chars.cast("long").alias("chars")).withColumn("searchable", F.col("chars") >= vocab.SEARCHABLE_CHARS)


def born_digital(sample: DataFrame) -> DataFrame:
    """The newer gate: visible text, then resolution, then net text decide each sampled page.

    ``sample`` has (file, text, net, visible, dpi).  A file with less than half
    its pages scans is born digital.
    """
    kind = (F.when(F.col("visible") >= vocab.TEXT_PAGE_CHARS, "text").when(F.col("dpi") >= vocab.SCAN_DPI, "scan")
            .when(F.length("net") >= vocab.TEXT_PAGE_CHARS, "text").otherwise("none"))
    d = sample.withColumn("kind", kind).groupBy("file").agg(
        F.count("*").alias("sampled"), F.count_if(F.col("kind") == "scan").alias("scan_pages"), F.count_if(F.col("kind") == "text").alias("text_pages"),
        F.sum(F.length("text")).cast("long").alias("chars"))
    return d.withColumn("born_digital", F.col("scan_pages") < vocab.SCAN_SHARE * F.col("sampled"))


def born_digital_by_resolution(sample: DataFrame) -> DataFrame:
    """The older gate: a page image wins over any text."""
    scan = F.count_if(F.col("dpi") >= vocab.SCAN_DPI)
    return sample.groupBy("file").agg(F.count("*").alias("sampled"), scan.alias("scan_pages")).withColumn("born_digital",
        F.col("scan_pages") < vocab.SCAN_SHARE * F.col("sampled"))


def decision(orig: Column, new: Column, pages: Column, born: Column, decrypted: Column, projected: Column, floor_mb: float,
    lossless_floor_mb: float | None = None, saving: float = 0.1) -> tuple[Column, Column]:
    """(action, reason) of a file by its gates, cheapest first."""
    floor, lossless = int(floor_mb * 1048576), int((floor_mb if lossless_floor_mb is None else lossless_floor_mb) * 1048576)
    bar = F.when(decrypted, orig).otherwise(F.floor(orig * (1 - vocab.LOSSLESS_SAVING)))
    reason = (
        F.when(born & (orig >= lossless) & (new < bar), vocab.LOSSLESS).when(born, vocab.BORN_DIGITAL)
        .when(orig < floor, vocab.SMALL)
        .when((pages >= vocab.PRECHECK_PAGES) & (projected >= vocab.PRECHECK_RATIO), vocab.ALREADY)
        .when(new >= orig * (1 - saving), vocab.ALREADY).otherwise(vocab.COMPRESSIBLE))
    action = F.when(reason.isin(vocab.LOSSLESS, vocab.COMPRESSIBLE), vocab.COMPRESSED).otherwise(vocab.KEPT)
    return action, reason


def ocr_state(asked: Column, all_text: Column, any_text: Column) -> Column:
    return F.when(~asked, vocab.OCR_NONE).when(all_text, vocab.OCR_KEPT).when(any_text, vocab.OCR_REDO).otherwise(vocab.OCR_NEW)
