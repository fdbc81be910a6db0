"""Which folders hold scans worth processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify_files(files: DataFrame) -> DataFrame:
    """Adds born_digital, scanned and has_ocr to (not_pdf, scan_frac, unreadable, searchable).

    A file that can't be read is no scan; only scans are asked for their text.
    """
    born = ~F.col("not_pdf") & ~F.col("unreadable") & (F.col("scan_frac") < 0.5)
    rows = files.withColumn("born_digital", born).withColumn("scanned", ~F.col("not_pdf") & ~F.col("unreadable") & ~F.col("born_digital"))
    return rows.withColumn("has_ocr", ~F.col("not_pdf") & ~F.col("born_digital") & F.col("searchable"))


def folder_rollup(files: DataFrame, big_bytes: int) -> DataFrame:
    """Measures of every folder that has a PDF; one pass, combined before the shuffle.

    ``files`` has (folder, bytes, is_pdf_name, not_pdf, born_digital, scanned,
    has_ocr, unreadable).  Files that only bear a PDF's name count as junk and in
    nothing else; files with other names count as others.
    """
    pdf = F.col("is_pdf_name") & ~F.col("not_pdf")
    scan = pdf & F.col("scanned")
    big, bare = scan & (F.col("bytes") >= big_bytes), scan & ~F.col("has_ocr")
    count = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0)).cast("long")
    d = files.groupBy("folder").agg(
        count(pdf).alias("n_pdf"), count(scan).alias("n_scanned"), count(pdf & F.col("born_digital")).alias("n_born"), count(pdf & F.col("unreadable")).alias("n_err"),
        count(F.col("is_pdf_name") & F.col("not_pdf")).alias("n_junk"), count(big).alias("n_big"), count(bare).alias("n_no_ocr"),
            count(~F.col("is_pdf_name")).alias("n_other"),
        total(pdf).alias("total_bytes"), total(scan).alias("scanned_bytes"), total(big | bare).alias("compressible_bytes"),
        F.coalesce(F.max(F.when(pdf, F.col("bytes"))), F.lit(0)).cast("long").alias("biggest_bytes"))
    only = F.col("n_other") == 0
    reasons = F.concat_ws(
        " ", F.when(F.col("n_big") > 0, F.concat(F.lit("BIG("), F.col("n_big"), F.lit(")"))),
        F.when(F.col("n_no_ocr") > 0, F.concat(F.lit("NO_OCR("), F.col("n_no_ocr"), F.lit(")"))), F.when(only & (F.col("n_scanned") > 0), "ONLY_PDFS"))
    d = d.withColumn("only_pdfs", only).withColumn("reasons", reasons)
    d = d.withColumn("candidate", (F.col("n_scanned") > 0) & ((F.col("n_big") > 0) | (F.col("n_no_ocr") > 0)))
    return d.where("n_pdf > 0")


def candidates(rollup: DataFrame) -> DataFrame:
    """Candidate folders, those with most to re-encode first."""
    return rollup.where("candidate").orderBy(F.desc("compressible_bytes"), F.desc("scanned_bytes"), "folder")
