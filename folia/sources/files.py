"""Catalogs, lists, reports and settings as inputs, and the reports as outputs."""

from __future__ import annotations

import os
import time
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab


def plain_path(column: str = "path"):
    return F.regexp_replace(column, "^file:/+", "/")


def tree(spark: SparkSession, root: str, suffix: str | None = "pdf", heads: bool = False, content: bool = False) -> DataFrame:
    """Files under a folder: (path, folder, rel, bytes, mtime[, head][, content]).  Unless asked for, no content is read.

    ``root`` may be a single file.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        r = r.option("pathGlobFilter", f"*.{suffix}")
    base = root.removeprefix("file://").rstrip("/")
    columns = [plain_path().alias("path"), F.regexp_extract(plain_path(), "^(.*)/[^/]*$", 1).alias("folder"),
        F.substr(plain_path(), F.lit(len(base) + 2)).alias("rel"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")]
    return r.load(root).select(*columns, *([F.substring("content", 1, 1024).alias("head")] if heads else []), *(["content"] if content else []))


def other_files(catalog: DataFrame) -> DataFrame:
    """(folder, n_other): files of each folder whose name doesn't end in .pdf, in any case."""
    return catalog.groupBy("folder").agg(F.count_if(~F.lower("path").endswith(".pdf")).alias("n_other"))


def listed(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """PDFs named in a list that exist; blank lines and # comments are no names."""
    line = F.trim("value")
    names = spark.read.text(path).select(line.alias("path")).where((line != "") & ~line.startswith("#") & F.lower(line).endswith(".pdf")).distinct()
    return names.join(catalog, "path", "left_semi")


def failed_entries(spark: SparkSession, report: str) -> DataFrame:
    rows = spark.read.csv(report, header=True, escape='"', multiLine=True)
    return rows.where(F.trim(F.coalesce("error", F.lit(""))) != "").select(F.col("file").alias("entry")).distinct()


def report_candidates(spark: SparkSession, reports: list[str], reason: str = vocab.BORN_DIGITAL, least_mb: float = 0.0) -> DataFrame:
    """(path, size): files that reports give ``reason`` for, once each with the largest size, biggest first."""
    rows = spark.read.csv(reports, header=True, escape='"', multiLine=True)
    sized = rows.where(F.trim("reason") == reason).select(F.trim("file").alias("path"), F.expr("try_cast(`orig size (MB)` AS double)").alias("size"))
    kept = sized.where((F.col("size") >= least_mb) & (F.col("path") != ""))
    best = kept.groupBy(F.lower("path").alias("key")).agg(F.max_by("path", F.struct("size", "path")).alias("path"), F.max("size").alias("size"))
    return best.select("path", "size").orderBy(F.desc("size"), "path")


def verdicts(spark: SparkSession, catalog: DataFrame, audit: str | None = None) -> DataFrame:
    """Audit rows (file, verdict); without an audit every output counts as ok."""
    if audit:
        return spark.read.csv(audit, header=True, escape='"').select("file", "verdict")
    return catalog.select(F.col("rel").alias("file"), F.lit("ok").alias("verdict"))


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a JSON object of strings."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))


def settings(path: str, known: dict, given: dict | None = None) -> tuple[dict, list[str]]:
    """Defaults under a TOML file under given values; names that nothing knows are told and ignored."""
    with open(path, "rb") as f:
        read = tomllib.load(f)
    unknown = sorted(set(read) - set(known))
    return known | {k: v for k, v in read.items() if k in known} | (given or {}), unknown


RANGES = {
    "dpi": (lambda v: v > 0, "dpi must be > 0"), "workers": (lambda v: v >= 1, "workers must be >= 1"),
        "jpeg_quality": (lambda v: 1 <= v <= 100, "jpeg_quality must be between 1 and 100"),
    "sauvola_k": (lambda v: v > 0, "sauvola_k must be > 0"), "min_size": (lambda v: v >= 0, "min_size must be >= 0"),
        "photo_threshold": (lambda v: 0 <= v <= 1, "photo_threshold must be between 0 and 1"),
    "photo_dpi": (lambda v: v >= 0, "photo_dpi must be >= 0"), "min_savings": (lambda v: 0 <= v <= 1, "min_savings must be between 0 and 1"),
        "photo_descreen": (lambda v: v >= 0, "photo_descreen must be >= 0"),
    "timeout": (lambda v: v >= 0, "timeout must be >= 0"), "min_free_gb": (lambda v: v >= 0, "min_free_gb must be >= 0"),
        "limit": (lambda v: v >= 0, "limit must be >= 0"),
}


def invalid(options: dict) -> str:
    """All range failures of given options, joined by '; '."""
    return "; ".join(message for name, (fits, message) in RANGES.items() if name in options and not fits(options[name]))


def report_path(target: str, began: float, dry_run: bool = False) -> str:
    """A dated file in a folder, or the named file with the suffix .csv."""
    if os.path.isdir(target) or not os.path.splitext(target)[1]:
        return os.path.join(target, time.strftime("report_%Y%m%d_%H%M%S", time.localtime(began)) + "_DRYRUN" * dry_run + ".csv")
    return os.path.splitext(target)[0] + ".csv"


def two_decimals(size):
    """Bytes as MB with two decimals, rounded as the binary value falls (half to even on exact ties)."""
    return F.when(size.isNotNull(), F.format_string("%.2f", F.bround(size / F.lit(1048576.0), 2)))


def write_report(rows: DataFrame, path: str, notes: DataFrame | None = None) -> None:
    """The final report: one CSV sorted by lower-cased file, a pre-scan row first where there are notes."""
    blank = F.lit("")
    out = rows.select(
        F.lit(1).alias("ord"), F.col("file"), "action", "reason", "ocr", "language",
            F.when(F.col("orig") > 0, two_decimals(F.col("orig"))).otherwise("0.00").alias("orig size (MB)"),
        F.coalesce(two_decimals(F.col("new")), blank).alias("new size (MB)"), F.coalesce(F.col("pct").cast("string"), blank).alias("%"),
        *[(F.col(c) if c in rows.columns else blank).alias(c) for c in ("duplicate of", "page types", "scan signals", "note", "warnings")], "error")
    if notes is not None:
        first = notes.agg(F.array_join(F.array_sort(F.collect_list("warning")), "; ").alias("warnings")).withColumn("file",
            F.lit("(pre-scan)")).withColumn("ord", F.lit(0))
        out = out.unionByName(first, allowMissingColumns=True).na.fill("")
    out.orderBy("ord", F.lower("file"), "file").select(*vocab.REPORT_COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True,
        quoteAll=False, emptyValue="", escape='"')


def one_decimal(size):
    return F.format_string("%.1f", F.bround(F.coalesce(size, F.lit(0)) / F.lit(1048576.0), 1))


def folder_report(rollup: DataFrame) -> DataFrame:
    """FOLDER_COLUMNS of a rollup, and candidate."""
    flag = lambda c: F.col(c).cast("int")
    values = ["folder", "n_pdf", "n_scanned", "n_born", "n_err", "n_junk", "n_big", "n_no_ocr", "n_other", flag("only_pdfs"),
        *[one_decimal(F.col(c)) for c in ("total_bytes", "scanned_bytes", "compressible_bytes", "biggest_bytes")], "reasons"]
    return rollup.select(*[(F.col(v) if isinstance(v, str) else v).alias(name) for name, v in zip(vocab.FOLDER_COLUMNS, values)], flag("candidate").alias("candidate"))


def file_report(verdicts_: DataFrame) -> DataFrame:
    """FILE_COLUMNS of the real PDFs among classified files (path, bytes, is_pdf_name, not_pdf, scanned, born_digital, has_ocr, n_pages, scan_frac, error)."""
    flag = lambda c: F.col(c).cast("int")
    real = verdicts_.where("is_pdf_name AND NOT not_pdf")
    values = [F.col("path"), one_decimal(F.col("bytes")), flag("scanned"), flag("born_digital"), flag("has_ocr"), F.coalesce("n_pages", F.lit(0)),
        F.bround("scan_frac", 3), F.coalesce("error", F.lit(""))]
    return real.orderBy(F.desc("bytes"), "path").select(*[v.alias(name) for name, v in zip(vocab.FILE_COLUMNS, values)])


def write_triage(rollup: DataFrame, verdicts_: DataFrame, folder: str) -> None:
    """The four triage outputs: candidate folders as a table and as a list, all folders, all real PDFs."""
    most = rollup.orderBy(F.desc("compressible_bytes"), F.desc("scanned_bytes"), "folder")
    csv = lambda d, name, **k: d.write.mode("overwrite").csv(f"{folder}/{name}", header=True, emptyValue="", escape='"')
    csv(folder_report(most.where("candidate")).drop("candidate").coalesce(1), "candidates")
    most.where("candidate").select("folder").coalesce(1).write.mode("overwrite").text(f"{folder}/candidates_list")
    csv(folder_report(most).coalesce(1), "all_folders")
    csv(file_report(verdicts_), "files")


def write_work_list(rows: DataFrame, path: str) -> None:
    """Paths, biggest first, under a comment that counts them."""
    head = rows.agg(F.concat(F.lit("# "), F.count("*"), F.lit(" files, biggest first")).alias("value")).select(F.lit(0).alias("o"), F.lit(0.0).alias("s"), "value")
    body = rows.select(F.lit(1).alias("o"), (-F.col("size")).alias("s"), F.col("path").alias("value"))
    head.union(body).orderBy("o", "s", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path of any store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(rows: DataFrame, path: str, fits) -> bool:
    """Write rows under a name of their own, and give them ``path`` only if ``fits(what was read back)`` says so.

    What stood there before goes once the new table is whole; if it doesn't fit,
    the old one stays as it was.  Returns whether the new one is in place.
    """
    spark, draft = rows.sparkSession, f"{path.rstrip('/')}.part"
    rows.write.mode("overwrite").parquet(draft)
    fs, part = hadoop(spark, draft)
    if not fits(spark.read.schema(rows.schema).parquet(draft)):
        fs.delete(part, True)
        return False
    _, final = hadoop(spark, path)
    _, old = hadoop(spark, f"{path.rstrip('/')}.old")
    if fs.exists(final):
        fs.delete(old, True)
        fs.rename(final, old)
    if not fs.rename(part, final):
        fs.rename(old, final)
        raise OSError(f"{path} could not be put in place")
    fs.delete(old, True)
    return True


def promote(spark: SparkSession, decisions: DataFrame, outputs: str, archive: str, dry_run: bool = True) -> DataFrame:
    """(rel, decision) with what was done: files that are to be promoted replace those of the archive.

    ``decisions`` has (rel, decision, sha1 of the output as it was judged).  A
    file is copied under another name, compared with that digest, and renamed.
    Executors copy, so the folders must be ones that they share and mount.
    """
    if dry_run:
        return decisions.select("rel", F.when(F.col("decision") == "promote", "would promote").otherwise(F.col("decision")).alias("decision"))

    def run(batches):
        import hashlib
        import shutil

        import pyarrow as pa

        for batch in batches:
            told = []
            for rel, decision, sha1 in zip(*(batch.column(c).to_pylist() for c in ("rel", "decision", "sha1"))):
                if decision == "promote":
                    final = os.path.join(archive, rel)
                    shutil.copyfile(os.path.join(outputs, rel), final + ".part")
                    with open(final + ".part", "rb") as f:
                        same = hashlib.file_digest(f, "sha1").hexdigest() == sha1
                    if same:
                        os.replace(final + ".part", final)
                    else:
                        os.remove(final + ".part")
                    decision = "promoted" if same else "copy differs"
                told.append(decision)
            yield pa.RecordBatch.from_arrays([batch.column("rel"), pa.array(told, pa.string())], ["rel", "decision"])

    return decisions.select("rel", "decision", "sha1").mapInArrow(run, "rel string, decision string")


MANIFEST = "file string, type string, source string, source_page int, signals struct<ink_frac:double,photo_cov:double,type:string>, classifier_said string, verified boolean, note string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a fixture manifest, a JSON list; none if there is no such file."""
    fs, p = hadoop(spark, path)
    return spark.read.schema(MANIFEST).json(path, multiLine=True) if fs.exists(p) else spark.createDataFrame([], MANIFEST)


def write_manifest(entries: DataFrame, path: str) -> None:
    """One JSON list of the entries, by file; a manifest is a list that a person keeps, so one task writes it."""
    rows = entries.select("file", F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("entry"))
    text = rows.agg(F.concat(F.lit("[\n  "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "entry"))), lambda e: e.entry),
        ",\n  "), F.lit("\n]")).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def mirrored(files: DataFrame, root: str, dest: str) -> DataFrame:
    """Adds dest: the place under ``dest`` that a path has under ``root``."""
    return files.withColumn("dest", F.concat(F.lit(dest.rstrip("/")), F.substr("path", F.lit(len(root.rstrip("/")) + 1))))
