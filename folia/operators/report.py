"""One row for each file, its tallies, and the audits of what a run wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.numbers import floor_percent


def action_label(err: Column, action: Column) -> Column:
    kept, squeezed = action.isin("born_digital", "kept_original"), action == "compressed"
    return F.when(F.coalesce(err, F.lit("")) != "", vocab.FAILED).when(kept, vocab.KEPT).when(squeezed, vocab.COMPRESSED).otherwise(vocab.PROCESSED)


def report_rows(results: DataFrame) -> DataFrame:
    """The report's decision columns of (file, action, reason, ocr, lang, orig, new, err), sizes in bytes."""
    failed = F.coalesce(F.col("err"), F.lit("")) != ""
    mask = lambda c: F.when(failed, "").otherwise(F.coalesce(c, F.lit("")))
    orig, new = F.coalesce("orig", F.lit(0)), F.coalesce("new", F.lit(0))
    return results.select(
        "file", action_label(F.col("err"), F.col("action")).alias("action"), F.when(failed, vocab.ERROR).otherwise(F.coalesce("reason", F.lit(""))).alias("reason"),
        mask(F.col("ocr")).alias("ocr"), mask(F.when(F.col("ocr").isin(*vocab.OCR_RAN), F.col("lang"))).alias("language"), orig.alias("orig"),
        F.when(~failed & (new > 0), new).alias("new"), F.when(~failed, floor_percent(new, orig)).alias("pct"), F.coalesce("err", F.lit("")).alias("error"))


def reason_tally(rows: DataFrame) -> DataFrame:
    return rows.where("error = '' AND reason <> ''").groupBy("action", "reason").agg(F.count("*").alias("files"), F.sum("orig").alias("bytes"))


def ocr_tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ocr").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ocr")


def run_totals(rows: DataFrame) -> DataFrame:
    failed = F.col("error") != ""
    return rows.agg(
        F.count("*").alias("files"), F.count_if(F.col("action") == vocab.COMPRESSED).alias("compressed"),
            F.count_if(F.col("action") == vocab.KEPT).alias("kept"), F.count_if(failed).alias("failed"),
        F.sum(F.when(~failed, F.col("orig")).otherwise(0)).alias("orig"), F.sum(F.when(~failed, F.coalesce("new", F.col("orig"))).otherwise(0)).alias("new"))


def tally_text(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, tally) like 'line=12 vector=3', kinds sorted."""
    n = rows.groupBy(group, kind).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(kind, "n"))),
        lambda x: F.concat(x[kind], F.lit("="), x.n)), " ").alias("tally"))


def warning_tally(rows: DataFrame, most: int = 20) -> DataFrame:
    """Warnings (file, logger, msg, seq) as the first ``most`` distinct ones of each file, with counts."""
    n = rows.withColumn("msg", F.left("msg", F.lit(200))).groupBy("file", "logger", "msg").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    w = W.partitionBy("file").orderBy("first", "logger", "msg")
    return n.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most).select("file", "logger", "msg", "n", "turn")


def script_vote(votes: DataFrame) -> DataFrame:
    """The script with most confidence over a file's trusted pages; ties by the first seen, then by name."""
    s = votes.where(F.col("conf") >= vocab.SCRIPT_CONFIDENCE).groupBy("file", "script").agg(F.sum("conf").alias("score"), F.min("page_no").alias("first"))
    return s.groupBy("file").agg(F.max_by("script", F.struct("score", -F.col("first"), "script")).alias("script"), F.max("score").alias("score"))


def output_audit(pairs: DataFrame) -> DataFrame:
    """First fatal difference, and warnings, of (rel, pages, links, bookmarks, color, dangling, widths, recall) pairs."""
    b, a = (lambda c: F.col(f"{c}_before")), (lambda c: F.col(f"{c}_after"))
    fatal = F.coalesce(
        F.when(a("pages") != b("pages"), F.lit("page count differs")),
        F.when(b("color") & ~a("color"), F.lit("colour lost")),
        F.when(F.size(F.array_except(a("dangling"), b("dangling"))) > 0, F.lit("content dropped")),
        F.when(F.size(F.array_except(a("widths"), b("widths"))) > 0, F.lit("broken font metrics")),
        F.when(F.col("recall") < vocab.RECALL_FATAL, F.lit("searchable text lost")),
        F.when(a("links") < b("links"), F.lit("link annotations lost")),
        F.when(a("bookmarks") < b("bookmarks"), F.lit("bookmarks lost")))
    warn = F.array_join(F.array_compact(F.array(
        F.when(F.size(a("dangling")) > 0, F.lit("undefined already in the source")), F.when(F.size(a("widths")) > 0, F.lit("font metrics already so in the source")),
        F.when(F.col("recall") < vocab.RECALL_WARN, F.lit("text recall")))), ", ")
    return pairs.select("rel", fatal.alias("fatal"), F.when(fatal.isNull(), warn).otherwise("").alias("warnings"))


def review_flags(pairs: DataFrame) -> DataFrame:
    """Flags of the independent review: (rel, flags) joined by '; '."""
    b, a = (lambda c: F.col(f"{c}_before")), (lambda c: F.col(f"{c}_after"))
    moved = lambda label, c: F.concat(F.lit(label + " "), b(c), F.lit("->"), a(c))
    flags = F.array(
        F.when((b("colour_px") >= 500) & (a("colour_px") < 0.25 * b("colour_px")), moved("COLOUR LOST", "colour_px")),
        F.when(b("pages") != a("pages"), moved("PAGES", "pages")), F.when(b("links") > a("links"), moved("LINKS", "links")),
        F.when(b("bookmarks") > a("bookmarks"), moved("BOOKMARKS", "bookmarks")), F.when(a("unreadable"), F.lit("UNREADABLE OUTPUT")),
        F.when(F.col("recall") < vocab.RECALL_FLAG, F.lit("TEXT LOST")),
        F.when((b("chars") < 20) & (a("chars") < 20) & (a("pages") > 0), F.lit("NO TEXT LAYER (not searchable)")),
        F.when((a("bytes") > b("bytes") * 1.05) & (a("bytes") - b("bytes") > 200_000), F.lit("GREW")))
    return pairs.select("rel", F.array_join(F.array_compact(flags), "; ").alias("flags"))


def stream_audit(streams: DataFrame) -> DataFrame:
    """Verdict of (file, hash, reachable, total, after, size, is_xmp, is_doc_xmp, is_hint) rows.

    Reachable copies that the output lacks are private metadata, the document's
    own packet rewritten, a hint stream, or lost content; copies that were not
    reachable are dead objects; copies that the source lacks are added.
    """
    short = F.greatest(F.col("reachable") - F.col("after"), F.lit(0))
    all_short = F.greatest(F.col("total") - F.col("after"), F.lit(0))
    kind = F.when(F.col("is_xmp"), "xmp").when(F.col("is_doc_xmp"), "packet").when(F.col("is_hint"), "hint").otherwise("lost")
    of = lambda k: F.sum(F.when(kind == k, short).otherwise(0))
    dead_hint = F.sum(F.when(F.col("is_hint") & ~F.col("is_xmp"), all_short - short).otherwise(0))
    d = streams.groupBy("file").agg(
        of("xmp").alias("xmp"), (of("hint") + dead_hint).alias("hint"), of("lost").alias("lost"),
            F.max(F.when((kind == "packet") & (short > 0), 1).otherwise(0)).alias("packet"),
        F.sum(all_short).alias("_short"), F.sum(F.when(F.col("is_doc_xmp"), 0).otherwise(F.greatest(F.col("after") - F.col("total"), F.lit(0)))).alias("added"))
    d = d.withColumn("orphans", F.col("_short") - F.col("xmp") - F.col("lost") - F.col("packet") - F.col("hint")).drop("_short")
    return d.withColumn("verdict", F.when((F.col("lost") > 0) | (F.col("added") > 0), "FAILED").otherwise("ok"))


def fingerprint_difference(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(rel, difference): the first key that differs, null-safe; '' if none does; null if a side can't be judged."""
    first = F.coalesce(*[F.when(~F.col(f"{k}_before").eqNullSafe(F.col(f"{k}_after")), F.lit(k)) for k in keys], F.lit(""))
    return pairs.select("rel", F.when(F.col("judged_before") & F.col("judged_after"), first).alias("difference"))


def promotion(pairs: DataFrame) -> DataFrame:
    """(rel, decision) of outputs: promote, or the first reason not to."""
    why = (
        F.when(~F.col("verdict").eqNullSafe(F.lit("ok")), F.concat(F.lit("audit verdict "), F.coalesce("verdict", F.lit("none"))))
        .when(F.col("so").isNull() | F.col("no").isNull(), "missing source or output").when(F.col("no") >= F.col("so"), "not smaller")
        .when(F.col("pages_so") != F.col("pages_no"), "page count").otherwise("promote"))
    return pairs.select("rel", why.alias("decision"))


def repair_status(want: Column, trusted: Column, got: Column, salvaged: Column) -> Column:
    """repaired, incomplete or failed by the pages recovered and those that raw bytes show."""
    return (F.when((want == 0) & trusted, "failed").when(got >= F.greatest(want, F.lit(1)), "repaired").when(salvaged > 0, "incomplete").otherwise("failed"))


def reads_agree(a: Column, b: Column) -> Column:
    """Whether two digests are equal; one that is missing differs, and two that are missing tell nothing."""
    return F.when(a.isNotNull() | b.isNotNull(), a.eqNullSafe(b))
