"""Whole plans: what becomes of a file, a batch of files, and a folder of loose pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from . import gates, relations, report, sequences


def per_file(facts: DataFrame, floor_mb: float, lossless_floor_mb: float | None = None, saving: float = 0.1) -> DataFrame:
    """Results (file, action, reason, ocr, lang, orig, new, err, note) of files, from their facts, in one plan.

    ``facts`` has file, n_pages (null: can't be read), orig, born, decrypted,
    lossless_new (size after the lossless rewrite, null if it did not verify),
    projected, new (size after re-encoding), asked, all_text, any_text, lang and
    fatal (the audit's first difference, null if none).  The order is that of
    cost: open, born-digital lane, size floor, projection, savings bar, text
    layer, audit.  A file that its audit fails keeps its bytes, and says why.
    """
    f = facts.withColumn("candidate", F.when(F.col("born"), F.coalesce("lossless_new", "orig")).otherwise(F.col("new")))
    action, reason = gates.decision(F.col("orig"), F.col("candidate"), F.col("n_pages"), F.col("born"), F.col("decrypted"), F.col("projected"),
        floor_mb, lossless_floor_mb, saving)
    f = f.withColumn("action", action).withColumn("reason", reason).withColumn("ocr",
        gates.ocr_state(F.col("asked") & ~F.col("born"), F.col("all_text"), F.col("any_text")))
    unread = F.col("n_pages").isNull()
    err = F.when(unread, "cannot be read").when((F.col("action") == vocab.COMPRESSED) & F.col("fatal").isNotNull(),
        F.concat(F.lit("self-audit: "), F.col("fatal"))).otherwise("")
    shipped = (F.col("action") == vocab.COMPRESSED) & (err == "")
    raw = F.when(F.col("action") == vocab.COMPRESSED, F.lit("compressed")).when(F.col("reason") == vocab.BORN_DIGITAL, "born_digital").otherwise("kept_original")
    return f.select(
        "file", raw.alias("action"), "reason", "ocr", "lang", "orig", F.when(shipped, F.col("candidate")).otherwise(F.col("orig")).alias("new"), err.alias("err"),
        F.when(shipped & (F.col("reason") == vocab.LOSSLESS), lossless_note(F.col("orig"), F.col("candidate"), F.col("decrypted"))).otherwise("").alias("note"))


def preview(facts: DataFrame, floor_mb: float, saving: float = 0.1) -> DataFrame:
    """What per_file() would do, without a re-encoded file: (file, action, reason, scan_frac, projected_new).

    The projection stands for the size and is asked for whatever the number of
    pages; it is also told as scan_frac.
    """
    would = F.floor(F.col("orig") * F.col("projected")).cast("long")
    f = facts.withColumn("new", would).withColumn("fatal", F.lit(None).cast("string")).withColumn("lossless_new", F.lit(None).cast("long"))
    pages = F.when(F.col("n_pages").isNotNull(), F.greatest(F.col("n_pages"), F.lit(vocab.PRECHECK_PAGES)))
    rows = per_file(f.withColumn("n_pages", pages), floor_mb, None, saving).join(f.select("file", "projected"), "file")
    return rows.select("file", report.action_label(F.col("err"), F.col("action")).alias("action"),
        F.when(F.col("err") != "", vocab.ERROR).otherwise(F.col("reason")).alias("reason"), F.col("projected").alias("scan_frac"),
        F.floor(F.col("orig") * F.col("projected")).cast("long").alias("projected_new"))


def jobs(sources: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """What is still to do: without what is done, the first ``limit`` in order of the key if asked for, biggest first."""
    left = relations.still_to_do(sources, done, key)
    return (left.orderBy(key).limit(limit) if limit else left).orderBy(F.desc("orig"), key)


def batch(results: DataFrame, hashes: DataFrame) -> DataFrame:
    """Report rows of results with what each duplicates: the file with the same content (file, seq, sha1) that came first."""
    rows = report.report_rows(results).join(results.select("file", "note"), "file")
    first = sequences.first_seen(hashes, "sha1", "seq", "file").select("file", F.coalesce("duplicate_of", F.lit("")).alias("duplicate of"))
    return rows.join(first, "file", "left").na.fill("", ["duplicate of"]).orderBy(F.lower("file"), "file")


def merge_manifest(parts: DataFrame) -> DataFrame:
    """The order in which a folder's loose pages are merged: (folder, place, name, pages, first_page, readable).

    ``parts`` has folder, name, key, area, is_pdf and pages (null: can't be read).
    Smaller copies of a page go first of all; then names are put in natural order
    with the folder's common ends taken off, and pages are numbered through.
    Parts that can't be read keep their place and are told.
    """
    fates = sequences.page_identity_groups(parts.select("folder", "name", "key", "area", "is_pdf")).where("fate = 'drop'").select("folder", "name", "key")
    kept = parts.join(fates, ["folder", "name", "key"], "left_anti")
    ordered = sequences.natural_order(kept, "folder", "name")
    counted = ordered.withColumn("count", F.when(F.col("is_pdf"), F.coalesce("pages", F.lit(0))).otherwise(1))
    before = F.sum("count").over(W.partitionBy("folder").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    return counted.select("folder", "place", "name", F.col("count").cast("long").alias("pages"),
        (F.coalesce(before, F.lit(0)) + 1).cast("long").alias("first_page"), (~F.col("is_pdf") | F.col("pages").isNotNull()).alias("readable"))


# Notes ---------------------------------------------------------------------------


def two(size: Column) -> Column:
    return F.format_string("%.2f", F.bround(size / F.lit(1048576.0), 2))


def lossless_note(orig: Column, new: Column, decrypted: Column) -> Column:
    """What a lossless rewrite did, in a report's words."""
    percent = F.bround(100 * (1 - new / orig)).cast("int")
    first = F.concat(F.lit("lossless rewrite: "), two(orig), F.lit(" -> "), two(new), F.lit(" MB ("), percent, F.lit("% smaller)"))
    return F.concat(F.lit(" ("), F.concat_ws("; ", first, F.when(decrypted, vocab.DECRYPTED_NOTE)), F.lit(")"))


def repair_note(duplicates: Column, resolved: Column, before: Column, after: Column) -> Column:
    """What a repair did: duplicate objects and how many were settled, and the change in the number of objects."""
    bits = F.concat_ws(
        "; ", F.when(duplicates > 0, F.concat(duplicates, F.lit(" duplicate object(s), "), resolved, F.lit(" resolved"))),
        F.when((before > 0) & (after > 0) & (after != before), F.concat(F.lit("objects "), before, F.lit("->"), after)))
    return F.concat(F.lit(" (repaired malformed PDF"), F.when(bits != "", F.concat(F.lit(": "), bits)).otherwise(""), F.lit(")"))


def signals_text(scan_frac: Column, scan_pages: Column, sampled: Column, text_pages: Column, chars: Column, boiler: Column, error: Column) -> Column:
    """The born-digital evidence of a file as one line; what is null is left out, and a stamp is told by its shape."""
    lines, letters = F.size(boiler), F.aggregate(boiler, F.lit(0), lambda n, x: n + F.length(x))
    told = lambda name, v: F.concat(F.lit(name + "="), v)
    return F.concat_ws(
        " ", told("scan_frac", scan_frac.cast("string")), told("scan_pages", F.concat(scan_pages, F.lit("/"), sampled)),
            told("text_pages", text_pages), told("chars", chars),
        F.when(lines > 0, F.concat(F.lit("boiler="), lines, F.lit("ln/"), letters, F.lit("c"))), F.when(error != "", F.concat(F.lit("["), error, F.lit("]"))))


def pixel_label(w: Column, h: Column) -> Column:
    """Like 2550x3508 (8.9 MP); unreadable without a width."""
    return F.when(F.coalesce(w, F.lit(0)) > 0, F.concat(w, F.lit("x"), h, F.lit(" ("), F.format_string("%.1f", F.bround(w.cast("long") * h / 1e6, 1)),
        F.lit(" MP)"))).otherwise("unreadable")


def relative_label(path: Column, folder: Column) -> Column:
    """A path under its folder, else its name."""
    base = F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1)).otherwise(F.element_at(F.split(path, "/"), -1))


# Reports of reviews ----------------------------------------------------------------


def review_report(pairs: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """REVIEW_COLUMNS of before and after pairs, most shrunk first.

    ``pairs`` are those of report.review_flags() with words_before and
    words_after; ``origins`` (name, src) tells where a file came from, by its
    base name.
    """
    moved = lambda c: F.concat(F.col(f"{c}_before"), F.lit("->"), F.col(f"{c}_after"))
    rows = pairs.join(report.review_flags(pairs), "rel").withColumn("base", F.element_at(F.split(F.col("rel").cast("string"), "/"), -1))
    rows = rows.withColumn("src", F.lit("")) if origins is None else rows.join(origins.select(F.col("name").alias("base"), "src"), "base", "left").na.fill("", ["src"])
    before, after = F.col("bytes_before"), F.col("bytes_after")
    values = [
        F.col("rel").cast("string"), F.col("src"), before / F.lit(1048576.0), after / F.lit(1048576.0), 100 * after / F.greatest(before, F.lit(1)),
            F.col("pages_after"), F.col("words_before"), F.col("words_after"),
        F.coalesce(F.bround("recall", 3).cast("string"), F.lit("")), moved("links"), moved("bookmarks"),
            F.when(F.col("colour_px_before") >= 500, moved("colour_px")).otherwise("n/a"), F.col("flags")]
    return rows.select(*[v.alias(name) for name, v in zip(vocab.REVIEW_COLUMNS, values)]).orderBy("pct", "name")


def audit_report(streams: DataFrame, sizes: DataFrame, renders: DataFrame) -> DataFrame:
    """AUDIT_COLUMNS of lossless rewrites, sorted by file.

    ``streams`` as report.stream_audit() takes them, ``sizes`` (file, before,
    after), ``renders`` (file, pixels_same, pixels_judged, text_same, text_judged,
    problems array): a file whose renders differ has failed, whatever its
    streams say.
    """
    a = sizes.join(report.stream_audit(streams), "file", "left").join(renders, "file", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    lost = F.concat_ws("; ", F.when(F.col("lost") > 0, F.concat(count("lost"), F.lit(" reachable stream(s) lost"))),
        F.when(F.col("added") > 0, F.concat(count("added"), F.lit(" stream(s) added"))))
    differ = F.size(F.coalesce("problems", F.array().cast("array<string>"))) > 0
    detail = F.concat(lost, F.when(differ, F.concat(F.lit(" | RENDER: "), F.array_join(F.slice("problems", 1, 2), "; "))).otherwise(""))
    of = lambda same, judged: F.when(F.col(judged).isNotNull(), F.concat(F.col(same), F.lit("/"), F.col(judged))).otherwise("")
    values = [
        F.col("file"), F.bround(F.col("before") / F.lit(1048576.0), 3), F.bround(F.col("after") / F.lit(1048576.0), 3),
            F.bround(100 * F.col("after") / F.greatest("before", F.lit(1)), 1), count("xmp"), count("hint"), count("orphans"), count("lost"),
            count("added"),
        count("packet"), of("pixels_same", "pixels_judged"), of("text_same", "text_judged"),
            F.when(differ, "FAILED").otherwise(F.coalesce("verdict", F.lit("ok"))), detail]
    return a.select(*[v.alias(name) for name, v in zip(vocab.AUDIT_COLUMNS, values)]).orderBy(F.lower(F.col("file").cast("string")), "file")


def settings_report(fixtures: DataFrame, grid: DataFrame, measured: DataFrame) -> DataFrame:
    """MATRIX_COLUMNS of each fixture (type, fixture, orig_bytes) under each combo of a grid of settings.

    ``measured`` has (fixture, combo, out_bytes, raw_black_frac, ink_kept_frac).
    The grid is a few rows that a person lists; it is exploded in place, not joined.
    """
    combos = F.array(*[F.lit(r.combo) for r in grid.select("combo").orderBy("combo").collect()])
    rows = fixtures.withColumn("combo", F.explode(combos)).join(measured, ["fixture", "combo"], "left")
    return rows.withColumn("pct_of_orig", F.bround(100 * F.col("out_bytes") / F.greatest("orig_bytes", F.lit(1)), 1)).select(*vocab.MATRIX_COLUMNS)


def skipped_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rel, pages): the pages that either side could not be read on, each once; (rel, page) rows in."""
    return before.union(after).groupBy("rel").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def summary_lines(rows: DataFrame, elapsed_minutes: float) -> DataFrame:
    """(ord, line): the block of text that ends a run: totals, why files were kept, and the state of text layers."""
    t = report.run_totals(rows)
    head = t.select(F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.concat(F.col("files"), F.lit(" files, "), F.col("compressed"), F.lit(" compressed, "), F.col("kept"),
            F.lit(" kept, "), F.col("failed"), F.lit(" failed")).alias("line")),
        F.struct(F.lit(1).alias("ord"), F.concat(two(F.col("orig")), F.lit(" -> "), two(F.col("new")),
            F.lit(f" MB in {elapsed_minutes:.1f} min")).alias("line")))).alias("x")).select("x.*")
    why = report.reason_tally(rows).where(F.col("action") == vocab.KEPT).select(F.lit(2).alias("ord"),
        F.concat(F.lit("kept, "), "reason", F.lit(": "), "files", F.lit(" files, "), two(F.col("bytes")), F.lit(" MB")).alias("line"))
    ocr = report.ocr_tally(rows).where("ocr <> ''").select(F.lit(3).alias("ord"), F.concat(F.lit("text layer "), "ocr", F.lit(": "), "files").alias("line"))
    return head.union(why).union(ocr).orderBy("ord", "line")
