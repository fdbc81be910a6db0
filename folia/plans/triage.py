"""Triage, text gates and samples over documents as pages and sources as files or folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import even_sample, fingerprint_sample
from ..functions.text import norm_line, text_script, words
from ..operators import gates, triage
from .base import EVEN, NORM, PAGES, load, pages, query


def _files(spark, sf_dir):
    """Documents as files: other languages than en stand for files of other kinds."""
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = load(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    d = d.select(
        F.col("source").alias("folder"), F.octet_length("text").cast("long").alias("bytes"), (F.col("lang") != "es").alias("is_pdf_name"),
            (F.col("lang") == "de").alias("not_pdf"),
        F.when(F.col("lang") == "fr", 0.2).otherwise(0.9).alias("scan_frac"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("unreadable"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("searchable"))
    return triage.classify_files(d)


ROLLUP = """
 f0 AS (SELECT source AS folder, octet_length(encode(text)) AS bytes, lang <> 'es' AS is_pdf_name, lang = 'de' AS not_pdf, lang = 'fr' AS low,
   coalesce(toxic = 1, false) AS unreadable, coalesce(quality = 1, false) AS searchable
        FROM documents LEFT JOIN labels USING (doc_id)),
 f1 AS (SELECT *, NOT not_pdf AND NOT unreadable AND low AS born, NOT not_pdf AND NOT unreadable AND NOT low AS scanned FROM f0),
 f2 AS (SELECT *, NOT not_pdf AND NOT born AND searchable AS has_ocr FROM f1),
 r0 AS (SELECT folder, count(*) FILTER (is_pdf_name AND NOT not_pdf) AS n_pdf, count(*) FILTER (is_pdf_name AND scanned) AS n_scanned,
   count(*) FILTER (is_pdf_name AND born) AS n_born,
   count(*) FILTER (is_pdf_name AND NOT not_pdf AND unreadable) AS n_err, count(*) FILTER (is_pdf_name AND not_pdf) AS n_junk,
   count(*) FILTER (is_pdf_name AND scanned AND bytes >= 5000) AS n_big,
   count(*) FILTER (is_pdf_name AND scanned AND NOT has_ocr) AS n_no_ocr, count(*) FILTER (NOT is_pdf_name) AS n_other,
   CAST(coalesce(sum(bytes) FILTER (is_pdf_name AND NOT not_pdf), 0) AS BIGINT) AS total_bytes, CAST(coalesce(sum(bytes) FILTER (is_pdf_name AND scanned),
   0) AS BIGINT) AS scanned_bytes,
   CAST(coalesce(sum(bytes) FILTER (is_pdf_name AND scanned AND (bytes >= 5000 OR NOT has_ocr)), 0) AS BIGINT) AS compressible_bytes,
   CAST(coalesce(max(bytes) FILTER (is_pdf_name AND NOT not_pdf), 0) AS BIGINT) AS biggest_bytes FROM f2 GROUP BY folder),
 r AS (SELECT *, n_other = 0 AS only_pdfs,
   concat_ws(' ', CASE WHEN n_big > 0 THEN 'BIG(' || n_big || ')' END, CASE WHEN n_no_ocr > 0 THEN 'NO_OCR(' || n_no_ocr || ')' END, CASE
   WHEN n_other = 0 AND n_scanned > 0 THEN 'ONLY_PDFS' END) AS reasons,
   n_scanned > 0 AND (n_big > 0 OR n_no_ocr > 0) AS candidate FROM r0 WHERE n_pdf > 0)
"""


@query(f"WITH {ROLLUP} SELECT * FROM r")
def triage_folder_rollup(spark, sf_dir):
    return triage.folder_rollup(_files(spark, sf_dir), 5000).orderBy(F.desc("compressible_bytes"), F.desc("scanned_bytes"), "folder")


@query(f"WITH {ROLLUP} SELECT folder, compressible_bytes, scanned_bytes, reasons FROM r WHERE candidate")
def triage_candidates(spark, sf_dir):
    return triage.candidates(triage.folder_rollup(_files(spark, sf_dir), 5000)).select("folder", "compressible_bytes", "scanned_bytes", "reasons")


@query(f"WITH {PAGES}, n AS (SELECT file, count(*) AS n_pages FROM pages_ GROUP BY file) SELECT file, n_pages, unnest({EVEN.format(n='n_pages', k=8)}) AS page_no FROM n")
def even_page_sample(spark, sf_dir):
    n = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n_pages"))
    return n.select("file", "n_pages", F.explode(even_sample(F.col("n_pages"), 8).cast("array<long>")).alias("page_no"))


@query(f"""WITH n AS (SELECT source AS file, count(*) AS n FROM documents GROUP BY source),
 s AS (SELECT file, unnest(CASE WHEN n <= 12 THEN range(0, n) ELSE list_distinct(list_concat([0, 1, n - 2, n - 1], {EVEN.format(n='n', k=12)})) END) AS page_no
   FROM n) SELECT file, CAST(page_no AS BIGINT) AS page_no FROM s""")
def fingerprint_page_sample(spark, sf_dir):
    n = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n"))
    return n.select("file", F.explode(fingerprint_sample(F.col("n")).cast("array<long>")).alias("page_no"))


BOILER = """l AS (SELECT file, page_no, unnest(list_distinct(list_transform(string_split(text, chr(10)), x -> {norm}))) AS line FROM pages_
   WHERE regexp_replace(text, '\\s+', '', 'g') <> ''),
 c AS (SELECT file, line, count(*) AS n_on FROM l WHERE line <> '' GROUP BY file, line),
 w AS (SELECT file, count(*) AS with_text FROM pages_ WHERE regexp_replace(text, '\\s+', '', 'g') <> '' GROUP BY file HAVING count(*) >= 3),
 k AS (SELECT c.* FROM c JOIN w USING (file) WHERE n_on >= with_text * {share}),
 g AS (SELECT file FROM k GROUP BY file HAVING count(*) <= 4 AND sum(length(line)) <= 400), b AS (SELECT k.* FROM k SEMI JOIN g USING (file))"""
B90, B20 = (BOILER.format(norm=NORM.format("x"), share=s) for s in ("0.9::DOUBLE", "0.2::DOUBLE"))


STAMPED = PAGES.replace("coalesce(text, '') AS text",
    "coalesce(text, '') || CASE WHEN doc_id % 20 <> 3 AND source NOT LIKE '%a%' THEN chr(10) || '  Printed for  ' || source ELSE '' END AS text")


@query(f"WITH {STAMPED}, {B90} SELECT file, line, n_on FROM b")
def boilerplate_lines(spark, sf_dir):
    """At the share of pages that files are judged by; nineteen pages in twenty of some sources get a stamp."""
    stamp = F.when((F.col("doc_id") % 20 != 3) & ~F.contains("file", F.lit("a")), F.concat(F.lit("\n  Printed for  "), "file")).otherwise("")
    return gates.boilerplate_lines(pages(spark, sf_dir).withColumn("text", F.concat("text", stamp)))


@query(f"WITH {PAGES}, {B20} SELECT file, line, n_on FROM b")
def boilerplate_lines_low(spark, sf_dir):
    """The same at a fifth of the pages, a share at which lines are found."""
    return gates.boilerplate_lines(pages(spark, sf_dir), 0.2)


NET = f"""{PAGES}, {B20}, net AS (SELECT p.file, p.page_no, p.text, array_to_string(list_filter(string_split(p.text, chr(10)),
   x -> NOT list_contains(coalesce(q.ls, []), {NORM.format('x')})), chr(10)) AS net
 FROM pages_ p LEFT JOIN (SELECT file, list(line) AS ls FROM b GROUP BY file) q USING (file))"""


@query(f"WITH {NET} SELECT file, page_no, CAST(length(text) AS BIGINT) AS chars, CAST(length(net) AS BIGINT) AS net_chars, md5(net) AS net_md5 FROM net")
def text_net_of_boilerplate(spark, sf_dir):
    p = pages(spark, sf_dir)
    n = gates.net_text(p, gates.boilerplate_lines(p, 0.2))
    return n.select("file", F.col("page_no").cast("long").alias("page_no"), F.length("text").cast("long").alias("chars"),
        F.length("net").cast("long").alias("net_chars"), F.md5("net").alias("net_md5"))


SAMPLE = f"s AS (SELECT file, unnest({EVEN.format(n='n', k=8)}) AS page_no FROM (SELECT file, count(*) AS n FROM pages_ GROUP BY file)), sn AS (SELECT net.* FROM net JOIN s USING (file, page_no))"


def _sample(spark, sf_dir):
    p = pages(spark, sf_dir)
    return gates.net_text(gates.sampled_pages(p), gates.boilerplate_lines(p, 0.2))


@query(f"""WITH {NET}, {SAMPLE} SELECT file, count(*) AS readable, count(*) FILTER (length(trim(net)) >= 40) AS worded,
   count(*) FILTER (length(trim(net)) >= 40) >= 0.8::DOUBLE * count(*) AS searchable FROM sn GROUP BY file""")
def has_text_per_source(spark, sf_dir):
    return gates.has_text(_sample(spark, sf_dir))


@query(f"WITH {NET}, {SAMPLE} SELECT file, count(*) FILTER (length(trim(net)) >= 40) >= 0.01::DOUBLE * count(*) AS searchable FROM sn GROUP BY file")
def has_any_text(spark, sf_dir):
    return gates.has_text(_sample(spark, sf_dir), 0.01).select("file", "searchable")


@query(f"""WITH {PAGES} SELECT file, CAST(sum(CASE WHEN page_no < 6 THEN length(trim(text)) ELSE 0 END) AS BIGINT) AS chars, sum(CASE
   WHEN page_no < 6 THEN length(trim(text)) ELSE 0 END) >= 40 AS searchable FROM pages_ GROUP BY file""")
def has_text_triage_v1(spark, sf_dir):
    return gates.has_text_first_pages(pages(spark, sf_dir))


def _judged(spark, sf_dir):
    """Sampled pages with a stand-in resolution and a third of the text visible."""
    return _sample(spark, sf_dir).withColumn("dpi", F.pmod(F.col("page_no") * 37, F.lit(120)).cast("double")).withColumn("visible", F.floor(F.length("net") / 3))


JUDGED = f"{NET}, {SAMPLE}, j AS (SELECT *, CAST((page_no * 37) % 120 AS DOUBLE) AS dpi, length(net) // 3 AS visible FROM sn)"


@query(f"""WITH {JUDGED}, kinds AS (SELECT *, CASE WHEN visible >= 100 THEN 'text' WHEN dpi >= 50 THEN 'scan' WHEN length(net) >= 100 THEN 'text'
   ELSE 'none' END AS kind FROM j)
 SELECT file, count(*) AS sampled, count(*) FILTER (kind = 'scan') AS scan_pages, count(*) FILTER (kind = 'text') AS text_pages,
   CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (kind = 'scan') < 0.5::DOUBLE * count(*) AS born_digital FROM kinds GROUP BY file""")
def born_digital_signals(spark, sf_dir):
    return gates.born_digital(_judged(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT file, count(*) AS sampled, count(*) FILTER (dpi >= 50) AS scan_pages, count(*) FILTER (dpi >= 50) < 0.5::DOUBLE * count(*) AS born_digital FROM j GROUP BY file")
def born_digital_triage_v1(spark, sf_dir):
    return gates.born_digital_by_resolution(_judged(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT file, bool_or(dpi < 50) AS has_vector FROM j GROUP BY file")
def vector_page_presence(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("file").agg(F.bool_or(F.coalesce(F.col("dpi") < 50, F.lit(True))).alias("has_vector"))


@query("""SELECT doc_id, CASE WHEN n < 50 THEN '' WHEN c / n >= 0.2 THEN 'Cyrillic' WHEN j / n >= 0.2 THEN 'Japanese' ELSE '' END AS script
   FROM (SELECT doc_id, len(regexp_extract_all(t, '\\p{L}')) AS n,
 CAST(len(regexp_extract_all(t, '\\p{Cyrillic}')) AS DOUBLE) AS c, CAST(len(regexp_extract_all(t, '[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]')) AS DOUBLE) AS j
   FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN repeat('Снимите крышку ', CAST(doc_id % 9 AS INT)) || left(text, 200)
   WHEN 1 THEN repeat('部品を外す', CAST(doc_id % 30 AS INT)) || left(text, 90) ELSE text END AS t FROM documents))""")
def script_share(spark, sf_dir):
    """Texts with some Cyrillic or Japanese put before them, so that every branch is met."""
    k = F.col("doc_id")
    mixed = F.when(k % 5 == 0, F.concat(F.repeat(F.lit("Снимите крышку "), (k % 9).cast("int")), F.left("text", F.lit(200)))).when(k % 5 == 1,
        F.concat(F.repeat(F.lit("部品を外す"), (k % 30).cast("int")), F.left("text", F.lit(90)))).otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", text_script(mixed).alias("script"))


@query("SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS word FROM documents) GROUP BY word")
def word_counts(spark, sf_dir):
    """Counted in each document first, so a word that all hold meets as one row a task."""
    w = load(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return w.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"SELECT doc_id, {NORM.format('text')} AS line FROM documents")
def norm_lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", norm_line(F.col("text")).alias("line"))


@query("""SELECT doc_id, CASE WHEN born AND orig >= 2048 AND new < floor(orig * (1 - 0.03::DOUBLE)) THEN 'lossless rewrite' WHEN born THEN 'born digital'
   WHEN orig < 1024 THEN 'small size' WHEN pages >= 100 AND projected >= 0.75 THEN 'already compressed'
 WHEN new >= orig * (1 - 0.1::DOUBLE) THEN 'already compressed' ELSE 'compressible' END AS reason
   FROM (SELECT doc_id, octet_length(encode(text)) AS orig, CAST(length(text) * 4 // 5 + doc_id % 700 AS BIGINT) AS new, n_chars // 20 AS pages,
   lang = 'fr' AS born, (doc_id % 100) / 100.0::DOUBLE AS projected FROM documents)""")
def size_gates(spark, sf_dir):
    """Size floor, lossless floor and bar, pre-check and savings bar; sizes are stand-ins from text lengths."""
    d = load(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length("text").cast("long").alias("orig"), (F.floor(F.length("text") * 4 / 5) + F.col("doc_id") % 700).alias("new"),
            F.floor(F.col("n_chars") / 20).alias("pages"),
        (F.col("lang") == "fr").alias("born"), ((F.col("doc_id") % 100) / F.lit(100.0)).alias("projected"))
    _, reason = gates.decision(F.col("orig"), F.col("new"), F.col("pages"), F.col("born"), F.lit(False), F.col("projected"), 1 / 1024, 2 / 1024)
    return d.select("doc_id", reason.alias("reason"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not requested' WHEN quality = 1 THEN 'kept existing' WHEN n_chars > 1000 THEN 're-ocr'
   ELSE 'new ocr' END AS ocr FROM documents LEFT JOIN labels USING (doc_id)""")
def ocr_state_predictor(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", gates.ocr_state(F.col("doc_id") % 11 != 0, F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("n_chars") > 1000).alias("ocr"))
