"""Queries that start from files: a small archive of PDFs, one a nation, in a folder a region.

The files are written to the shared folder first, from the nation table; what is
read back is judged by the same operators that a real archive goes through.
"""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import is_pdf_head, looks_like_pdf, raw_pages
from ..operators import gates, pagefacts, relations, triage
from ..session import kept, shared_folder
from ..sources import files, pdf
from .base import load, query, spread

STAMP = b"PROPERTY OF THE WORKSHOP 0001"
BODY = b"The valve is set to the mark, then the cover is closed and the bolts are drawn in turn. "


def document(k: int) -> bytes:
    """A PDF of k % 3 + 3 pages; its kind goes by k (see KINDS)."""
    pages, out = k % 3 + 3, [b"%PDF-1.4\n"]
    put = lambda n, body: out.append(b"%d 0 obj %s endobj\n" % (n, body))

    def stream(n: int, head: bytes, body: bytes, packed: bool):
        data = zlib.compress(body) if packed else body
        put(n, b"<< %s %s /Length %d >>\nstream\n%s\nendstream" % (head, b"/Filter /FlateDecode" if packed else b"", len(data), data))

    put(1, b"<< /Type /Catalog /Pages 2 0 R /Metadata 4 0 R >>")
    put(2, b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] %s >>" % (b" ".join(b"%d 0 R" % (10 + p) for p in range(pages)), pages,
        b"/Rotate 90" if k % 5 == 1 else b""))
    stream(4, b"/Type /Metadata", b"<?xpacket begin?>" + b"m" * k, False)
    stream(5, b"/Type /Metadata", b"<?xpacket begin?>" + b"p" * (2 * k), False)
    stream(6, b"/Type /XObject /Subtype /Image /Width 1700 /Height 2200", b"i" * 40, False)
    stream(7, b"/Type /XObject /Subtype /Form", b"BT 0 Tr (" + BODY * 5 + b") Tj ET", k % 2 == 0)  # too long for a stamp
    for j in range(k % 3):
        put(50 + j, b"<< /Type /Annot /Subtype /Link >>")
    for j in range(k % 4):
        put(60 + j, b"<< /Title (part %d) /Parent 59 0 R >>" % j)
    for p in range(pages):
        own = (b"/Rotate 180 " if p == 0 and k % 7 == 0 else b"") + (b"/Annots [%s] " % b" ".join(b"%d 0 R" % (50 + j) for j in range(k % 3)) if p == 0 else b"") + (b"/Metadata 5 0 R " if p == 0 else b"")
        put(10 + p, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %s/Resources << /XObject << /Im0 6 0 R /Fm0 7 0 R >> >> >>" % (30 + p, own))
        text = b"BT %d Tr (page %d: " + BODY * 2 + b") Tj ET "
        stamp = b"BT 0 Tr (" + STAMP + b") Tj ET "
        if k % 6 == 3:
            body = b"q /Fm0 Do Q"
        elif k % 2:
            body = text % (0, p)
        elif k % 4 == 0:
            body = b"/Im0 Do " + text % (3, p) + stamp
        elif k % 10 == 2:
            body = text % (0, p) + b"/Im0 Do " + stamp
        else:
            body = b"/Im0 Do " + stamp
        stream(30 + p, b"", body, k % 2 == 0)
    return b"".join(out) + b"trailer << /Root 1 0 R >>\n"


def content_of(k: int) -> tuple[str, bytes]:
    """(suffix, bytes) of the file of nation k."""
    if k % 8 == 5:
        return ".txt", b"notes"
    if k % 9 == 4:
        return ".pdf", b"<html>not a document</html>"
    if k % 11 == 7:
        return ".pdf", b"%PDF-1.4\n1 0 obj << /Broken true >> endobj\n"
    return (".PDF" if k % 2 else ".pdf"), document(k)


#: The same kinds in SQL: txt, junk, broken; then form (a page's text in a form), text, ocr, under (text below an image) and bare.
KINDS = """f AS (SELECT n_nationkey AS k, n_name AS name, r_name AS folder, CASE WHEN n_nationkey % 8 = 5 THEN 'txt' WHEN n_nationkey % 9 = 4 THEN 'junk'
   WHEN n_nationkey % 11 = 7 THEN 'broken' WHEN n_nationkey % 6 = 3 THEN 'form'
 WHEN n_nationkey % 2 = 1 THEN 'text' WHEN n_nationkey % 4 = 0 THEN 'ocr' WHEN n_nationkey % 10 = 2 THEN 'under' ELSE 'bare' END AS kind FROM nation
   JOIN region ON n_regionkey = r_regionkey),
 d AS (SELECT *, k % 3 + 3 AS n FROM f WHERE kind NOT IN ('txt', 'junk', 'broken')), p AS (SELECT *, unnest(range(0, n)) AS page_no FROM d)"""


def archive(spark, sf_dir) -> str:
    """The root of a new tree of files, one for each row of nation."""
    from pyspark.sql.functions import col

    root = shared_folder(spark, "archive")
    jvm = spark.sparkContext._jvm
    rows = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), col("n_regionkey") == col("r_regionkey")).select("n_nationkey", "n_name",
        "r_name").collect()  # 25 rows at every scale
    for r in rows:
        suffix, data = content_of(r.n_nationkey)
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{r.r_name}/{r.n_name}{suffix}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
        out.write(data)
        out.close()
    return root


def _catalog(spark, sf_dir):
    """(path, folder, name, bytes, content) of all files of the archive."""
    c = files.tree(spark, archive(spark, sf_dir), suffix=None, content=True)
    return c.withColumn("folder", F.element_at(F.split("folder", "/"), -1)).withColumn("name", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))


def read_facts(d):
    """The tables of pages, operators and objects of files (path, content); the bytes are read once for each, and not again."""
    return kept(pdf.page_table(d), "pages"), kept(pdf.content_operators(d), "operators"), kept(pdf.object_table(d), "objects")


def _pdfs(spark, sf_dir):
    return _catalog(spark, sf_dir).where(F.lower("path").endswith(".pdf") & is_pdf_head(F.col("content"))).select(F.col("name").alias("path"), "content")


@query(f"""WITH {KINDS} SELECT folder, name, kind <> 'txt' AS is_pdf_name, kind NOT IN ('txt', 'junk') AS is_pdf, kind NOT IN ('txt', 'junk') AS merges, CASE
   WHEN kind = 'txt' THEN 0 WHEN kind IN ('junk', 'broken') THEN 0 ELSE n END AS raw_pages FROM f LEFT JOIN d USING (k, name, folder, kind)""")
def archive_catalog(spark, sf_dir):
    """Walk, suffix in any case, both magic gates, and pages seen in raw bytes."""
    c, content = _catalog(spark, sf_dir), F.col("content")
    return c.select("folder", "name", F.lower("path").endswith(".pdf").alias("is_pdf_name"), is_pdf_head(content).alias("is_pdf"),
        looks_like_pdf(content).alias("merges"), raw_pages(content).pages.alias("raw_pages"))


@query(f"""WITH {KINDS} SELECT name, page_no, CASE WHEN page_no = 0 AND k % 7 = 0 THEN 180 WHEN k % 5 = 1 THEN 90
   ELSE 0 END AS rotate, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, CASE WHEN page_no = 0 THEN k % 3 ELSE 0 END AS annots, 'ok' AS status FROM p
 UNION ALL SELECT name, NULL, NULL, NULL, NULL, NULL, 'unreadable' FROM f WHERE kind = 'broken'""")
def pdf_page_table(spark, sf_dir):
    """Pages in tree order with what they inherit; a file that can't be opened has one row that says so."""
    return pdf.page_table(_pdfs(spark, sf_dir)).select(F.col("path").alias("name"), "page_no", "rotate", "width", "height", "annots", "status")


@query(f"WITH {KINDS} SELECT name, CASE WHEN kind <> 'broken' THEN k % 3 + 3 END AS n_pages, kind <> 'broken' AND k % 3 + 3 > 3 AS has_page_3 FROM f WHERE kind NOT IN ('txt', 'junk')")
def pdf_page_counts(spark, sf_dir):
    """Pages of each file, null where it can't be read, and one page looked up."""
    pages = pdf.page_table(_pdfs(spark, sf_dir))
    found = pdf.page_at(pages, 3).select("path", F.lit(True).alias("has"))
    return pdf.page_counts(pages).join(found, "path", "left").select(F.col("path").alias("name"), "n_pages", F.coalesce("has", F.lit(False)).alias("has_page_3"))


FORM = "repeat('The valve is set to the mark, then the cover is closed and the bolts are drawn in turn. ', 5)"
TEXT = "'page ' || page_no || ': ' || repeat('The valve is set to the mark, then the cover is closed and the bolts are drawn in turn. ', 2)"
STAMPED = "'PROPERTY OF THE WORKSHOP 0001'"


@query(f"""WITH {KINDS} SELECT name, page_no, kind IN ('text', 'form') AS visible, CAST(length(CASE kind WHEN 'text' THEN {TEXT}
   WHEN 'ocr' THEN {TEXT} || chr(10) || {STAMPED} WHEN 'under' THEN {TEXT} || chr(10) || {STAMPED} WHEN 'bare' THEN {STAMPED} ELSE {FORM} END) AS BIGINT) AS chars,
 kind NOT IN ('text', 'form') AS image FROM p""")
def pdf_visible_text(spark, sf_dir):
    """Text by render mode, by what is painted over it, through forms, and without the file's stamp."""
    d = _pdfs(spark, sf_dir)
    pages, ops, objects = read_facts(d)
    text = kept(pagefacts.page_text(pages, ops, objects), "text")
    boiler = gates.boilerplate_lines(text.withColumnRenamed("path", "file"), 0.9)
    seen = pagefacts.visible_pages(pages, ops, objects, boiler).join(text, ["path", "page_no"])
    drawn = ops.where("kind = 'draw' AND arg = '/Im0'").select("path", F.explode(F.array("stream")).alias("stream")).distinct()
    image = pages.where("page_no IS NOT NULL").select("path", "page_no", F.explode("contents").alias("stream")).join(drawn, ["path", "stream"],
        "left_semi").select("path", "page_no", F.lit(True).alias("image"))
    return seen.join(image, ["path", "page_no"], "left").select(F.col("path").alias("name"), "page_no", "visible",
        F.length("text").cast("long").alias("chars"), F.coalesce("image", F.lit(False)).alias("image"))


def triage_of_files(catalog, big_bytes: int):
    """(files, rollup) of (path, folder, name, bytes, content): from the bytes of files to what is known of folders.

    Name and magic gates, page sample, born-digital and text gates, verdicts,
    and the measures of folders, in one plan.
    """
    named = catalog.withColumn("is_pdf_name", F.lower("path").endswith(".pdf")).withColumn("not_pdf", F.col("is_pdf_name") & ~is_pdf_head(F.col("content")))
    d = named.where("is_pdf_name AND NOT not_pdf").select("path", "content")
    pages, ops, objects = read_facts(d)
    text, images = kept(pagefacts.page_text(pages, ops, objects), "text"), pagefacts.page_images(pages, objects)
    boiler = gates.boilerplate_lines(text.withColumnRenamed("path", "file"))
    boiler = kept(boiler, "boiler")
    sample = kept(pagefacts.sample_record(pages, text, images, boiler, pagefacts.visible_pages(pages, ops, objects, boiler)), "sample")
    key = lambda x: x.withColumnRenamed("file", "path")
    born = key(gates.born_digital(sample)).select("path", (F.col("scan_pages") / F.col("sampled")).alias("scan_frac"))
    searchable = key(gates.has_text(sample)).select("path", "searchable")
    facts = named.drop("content").join(pdf.page_counts(pages), "path", "left").join(born, "path", "left").join(searchable, "path", "left")
    facts = facts.withColumn("unreadable", F.coalesce(~F.col("status").startswith("ok"), F.lit(False))).withColumn("scan_frac",
        F.coalesce("scan_frac", F.lit(0.0))).withColumn("searchable", F.coalesce("searchable", F.lit(False)))
    verdict = triage.classify_files(facts).withColumn("error", F.when(F.col("not_pdf"), "not a PDF (bad header)").when(F.col("unreadable"),
        F.col("status")).otherwise(""))
    verdict = kept(verdict, "verdicts")
    return verdict, kept(triage.folder_rollup(verdict, big_bytes), "rollup")


TRIAGED = f"""{KINDS}, t AS (SELECT *, kind IN ('ocr', 'under', 'bare') AS scanned, kind = 'ocr' OR kind = 'under' AS has_ocr FROM f),
 g AS (SELECT folder, count(*) FILTER (kind NOT IN ('txt', 'junk')) AS pdfs, count(*) FILTER (scanned) AS scanned, count(*) FILTER (kind IN ('text',
   'form')) AS born_digital, count(*) FILTER (kind = 'broken') AS errors, count(*) FILTER (kind = 'junk') AS junk_pdf,
  count(*) FILTER (scanned AND NOT has_ocr) AS no_ocr, count(*) FILTER (kind = 'txt') AS other_files FROM t GROUP BY folder)"""


@query(f"""WITH {TRIAGED} SELECT folder, CAST(pdfs AS VARCHAR) AS pdfs, CAST(scanned AS VARCHAR) AS scanned, CAST(born_digital AS VARCHAR) AS born_digital,
   CAST(errors AS VARCHAR) AS errors, CAST(junk_pdf AS VARCHAR) AS junk_pdf, '0' AS big, CAST(no_ocr AS VARCHAR) AS no_ocr,
   CAST(other_files AS VARCHAR) AS other_files,
 CASE WHEN other_files = 0 THEN '1' ELSE '0' END AS only_pdfs, '0.0' AS total_MB, '0.0' AS scanned_MB, '0.0' AS compressible_MB, '0.0' AS biggest_MB,
   concat_ws(' ', CASE WHEN no_ocr > 0 THEN 'NO_OCR(' || no_ocr || ')' END, CASE WHEN other_files = 0 AND scanned > 0 THEN 'ONLY_PDFS' END) AS reasons,
 CASE WHEN scanned > 0 AND no_ocr > 0 THEN '1' ELSE '0' END AS candidate, scanned > 0 AND no_ocr > 0 AS listed FROM g WHERE pdfs > 0""")
def triage_driver(spark, sf_dir):
    """The triage of a tree of files, from walk to the four reports, as the reports are read back."""
    verdict, rollup = triage_of_files(_catalog(spark, sf_dir), 1 << 40)
    out = shared_folder(spark, "triage")
    files.write_triage(rollup, verdict, out)
    listed = spark.read.text(f"{out}/candidates_list").select(F.col("value").alias("folder"), F.lit(True).alias("listed"))
    rows = spark.read.csv(f"{out}/all_folders", header=True).na.fill("")
    return rows.join(listed, "folder", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


@query(f"""WITH {TRIAGED} SELECT name, '0.0' AS size_MB, CASE WHEN scanned THEN '1' ELSE '0' END AS scanned, CASE WHEN kind IN ('text', 'form') THEN '1'
   ELSE '0' END AS born_digital, CASE WHEN has_ocr THEN '1' ELSE '0' END AS has_ocr,
 CAST(CASE WHEN kind = 'broken' THEN 0 ELSE k % 3 + 3 END AS VARCHAR) AS pages, CASE WHEN scanned THEN '1.0' ELSE '0.0' END AS scan_frac, CASE
   WHEN kind = 'broken' THEN 'unreadable' ELSE '' END AS error FROM t WHERE kind NOT IN ('txt', 'junk')""")
def triage_file_report(spark, sf_dir):
    """The file report of the same triage: one row for each real PDF."""
    verdict, rollup = triage_of_files(_catalog(spark, sf_dir), 1 << 40)
    out = shared_folder(spark, "triage")
    files.write_triage(rollup, verdict, out)
    rows = spark.read.csv(f"{out}/files", header=True).na.fill("")
    return rows.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"), *vocab.FILE_COLUMNS[1:])


LENGTHS = f"""CASE kind WHEN 'form' THEN 11 WHEN 'text' THEN length('BT 0 Tr (' || {TEXT} || ') Tj ET ')
   WHEN 'ocr' THEN length('/Im0 Do BT 3 Tr (' || {TEXT} || ') Tj ET BT 0 Tr (' || {STAMPED} || ') Tj ET ')
 WHEN 'under' THEN length('BT 0 Tr (' || {TEXT} || ') Tj ET /Im0 Do BT 0 Tr (' || {STAMPED} || ') Tj ET ') ELSE length('/Im0 Do BT 0 Tr (' || {STAMPED} || ') Tj ET ') END"""


@query(f"""WITH {KINDS} SELECT name, CAST(max(n) AS BIGINT) AS pages, CAST(max(k % 3) AS BIGINT) AS annots, count(*) AS content_parts,
   CAST(sum({LENGTHS}) AS BIGINT) AS content_decoded, CAST(max(k % 3) AS BIGINT) AS links, CAST(max(k % 4) AS BIGINT) AS bookmarks FROM p GROUP BY name""")
def pdf_content_totals(spark, sf_dir):
    """Decoded bytes and parts of all pages' contents, and what leads from page to page."""
    d = _pdfs(spark, sf_dir)
    pages, objects = pdf.page_table(d), pdf.object_table(d)
    totals = pdf.content_totals(pages, objects).join(pdf.navigation_counts(pages, objects), "path").where("pages > 0")
    return totals.select(F.col("path").alias("name"), *["pages", "annots", "content_parts", "content_decoded", "links", "bookmarks"])


@query(f"""WITH {KINDS} SELECT name, CAST(4 + max(n) AS BIGINT) AS streams, CAST(max(17 + k + 17 + 2 * k + 40) + max(CASE WHEN k % 2 = 0 THEN 0
   ELSE length('BT 0 Tr (' || {FORM} || ') Tj ET') END) + sum(CASE WHEN k % 2 = 0 THEN 0 ELSE {LENGTHS} END) AS BIGINT) AS unfiltered,
   CAST(max(17 + 2 * k) AS BIGINT) AS xmp FROM p GROUP BY name""")
def pdf_rewrite_signature(spark, sf_dir):
    """What a lossless rewrite has to work with: bytes without a filter, and of packets that the catalog doesn't name."""
    return pdf.rewrite_signature(pdf.object_table(_pdfs(spark, sf_dir))).select(F.col("path").alias("name"), "streams", "unfiltered", "xmp")


@query(f"""WITH {KINDS} SELECT name, CAST(count(*) * 2 + 6 + max(k % 3) AS BIGINT) AS reached FROM p GROUP BY name""")
def pdf_reachable_objects(spark, sf_dir):
    """Objects that the catalog of each file reaches: bookmarks without an outline are dead."""
    d = _pdfs(spark, sf_dir)
    table = kept(pdf.object_table(d), "objects")
    objects = pdf.last_definitions(table)
    key = lambda c: F.concat("path", F.lit("/"), F.col(c))
    edges = pdf.reference_edges(table).select(key("src").alias("src"), key("dst").alias("dst"))
    roots = objects.where("type = 'Catalog'").select(key("num").alias("node"))
    reached = relations.reachable(edges, roots).select("node").join(objects.select(key("num").alias("node")), "node", "left_semi")
    return reached.groupBy(F.regexp_extract("node", "^(.*)/", 1).alias("name")).agg(F.count("*").alias("reached"))


PACKED = zlib.compress(b"BT ET" * 9).hex()


def _damaged(spark, sf_dir):
    """A file a customer that defines its objects 1 to 3 twice, in ways that go by the customer's number."""
    k = F.col("c_custkey")
    text = lambda s: F.lit(s.encode().hex())
    sound = F.concat(text(f"1 0 obj << /Filter /FlateDecode /Length {len(PACKED) // 2} >>\nstream\n"), F.lit(PACKED), text("\nendstream endobj\n"))
    cut = F.concat(text(f"1 0 obj << /Filter /FlateDecode /Length {len(PACKED) // 2} >>\nstream\n"), F.lit(PACKED[:20]), text("\nendstream endobj\n"))
    good, bad, open_ = (text(f"2 0 obj << /FirstChar 1 /LastChar 3 {w} endobj\n") for w in ("/Widths [1 2 3] >>", "/Widths [1 2] >>", "/Widths [1 2 3]"))
    first = F.when(k % 3 == 0, F.concat(sound, cut)).when(k % 3 == 1, F.concat(cut, sound)).otherwise(F.concat(sound, sound))
    second = F.when(k % 4 == 0, F.concat(bad, good)).when(k % 4 == 1, F.concat(good, open_)).when(k % 4 == 2,
        F.concat(bad, open_)).otherwise(F.concat(good, text("2 0 obj << /Other 1 >> endobj\n")))
    third = text("3 0 obj << /A 1 >> endobj 3 1 obj << /B 1 >> endobj 3 0 obj << /C 1 >> endobj\n")
    return spread(load(spark, sf_dir, "customer").select("c_custkey"), 4096).select(k.cast("string").alias("path"), F.unhex(F.concat(text("%PDF-1.4\n"), first, second, third)).alias("content"))


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS path, c_custkey AS k FROM customer),
 s AS (SELECT path, 1 AS num, 0 AS gen, unnest(CASE k % 3 WHEN 0 THEN [3, -1] WHEN 1 THEN [-1, 3] ELSE [3, 3] END) AS score FROM c UNION ALL
   SELECT path, 2, 0, unnest(CASE k % 4 WHEN 0 THEN [-1, 2] WHEN 1 THEN [2, -1] WHEN 2 THEN [-1, -1] ELSE [2, 1] END) FROM c
  UNION ALL SELECT path, 3, unnest([0, 1, 0]), 1 FROM c) SELECT path, CAST(num AS BIGINT) AS num, gen, score, count(*) AS n FROM s GROUP BY ALL""")
def pdf_object_soundness(spark, sf_dir):
    """How many definitions of each object look how whole."""
    t = pdf.copy_table(_damaged(spark, sf_dir))
    return t.groupBy("path", "num", "gen", pdf.soundness().alias("score")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS path, 1::BIGINT AS num, 0 AS gen, 2::BIGINT AS copies, 3 AS score, c_custkey % 3 = 0 AS earlier FROM customer
   WHERE c_custkey % 3 <> 2
 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, 0, 2, 2, c_custkey % 4 <> 0 FROM customer WHERE c_custkey % 4 <> 2""")
def pdf_best_copies(spark, sf_dir):
    """The copy to keep of objects that are defined in several ways: the only best one, if it is whole."""
    best = pdf.best_copies(pdf.copy_table(_damaged(spark, sf_dir)))
    return best.select("path", "num", "gen", "copies", "score", (F.col("start") == F.col("first")).alias("earlier"))


@query("""SELECT c_custkey AS key, unnest([0, 1, 2]) AS ord, unnest([c_name || ' (' || c_nationkey || ')', 'He', 'x)A' || chr(10)]) AS value FROM customer""")
def pdf_literal_strings(spark, sf_dir):
    """Strings with nested parentheses, hexadecimal digits and escapes."""
    c = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.concat(F.lit("[("), "c_name", F.lit(" ("), "c_nationkey",
            F.lit(r")) << /K 1 >> <48 65> (x\)\101\n)] TJ")).cast("binary").alias("content"))
    return pdf.string_table(c)


@query("""SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS w, CAST(p_size + 100 AS BIGINT) AS h, CAST(p_size * 10 AS DOUBLE) * 72.0::DOUBLE / CASE
   WHEN p_partkey % 5 = 0 THEN 72 ELSE 200 END AS width_pt FROM part WHERE p_partkey % 7 <> 0""")
def wrapper_headers(spark, sf_dir):
    """Sizes of bitonal page files from four big-endian numbers; every seventh file is cut short, every fifth tells no resolution."""
    key, size = F.col("p_partkey"), F.col("p_size")
    number = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    res = F.when(key % 5 == 0, 0).otherwise(200)
    whole = F.concat(F.lit("00" * 11), number(size * 10), number(size + 100), number(res), number(res), F.lit("00" * 8))
    p = load(spark, sf_dir, "part").select(key.alias("name"), F.unhex(F.when(key % 7 == 0, F.left(whole, F.lit(40))).otherwise(whole)).alias("content"))
    return pdf.wrapper_pages(p).select(F.col("name").alias("p_partkey"), "w", "h", "width_pt")
