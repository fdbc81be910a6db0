"""Files in, reports out, and the PDF scanner."""

import csv
import glob
import zlib

from pyspark.sql import functions as F

from folia.operators import gates, report, triage
from folia.sources import files, pdf


def test_tree_list_and_failed_rows(spark, tmp_path):
    for name in ("a/x.pdf", "a/y.PDF", "a/n.txt", "b/z.pdf"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"%PDF-1.4 " + name.encode())
    everything = files.tree(spark, str(tmp_path), None)
    assert {r.rel: r.bytes for r in files.tree(spark, str(tmp_path)).collect()} == {"a/x.pdf": 16, "b/z.pdf": 16}
    assert {r.folder.rsplit("/", 1)[1]: r.n_other for r in files.other_files(everything).collect()} == {"a": 1, "b": 0}
    (tmp_path / "list.txt").write_text(f"# head\n\n{tmp_path}/a/x.pdf\n{tmp_path}/gone.pdf\n")
    assert [r.path for r in files.listed(spark, str(tmp_path / "list.txt"), everything).collect()] == [f"{tmp_path}/a/x.pdf"]
    (tmp_path / "rep.csv").write_text('file,reason,orig size (MB),error\na,born digital,5.0,\nb,born digital,x,"bad, really"\nA,born digital,7.0, \n')
    assert [r.entry for r in files.failed_entries(spark, str(tmp_path / "rep.csv")).collect()] == ["b"]
    assert [(r.path, r["size"]) for r in files.report_candidates(spark, [str(tmp_path / "rep.csv")], least_mb=1).collect()] == [("A", 7.0)]
    assert files.mirrored(everything.where("rel = 'a/x.pdf'"), str(tmp_path), "/out/").first().dest == "/out/a/x.pdf"


def test_settings_and_ranges(tmp_path):
    (tmp_path / "c.toml").write_text("dpi = 300\nold = 1\n")
    values, unknown = files.settings(str(tmp_path / "c.toml"), {"dpi": 200, "workers": 1}, {"workers": 4})
    assert values == {"dpi": 300, "workers": 4} and unknown == ["old"]
    assert files.invalid({"dpi": 0, "workers": 2, "limit": -1}) == "dpi must be > 0; limit must be >= 0"
    assert files.report_path("run.log", 0) == "run.csv" and files.report_path(str(tmp_path), 0, True).endswith("_DRYRUN.csv")


def test_json_and_verdicts(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"a.pdf": "site",\n "b.pdf": "x"}')
    assert {r.name: r.value for r in files.json_map(spark, str(tmp_path / "o.json")).collect()} == {"a.pdf": "site", "b.pdf": "x"}
    assert files.verdicts(spark, spark.createDataFrame([("r",)], "rel string")).first().verdict == "ok"


def test_written_report(spark, tmp_path):
    rows = [("b", "compressed", "compressible", "new ocr", "eng", 3 << 20, 1 << 20, ""), ("A", "kept_original", "small size", "", "", 131072, 0, "")]
    d = report.report_rows(spark.createDataFrame(rows, "file string, action string, reason string, ocr string, lang string, orig long, new long, err string"))
    files.write_report(d, str(tmp_path / "r"), spark.createDataFrame([("odd name",)], "warning string"))
    with open(glob.glob(f"{tmp_path}/r/*.csv")[0]) as f:
        got = list(csv.reader(f))
    assert len(got[0]) == 14 and [r[0] for r in got[1:]] == ["(pre-scan)", "A", "b"]
    assert got[3][5:8] == ["3.00", "1.00", "33"] and got[2][5:7] == ["0.12", ""] and got[1][12] == "odd name"


def test_triage_outputs(spark, tmp_path):
    f = spark.createDataFrame([("f1", 100, True, False, 0.9, False, False), ("f1", 5, True, True, 0.9, False, False),
        ("f2", 10, True, False, 0.1, False, True), ("f3", 10, True, False, 0.9, True, False)],
                              "folder string, bytes long, is_pdf_name boolean, not_pdf boolean, scan_frac double, unreadable boolean, searchable boolean")
    c = triage.classify_files(f)
    r = triage.folder_rollup(c, 50)
    got = {x.folder: x for x in r.collect()}
    assert got["f1"].reasons == "BIG(1) NO_OCR(1) ONLY_PDFS" and got["f1"].n_junk == 1 and got["f1"].candidate and not got["f2"].candidate and got["f3"].n_err == 1 and not got["f3"].candidate
    files.write_triage(r, c.withColumn("path", F.col("folder")).withColumn("n_pages", F.lit(2)).withColumn("error", F.lit("")), str(tmp_path / "t"))
    files.write_work_list(spark.createDataFrame([("p", 2.0), ("q", 3.0)], "path string, size double"), str(tmp_path / "w"))
    assert spark.read.text(f"{tmp_path}/t/candidates_list").collect()[0].value == "f1"
    assert [x.value for x in spark.read.text(f"{tmp_path}/w").collect()] == ["# 2 files, biggest first", "q", "p"]


def one_file(spark, content, path="a"):
    return spark.createDataFrame([(path, bytearray(content))], "path string, content binary")


def test_publish_and_promote(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "table")
    assert files.publish(spark.range(3).toDF("id"), path, lambda d: d.count() == 3)
    assert not files.publish(spark.range(5).toDF("id"), path, lambda d: d.count() == 3) and spark.read.parquet(path).count() == 3
    assert files.publish(spark.range(5).toDF("id"), path, lambda d: True) and spark.read.parquet(path).count() == 5
    (tmp_path / "out").mkdir(), (tmp_path / "in").mkdir()
    for name in "abc":
        (tmp_path / "out" / name).write_text(name * 3), (tmp_path / "in" / name).write_text("old")
    digest = lambda name: hashlib.sha1(name.encode() * 3).hexdigest()
    d = spark.createDataFrame([("a", "promote", digest("a")), ("b", "not smaller", digest("b")), ("c", "promote", "0" * 40)], "rel string, decision string, sha1 string")
    dry = files.promote(spark, d, str(tmp_path / "out"), str(tmp_path / "in"))
    assert {r.rel: r.decision for r in dry.collect()} == {"a": "would promote", "b": "not smaller", "c": "would promote"}
    done = files.promote(spark, d, str(tmp_path / "out"), str(tmp_path / "in"), dry_run=False)
    assert {r.rel: r.decision for r in done.collect()} == {"a": "promoted", "b": "not smaller", "c": "copy differs"}
    assert [(tmp_path / "in" / name).read_text() for name in "abc"] == ["aaa", "old", "old"]


def test_fixture_manifest(spark, tmp_path):
    assert files.manifest(spark, str(tmp_path / "none.json")).count() == 0
    rows = [("b.png", "line", "m.pdf", 3, (0.02, 0.0, "line"), "line", True, None), ("a.png", "blank", None, None, None, None, False, "by hand")]
    files.write_manifest(spark.createDataFrame(rows, files.MANIFEST), str(tmp_path / "m"))
    back = files.manifest(spark, glob.glob(f"{tmp_path}/m/part-*")[0]).orderBy("file").collect()
    assert [(r.file, r.source_page, r.note) for r in back] == [("a.png", None, "by hand"), ("b.png", 3, None)] and back[1].signals.ink_frac == 0.02


def test_parts_of_a_tree_in_natural_order(spark):
    from folia.operators import sequences

    names = ["2.jpg", "10.jpg", "1/10.tif", "1/9.tif", "note.txt", "1/cover.png"]
    d = spark.createDataFrame([(n,) for n in names], "rel string")
    told = lambda **k: [r.rel for r in sequences.collected_parts(d, **k).orderBy("place").collect()]
    assert told() == ["2.jpg", "10.jpg"] and told(recursive=True) == ["1/9.tif", "1/10.tif", "1/cover.png", "2.jpg", "10.jpg"]


def test_pdf_strings():
    assert pdf.strings(rb"(a(b)c) <48 65> (x\)\101\n) << /K (v) >>") == [b"a(b)c", b"He", b"x)A\n", b"v"]
    assert pdf.strings(b"(a\\\r\nb) (\\53\\0053) <4> (open (inner) \\") == [b"ab", b"+\x053", b"@", b"open (inner) \\"]


def test_pdf_soundness_of_copies(spark):
    """One sound copy is kept beside a damaged one, whichever comes first; equal bytes, and ties, leave nothing to choose."""
    data = zlib.compress(b"BT ET" * 9)
    whole = b"1 0 obj << /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(data), data)
    cut = b"1 0 obj << /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n" % (len(data), data[:6])
    widths = [b"2 0 obj << /FirstChar 1 /LastChar 3 /Widths [%s] >> endobj\n" % w for w in (b"1 2", b"1 2 3", b"1 2 3 4")]
    for order in ((whole, cut), (cut, whole)):
        table = pdf.object_table(one_file(spark, b"%PDF-1.4\n" + b"".join([*order, *widths,
            b"3 0 obj << >> endobj 3 0 obj << >> endobj 4 0 obj << /A [ >> endobj 4 0 obj << /B 1 >> endobj 4 1 obj << /C 1 >> endobj"])))
        scores = sorted((r.num, r.score) for r in table.select("num", pdf.soundness().alias("score")).collect())
        assert scores == [(1, -1), (1, 3), (2, -1), (2, -1), (2, 2), (3, 1), (3, 1), (4, -1), (4, 1), (4, 1)]
        best = {r.num: r for r in pdf.best_copies(table).collect()}
        assert set(best) == {1, 2, 4} and best[1].start == (9 if order[0] is whole else 9 + len(cut)) and best[2].copies == 3 and best[4].gen == 0


def test_pdf_copies_of_many_files_in_few_batches_and_one_reading(spark, tmp_path):
    """Small files share batches and tasks are dealt by rows; files are parsed once, with the results of files one by one."""
    from folia.plans import archive

    root = str(tmp_path)
    spark.range(1, 9001).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{root}/customer.parquet")
    damaged = archive._damaged(spark, root)
    assert damaged.rdd.getNumPartitions() == 3
    best = archive.pdf_best_copies(spark, root)
    assert best._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert best.count() == 6000 + 6750 and best.where("earlier").count() == 3000 + 4500
    one = damaged.where("path IN ('6', '7')").orderBy("path")
    seen = []
    kept, pdf.typed = pdf.typed, lambda rows, columns: seen.append(len(rows)) or kept(rows, columns)
    try:
        class Rows:
            def select(self, *names):
                return self

            def mapInArrow(self, run, schema):
                import pyarrow as pa

                files = [pa.record_batch([pa.array([r.path for r in one.collect()] + [None, "x"]), pa.array([bytes(r.content) for r in one.collect()] + [b"", None])], ["path", "content"])] * 700
                return pa.Table.from_batches(run(files)).to_pylist()

        rows = pdf.object_table(Rows())
    finally:
        pdf.typed = kept
    assert len(rows) == 9800 and len(seen) == 3 and rows[:14] == rows[-14:]


def test_pdf_copy_table_is_the_object_table(spark):
    from folia.plans import archive

    files = spark.createDataFrame([(str(k), bytearray(archive.document(k)[: 900 * (k + 1)])) for k in range(12)], "path string, content binary")
    assert sorted(pdf.copy_table(files).collect()) == sorted(pdf.object_table(files).select(pdf.COPY).collect())


def test_pdf_best_copy_of_equal_paths(spark):
    """Two rows with one path count as one file: its best copies are then two, and none is kept."""
    sound, other = b"1 0 obj << /FirstChar 1 /LastChar 1 /Widths [1] >> endobj ", b"1 0 obj << /A 1 >> endobj "
    rows = [("a", bytearray(sound + other)), ("b", bytearray(other + sound)), ("b", bytearray(other + sound)), (None, bytearray(sound + other)), ("c", None)]
    best = pdf.best_copies(pdf.object_table(spark.createDataFrame(rows, "path string, content binary"))).collect()
    assert [(r.path, r.num, r.copies, r.score, r.start, r["first"]) for r in best] == [("a", 1, 2, 2, 0, 0)]


def test_pdf_pages_inherit_and_open(spark):
    body = (b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [4 0 R 3 0 R 2 0 R] /Rotate 90 /MediaBox [0 0 100 200] >> endobj "
            b"3 0 obj << /Type /Page /Annots [7 0 R 8 0 R] >> endobj 4 0 obj << /Type /Pages /Kids [5 0 R] /Rotate 0 >> endobj 5 0 obj << /Type /Page /MediaBox [0 0 50 60] /Contents [6 0 R 9 0 R] >> endobj ")
    rows = pdf.page_table(one_file(spark, body)).orderBy("page_no").collect()
    assert [(r.num, r.rotate, r.width, r.contents, r.annots, r.status) for r in rows] == [(5, 0, 50.0, [6, 9], 0, "ok"), (3, 90, 100.0, [], 2, "ok")]
    assert pdf.page_counts(pdf.page_table(one_file(spark, b"%PDF-1.4 nothing"))).first().n_pages is None
    # a file under the user password 'vector', revision 2, and one under another
    import hashlib

    ident, owner = b"0123456789abcdef", b"o" * 32
    for password, status in ((b"", "ok with password 0"), (b"vector", "ok with password 1"), (b"secret", "encrypted")):
        key = hashlib.md5((password + pdf.PADDING)[:32] + owner + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()[:5]
        user = pdf.rc4(key, pdf.PADDING)
        told = body + b"10 0 obj << /Filter /Standard /V 1 /R 2 /P -4 /O <%s> /U <%s> >> endobj trailer << /Root 1 0 R /Encrypt 10 0 R /ID [<%s> <00>] >>" % (owner.hex().encode(),
            user.hex().encode(), ident.hex().encode())
        assert {r.status for r in pdf.page_table(one_file(spark, told)).collect()} == {status}
    assert pdf.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def test_pdf_operators_feed_the_joins(spark):
    from folia.operators import pagefacts

    stream = b"/Im0 Do BT 3 Tr (a Tj b) Tj ET BT 0 Tr (seen) Tj ET"
    packed = zlib.compress(stream)
    d = one_file(spark, b"5 0 obj << /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj" % (len(packed), packed))
    ops = pdf.content_operators(d)
    assert [(r.kind, r.block_text) for r in ops.where("kind = 'block'").orderBy("pos").collect()] == [("block", "a Tj b"), ("block", "seen")]
    assert [r.reads for r in pagefacts.judged_shows(ops).orderBy("pos").collect()] == [False, True]
    boiler = spark.createDataFrame([("a", "seen")], "file string, line string")
    assert [r.reads for r in pagefacts.judged_shows(ops, boiler).orderBy("pos").collect()] == [False, False]


def test_forms_within_forms_are_read(spark):
    from folia.operators import pagefacts

    def form(n, body, names=b""):
        return b"%d 0 obj << /Type /XObject /Subtype /Form %s /Length %d >>\nstream\n%s\nendstream endobj " % (n, names, len(body), body)

    deep = b"".join(form(20 + k, b"/F Do", b"/Resources << /XObject << /F %d 0 R >> >>" % (21 + k)) for k in range(4)) + form(24, b"BT (deep) Tj ET")
    deeper = b"".join(form(30 + k, b"/F Do", b"/Resources << /XObject << /F %d 0 R >> >>" % (31 + k)) for k in range(5)) + form(35, b"BT (deeper) Tj ET")
    body = (b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] >> endobj "
            b"3 0 obj << /Type /Page /Contents 10 0 R /Resources << /XObject << /F 21 0 R >> >> >> endobj 4 0 obj << /Type /Page /Contents 10 0 R /Resources << /XObject << /F 31 0 R >> >> >> endobj "
            b"5 0 obj << /Type /Page /Contents 11 0 R /Resources << /XObject << /F 24 0 R /I 40 0 R >> >> >> endobj 40 0 obj << /Subtype /Image /Width 9 /Height 9 >>\nstream\nx\nendstream endobj ") + form(10,
                b"/F Do") + form(11, b"/F Do /I Do") + deep + deeper
    d = one_file(spark, body)
    pages, ops, objects = pdf.page_table(d), pdf.content_operators(d), pdf.object_table(d)
    assert [r.visible for r in pagefacts.visible_pages(pages, ops, objects).orderBy("page_no").collect()] == [True, False, False]
    assert [r.text for r in pagefacts.page_text(pages, ops, objects).orderBy("page_no").collect()] == ["deep", "", "deep"]


def test_size_gates(spark):
    d = spark.range(1)
    told = lambda *a, **k: d.select(gates.decision(*a, **k)[1].alias("r")).first().r
    lit = F.lit
    assert told(lit(1048575), lit(1), lit(1), lit(False), lit(False), lit(0.0), 1.0) == "small size" and told(lit(1048576), lit(1), lit(1),
        lit(False), lit(False), lit(0.0), 1.0) == "compressible"
    assert told(lit(1000), lit(900), lit(1), lit(False), lit(False), lit(0.0), 0.0) == "already compressed" and told(lit(1000), lit(899), lit(100),
        lit(False), lit(False), lit(0.75), 0.0) == "already compressed"
    assert told(lit(1000), lit(970), lit(1), lit(True), lit(False), lit(0.0), 0.0) == "born digital" and told(lit(1000), lit(970), lit(1), lit(True),
        lit(True), lit(0.0), 0.0) == "lossless rewrite"
