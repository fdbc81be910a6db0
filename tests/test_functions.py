"""Column functions and operators on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from folia.functions import numbers, text
from folia.operators import gates, relations, report, sequences


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def in_order(spark, names):
    d = spark.createDataFrame([(n,) for n in names], "name string").withColumn("folder", F.lit("f"))
    random.Random(4).shuffle(names)
    return [r.name for r in sequences.natural_order(d, "folder", "name").orderBy("place").collect()]


@pytest.mark.parametrize("want", [
    ["1-1", "1-2", "1-11", "2-1", "2a-1", "2b-1"], ["EM-2", "EM-10", "EM11", "EM-12"], ["BO-2", "BO-3", "B0-4", "B0-11", "B040", "BO169"],
    ["cover.jpg", "foreword.pdf", "index.tif", "1-1.jpg", "1-2.jpg"], ["1. General.pdf", "AIRBAG AB.pdf"]])
def test_natural_order(spark, want):
    assert in_order(spark, list(want)) == want


@pytest.mark.parametrize("name,rank", [
    ("cover.jpg", 0), ("GI-COVER.jpg", 0), ("coverhw.tif", 0), ("DISCOVER.PDF", 3), ("foreword.pdf", 1), ("fwd", 1), ("fwd2.pdf", 3),
        ("GI-FWD.jpg", 3), ("index-BO-1.jpg", 2), ("dtc_index.gif", 2),
    ("Medium_2002-CHEVY-TRUCK-COLUMN-COVER.jpg", 3), ("--.jpg", 3)])
def test_front_matter(spark, name, rank):
    assert one(spark, text.lead_rank(F.lit(name))) == rank


def test_folder_affix_rescues_a_wordy_cover(spark):
    names = [f"PBGE95E1_FOR_EUROPE_CARISMA_96_BRM_{x}.pdf" for x in ("0", "1", "COVER")]
    d = spark.createDataFrame([("f", n) for n in names], "folder string, name string").withColumn("stem", text.base_name(F.col("name")))
    affix = sequences.folder_affixes(d, "folder", "stem")
    assert affix.first().prefix == "PBGE95E1_FOR_EUROPE_CARISMA_96_BRM_"
    out = sequences.natural_order(d.select("folder", "name"), "folder", "name", affix).orderBy("place").collect()
    assert [r.lead for r in out] == [0, 3, 3] and out[0].name.endswith("COVER.pdf")
    single = sequences.folder_affixes(d.limit(1), "folder", "stem").first()
    assert (single.prefix, single.suffix) == ("", "")


def test_names(spark):
    for name, base in (("4.2 ENGINE", "4.2 ENGINE"), ("notes.txt", "notes.txt"), ("a.b.JPG", "a.b"), (".pdf", ".pdf")):
        assert one(spark, text.base_name(F.lit(name))) == base
    assert one(spark, text.norm_line(F.lit("  Straße\t  X "))) == "strasse x"
    assert one(spark, text.doc_id_key(F.lit("see https://x.com/data/DG/2022/06/HTML/N5060302G0000900USA.htm 1/15"))) == "0006/N5060302G0000900USA"
    assert one(spark, text.doc_id_key(F.lit("none"))) is None


def test_scripts(spark):
    assert one(spark, text.text_script(F.lit("привет мир " * 10))) == "Cyrillic"
    assert one(spark, text.text_script(F.lit("日本語のテキスト" * 10))) == "Japanese"
    assert one(spark, text.text_script(F.lit("plain english words " * 10 + "три"))) == ""
    assert one(spark, text.text_script(F.lit("привет"))) == ""


def test_language_packs(spark):
    packs = lambda want, have: one(spark, text.available_packs(F.lit(want), F.array(*map(F.lit, have))))
    have = ["eng", "deu", "rus"]
    assert [packs(p, have) for p in ("kor+eng", "ara", "fra+deu")] == ["eng", "eng", "deu"]
    assert packs("kor", ["spa", "ita"]) == "ita"
    assert one(spark, text.with_packs(F.lit("eng"), F.lit("rus+eng"))) == "eng+rus"


def test_even_samples_round_half_to_even(spark):
    for k in (1, 4, 8, 12):
        got = spark.range(0, 130).select("id", numbers.even_sample(F.col("id"), k).alias("s")).collect()
        for r in got:
            m = min(k, r.id)
            assert r.s == (sorted({round(i * (r.id - 1) / max(1, m - 1)) for i in range(m)}) if r.id else [])


def test_thread_budgets(spark):
    pages = [one(spark, numbers.thread_budget(F.lit(p), F.lit(0), 6)) for p in (2910, 800, 400, 80, 10)]
    sizes = [one(spark, numbers.thread_budget(F.lit(0), F.lit(int(mb * 1048576)), 6)) for mb in (143, 20, 0.9)]
    assert pages == [6, 6, 3, 2, 1] and sizes == [6, 3, 1]
    assert [one(spark, numbers.draining_threads(F.lit(r), 6, 6)) for r in (1, 2, 3, 6)] == [6, 3, 2, 1]


def test_bands_tile_every_page_once(spark):
    for n in (1, 30, 99, 100, 101, 401, 2460):
        for shards in (1, 3, 6):
            bands = spark.createDataFrame([(1, n)], "first long, last long")
            got = sorted((r.first, r.last) for r in sequences.shard_bands(bands, shards).select(F.col("first"),
                F.col("last")).collect()) if False else sorted(tuple(r) for r in sequences.shard_bands(bands, shards).select("first",
                "last").collect())
            assert [p for a, b in got for p in range(a, b + 1)] == list(range(1, n + 1))
            assert len(got) <= shards and (n >= 100 or len(got) == 1)
    windows = sequences.seek_windows(spark.createDataFrame([("a", 2460)], "file string, n_pages long")).orderBy("start").collect()
    assert [(r.start, r.pages) for r in windows] == [(0, 1000), (1000, 1000), (2000, 460)]


def test_strip_resolution_counts_by_width(spark):
    strips = F.array(*[F.struct(F.lit(2550).alias("w"), F.lit(330).alias("h"))] * 10)
    dpi = one(spark, numbers.class_dpi(strips, F.lit(612.0), F.lit(792.0)))
    assert 290 <= dpi <= 310 and one(spark, numbers.render_dpi(F.lit(0.0))) == 200


def test_has_text_needs_most_pages(spark):
    pages = spark.createDataFrame([("a", 0, "x" * 200, "x" * 200)] + [("a", k, "", "") for k in range(1, 5)], "file string, page_no int, text string, net string")
    assert not gates.has_text(pages).first().searchable and gates.has_text(pages, 0.01).first().searchable


def test_boilerplate_is_a_stamp_not_a_template(spark):
    stamp = [("s", k, f"Printed for X\nbody {k}") for k in range(5)] + [("t", k, "\n".join(f"row {j}" for j in range(20))) for k in range(5)] + [("u",
        k, "Printed for X") for k in range(2)]
    pages = spark.createDataFrame(stamp, "file string, page_no int, text string")
    found = gates.boilerplate_lines(pages)
    assert [(r.file, r.line) for r in found.collect()] == [("s", "printed for x")]
    assert {r.net for r in gates.net_text(pages, found).where("file = 's'").collect()} == {f"body {k}" for k in range(5)}


def test_page_identity(spark):
    rows = [("a", "GI-12.jpg", "12", 2550 * 3508, False), ("a", "GI-12.tif", "12", 637 * 877, False), ("a", "x.jpg", "13", 2544 * 3500, False),
        ("a", "x.tif", "13", 2550 * 3508, False),
            ("a", "p.pdf", "14", 10, True), ("a", "p.jpg", "14", 1000, False), ("a", "q.jpg", "15", 0, False), ("a", "q.tif", "15", 500, False),
                ("b", "GI-12.jpg", "12", 5, False)]
    out = sequences.page_identity_groups(spark.createDataFrame(rows, "folder string, name string, key string, area long, is_pdf boolean"))
    assert {r.name: r.fate for r in out.collect()} == {"GI-12.jpg": "keep", "GI-12.tif": "drop", "x.jpg": "keep all", "x.tif": "keep all",
        "p.pdf": "keep all", "p.jpg": "keep all", "q.jpg": "keep all", "q.tif": "keep all"}


def test_bookmarks(spark):
    rows = [("m", k, f"s{k // 2}" if k else None, p) for k, p in enumerate((1, 2, 3, 1, 4))] + [("flat", k, "only", 1) for k in range(3)]
    out = sequences.section_bookmarks(spark.createDataFrame(rows, "folder string, ord long, section string, pages int"))
    assert sorted((r.section, r.page) for r in out.collect()) == [("s0", 2), ("s1", 4), ("s2", 8)]


def test_duplicates_skip_nulls(spark):
    rows = spark.createDataFrame([("a", "h1", 1), ("b", "h1", 2), ("c", "h2", 3), ("d", None, 4), ("e", None, 5)], "file string, h string, seq int")
    assert sorted((r.file, r.duplicate_of) for r in sequences.duplicate_sets(rows, "h", "file").collect()) == [("a", "b"), ("b", "a")]
    assert {r.file: r.duplicate_of for r in sequences.first_seen(rows, "h", "seq", "file").collect()} == {"a": None, "b": "a", "c": None, "d": None, "e": None}


def test_retry_routes(spark):
    entries = spark.createDataFrame([("/a/x.pdf",), ("y.pdf",), ("/other/z.pdf",), ("gone.pdf",)], "entry string")
    catalog = spark.createDataFrame([("/a/x.pdf",), ("/a/y.pdf",), ("/other/z.pdf",)], "path string")
    assert {r.entry: r.route for r in relations.retry_routes(entries, catalog, "/a").collect()} == {"/a/x.pdf": "job", "y.pdf": "job",
        "/other/z.pdf": "foreign", "gone.pdf": "missing"}


def test_reachable_on_a_cycle(spark):
    edges = spark.createDataFrame([(k, (k + 1) % 130) for k in range(130)] + [(500, 501)], "src long, dst long")
    assert relations.reachable(edges, spark.createDataFrame([(3,)], "node long")).count() == 130


def test_reachable_never_returns_a_part(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)], "src long, dst long")
    with pytest.raises(RuntimeError):
        relations.reachable(edges, spark.createDataFrame([(0,)], "node long"), rounds=4)


def test_large_duplicate_set_stays_linear(spark):
    rows = spark.range(3000).select(F.lit("same").alias("h"), F.col("id").alias("file"))
    out = sequences.duplicate_sets(rows, "h", "file", 3).collect()
    assert len(out) == 3000 and {r.copies for r in out} == {3000} and {r["first"] for r in out} == {0}
    assert {r.file: r.duplicate_of for r in out if r.file in (1, 2999)} == {1: "0; 2; 3", 2999: "0; 1; 2"}


def test_notes_and_labels(spark):
    from folia.operators import drivers

    lit = F.lit
    assert one(spark, drivers.repair_note(lit(0), lit(0), lit(-1), lit(5))) == " (repaired malformed PDF)"
    assert one(spark, drivers.repair_note(lit(3), lit(2), lit(90), lit(88))) == " (repaired malformed PDF: 3 duplicate object(s), 2 resolved; objects 90->88)"
    assert one(spark, drivers.pixel_label(lit(2550), lit(3508))) == "2550x3508 (8.9 MP)" and one(spark, drivers.pixel_label(lit(0), lit(0))) == "unreadable"
    assert one(spark, drivers.lossless_note(lit(2 << 20), lit(1 << 20), lit(False))) == " (lossless rewrite: 2.00 -> 1.00 MB (50% smaller))"


def test_report_rows_mask_failures(spark):
    rows = [("a", "compressed", "compressible", "new ocr", "eng", 20 << 20, 4 << 20, None),
        ("b", "compressed", "compressible", "re-ocr", "eng", 10, 5, "broken"), ("c", "x", "", "kept existing", "auto", 0, 0, "")]
    out = {r.file: r for r in report.report_rows(spark.createDataFrame(rows,
        "file string, action string, reason string, ocr string, lang string, orig long, new long, err string")).collect()}
    assert (out["a"].action, out["a"].pct, out["a"].language) == ("compressed", 20, "eng")
    assert (out["b"].action, out["b"].reason, out["b"].ocr, out["b"].language, out["b"].pct) == ("FAILED", "error", "", "", None)
    assert (out["c"].action, out["c"].language, out["c"].pct) == ("processed", "", None)
    tally = report.reason_tally(report.report_rows(spark.createDataFrame([("a", "compressed", "small size", "", "", 3 << 20, 1, ""),
        ("b", "compressed", "small size", "", "", 1 << 20, 1, ""), ("c", "compressed", "small size", "", "", 9, 1, "bad")],
        "file string, action string, reason string, ocr string, lang string, orig long, new long, err string"))).collect()
    assert [(r.files, r.bytes) for r in tally] == [(2, 4 << 20)]


def test_cannot_judge_is_no_pass(spark):
    rows = spark.createDataFrame([("a", 1, 1, True, True), ("b", 1, 2, True, True), ("c", 1, 1, False, True), ("d", None, None, True, True)],
        "rel string, pages_before int, pages_after int, judged_before boolean, judged_after boolean")
    assert {r.rel: r.difference for r in report.fingerprint_difference(rows, ["pages"]).collect()} == {"a": "", "b": "pages", "c": None, "d": ""}
    few = spark.createDataFrame([("r", "w", k % 2 == 0) for k in range(20)], "rel string, word string, before boolean")
    told = relations.word_recall(few, F.col("before")).first()
    assert told.recall is None and told.words_before == 10


def test_inherited_defects(spark):
    bad = spark.createDataFrame([(1, "80 widths for 69 slots"), (2, "x")], "page int, sig string")
    source = spark.createDataFrame([(1, "80 widths for 69 slots")], "page int, sig string")
    assert {r.page: r.inherited for r in relations.inherited(bad, source, ["page"], "sig").collect()} == {1: True, 2: False}


def test_pdf_heads(spark):
    head = lambda b: F.lit(b)
    assert one(spark, text.looks_like_pdf(head(b"\r\n %PDF-1.4"))) and not one(spark, text.looks_like_pdf(head(b"about %PDF-1.4"))) and one(spark,
        text.is_pdf_head(head(b"about %PDF-1.4")))
    raw = lambda b: tuple(one(spark, text.raw_pages(head(b))))
    assert raw(b"garbage") == (0, True) and raw(b"x /ObjStm y") == (0, False) and raw(b"/Type /Pages /Type /Page /Type/Page>> /Type /Page\n") == (3, True)
