"""What pages show, from the tables of objects, pages and operators that a file's bytes give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.numbers import class_dpi
from ..functions.text import norm_line
from ..session import kept
from . import relations

KEY = ["path", "stream"]


def levels(pages: DataFrame, ops: DataFrame, objects: DataFrame, depth: int, covered: bool):
    """The streams of pages, level by level: (path, page_no, at, stream, names) and each one's last image (path, page_no, at, last).

    Level 0 are a page's own; the next are the forms that a level draws, without
    those under a later image unless ``covered``.  ``at`` orders streams as
    they are painted.  A form without names of its own uses those of what draws it.
    """
    kinds = objects.select("path", F.col("num").alias("target"), "subtype", F.col("names").alias("own"))
    draws = ops.where("kind = 'draw'").select(*KEY, "pos", F.col("arg").alias("name"))
    level = pages.where("page_no IS NOT NULL").select("path", "page_no", F.posexplode("contents").alias("part", "stream"), F.col("xobjects").alias("names"))
    level = level.select("path", "page_no", F.array(F.col("part")).alias("at"), "stream", "names")
    for k in range(depth + 1):
        painted = level.join(draws, KEY).withColumn("target", F.try_element_at("names", F.col("name"))).join(kinds, ["path", "target"])
        painted = kept(painted, "painted")
        last = painted.where("subtype = 'Image'").groupBy("path", "page_no", "at").agg(F.max("pos").alias("last"))
        yield level, last
        forms = painted.where("subtype = 'Form'")
        if not forms.take(1):
            return
        if not covered:
            forms = forms.join(last, ["path", "page_no", "at"], "left").where(F.col("pos") >= F.coalesce("last", F.lit(-1)))
        level = forms.select("path", "page_no", F.concat("at", F.array("pos")).alias("at"), F.col("target").alias("stream"), F.coalesce("own", "names").alias("names"))


def page_text(pages: DataFrame, ops: DataFrame, objects: DataFrame, depth: int = vocab.FORM_DEPTH) -> DataFrame:
    """(path, page_no, text): a page's text and that of its forms, as painted, visible or not, one block a line; '' without any."""
    blocks = ops.where("kind = 'block' AND block_text <> ''").select(*KEY, "pos", "block_text")
    found = None
    for level, _ in levels(pages, ops, objects, depth, True):
        told = level.join(blocks, KEY).select("path", "page_no", F.concat("at", F.array("pos")).alias("at"), "block_text")
        found = told if found is None else found.union(told)
    text = found.groupBy("path", "page_no").agg(F.array_sort(F.collect_list(F.struct("at", "block_text"))).alias("blocks"))
    whole = pages.where("page_no IS NOT NULL").select("path", "page_no").join(text, ["path", "page_no"], "left")
    return whole.select("path", "page_no", F.coalesce(F.array_join(F.transform("blocks", lambda b: b.block_text), "\n"), F.lit("")).alias("text"))


def page_images(pages: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, page_no, images, dpi): sizes of the images that a page names, and its largest-image resolution."""
    images = objects.where("subtype = 'Image' AND width IS NOT NULL").select("path", F.col("num").alias("image"),
        F.struct(F.col("width").alias("w"), F.col("height").alias("h")).alias("size"))
    p = pages.where("page_no IS NOT NULL").select("path", "page_no", "width", "height", F.explode_outer(F.map_values("xobjects")).alias("image"))
    sized = p.join(images, ["path", "image"], "left").groupBy("path", "page_no", "width", "height").agg(F.collect_list("size").alias("images"))
    return sized.select("path", "page_no", "images", class_dpi(F.col("images"), F.col("width"), F.col("height")).alias("dpi"))


def judged_shows(ops: DataFrame, boiler: DataFrame | None = None) -> DataFrame:
    """(path, stream, pos, reads): the show operators, and whether each reads on its own.

    The render mode set last before it must not be 3, and the text block that
    holds it must not be a boilerplate line of the file (file, line).
    """
    keyed = ops.withColumn("key", F.struct(*KEY))
    modes = relations.render_mode_asof(keyed.select(F.col("key").alias("stream"), "pos", "kind", "arg"))
    blocks = keyed.where("kind = 'block'").select(F.col("key").alias("stream"), F.col("pos").alias("start"), "stop", "block_text")
    held = relations.shows_in_blocks(modes, blocks.drop("block_text")).join(blocks.select("stream", "start", "block_text"), ["stream", "start"])
    shows = modes.join(held.select("stream", "pos", "block_text"), ["stream", "pos"], "left").select("stream.path", "stream.stream", "pos", "mode",
        norm_line(F.col("block_text")).alias("line"))
    if boiler is None:
        return shows.select(*KEY, "pos", (F.col("mode") != 3).alias("reads"))
    stamps = boiler.select(F.col("file").alias("path"), "line", F.lit(True).alias("stamp")).distinct()
    return shows.join(stamps, ["path", "line"], "left").select(*KEY, "pos", ((F.col("mode") != 3) & F.col("stamp").isNull()).alias("reads"))


def visible_pages(pages: DataFrame, ops: DataFrame, objects: DataFrame, boiler: DataFrame | None = None, depth: int = vocab.FORM_DEPTH) -> DataFrame:
    """(path, page_no, visible): whether a page shows text that a reader sees.

    In a stream text counts if it reads on its own and no image is painted after
    it.  Forms that are painted after the last image are looked into, ``depth``
    levels down.
    """
    shows, found = judged_shows(ops, boiler), None
    for level, last in levels(pages, ops, objects, depth, False):
        after = F.col("pos") >= F.coalesce("last", F.lit(-1))
        seen = level.join(shows, KEY).join(last, ["path", "page_no", "at"], "left").groupBy("path", "page_no").agg(F.max(after & F.col("reads")).alias("visible"))
        found = seen if found is None else found.union(seen)
    told = found.groupBy("path", "page_no").agg(F.max("visible").alias("visible"))
    return pages.where("page_no IS NOT NULL").select("path", "page_no").join(told, ["path", "page_no"], "left").select("path", "page_no",
        F.coalesce("visible", F.lit(False)).alias("visible"))


def sample_record(pages: DataFrame, text: DataFrame, images: DataFrame, boiler: DataFrame, visible: DataFrame, k: int = vocab.SAMPLE_PAGES) -> DataFrame:
    """(file, page_no, text, net, visible, dpi) of an even sample of each file's pages; ``visible`` is the characters that are seen."""
    from .gates import net_text, sampled_pages

    whole = pages.where("page_no IS NOT NULL").select("path", "page_no").join(text, ["path", "page_no"]).withColumnRenamed("path", "file")
    keyed = lambda d: d.withColumnRenamed("path", "file")
    sample = net_text(sampled_pages(whole, k), boiler).join(keyed(images).drop("images"),
        ["file", "page_no"]).join(keyed(visible).withColumnRenamed("visible", "seen"), ["file", "page_no"])
    return sample.select("file", "page_no", "text", "net", F.when(F.col("seen"), F.length("net")).otherwise(0).alias("visible"), "dpi")


def positional_zip(source: DataFrame, result: DataFrame, ocr_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages of a source and its result, side by side by number, and the files whose counts differ.

    Both have (path, page_no, ...).  A file whose counts differ is grafted in no
    part: (path, pages_source, pages_result).  ``ocr_map`` (path, page_no,
    ocr_page) adds the page of the text layer, null where a page has none.
    """
    count = lambda d, name: d.groupBy("path").agg(F.count("page_no").alias(name))
    counts = count(source, "pages_source").join(count(result, "pages_result"), "path", "full").na.fill(0)
    failed = counts.where("pages_source <> pages_result")
    key = ["path", "page_no"]
    side = lambda d, name: d.select(*key, *[F.col(c).alias(f"{c}_{name}") for c in d.columns if c not in key])
    zipped = side(source, "source").join(side(result, "result"), key).join(failed.select("path"), "path", "left_anti")
    return (zipped if ocr_map is None else zipped.join(ocr_map, key, "left")), failed
