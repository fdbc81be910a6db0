"""Text and name functions, all built from native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

EXTENSION = r"(?i)(?<=.)\.(" + "|".join(vocab.PAGE_EXTENSIONS) + ")$"


def norm_line(line: Column) -> Column:
    """White space collapsed, trimmed, case folded (sharp s becomes ss)."""
    return F.replace(F.lower(F.trim(F.regexp_replace(line, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def words(text: Column) -> Column:
    """Runs of three letters or more, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}{3,})"), F.lit(1))


def base_name(name: Column) -> Column:
    """A name without a known page extension; any other dot stays."""
    return F.regexp_replace(name, EXTENSION, "")


def page_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, EXTENSION, 1))


def page_tokens(name: Column) -> Column:
    """The order of page names as an array of strings.

    A 0 after a letter is an o; separators count only between digits.  Text is
    '0' and the text, a number '1', its length and its digits, so arrays compare
    as pages do.
    """
    s = F.lower(base_name(name))
    s = F.regexp_replace(s, "(?<=[a-z])0", "o")
    s = F.regexp_replace(s, r"(?<=\d)[^a-z0-9]+(?=\d)", "\u0001")
    s = F.regexp_replace(s, "[^a-z0-9\u0001]", "")
    parts = F.regexp_extract_all(s, F.lit(r"(\d+|[^\d]+)"), F.lit(1))

    def token(t: Column) -> Column:
        digits = F.regexp_replace(t, r"^0+(?=\d)", "")
        number = F.concat(F.lit("1"), F.lpad(F.length(digits).cast("string"), 3, "0"), digits)
        return F.when(t.rlike(r"^\d"), number).otherwise(F.concat(F.lit("0"), F.replace(t, F.lit("\u0001"), F.lit(""))))

    front = F.when(s.rlike(r"^\d"), F.array(F.lit("0"))).otherwise(F.array().cast("array<string>"))
    return F.concat(front, F.transform(parts, token))


def stem_rank(stem: Column) -> Column:
    """0 cover, 1 foreword, 2 index, 3 any other page, by the words of a stem."""
    found = F.filter(F.split(F.lower(stem), "[^a-z0-9]+"), lambda w: w != "")
    first = F.get(found, F.lit(0))
    letters = F.length(F.regexp_replace(F.lower(stem), "[^a-z]", ""))
    rank = F.when(F.size(found) == 0, 3)
    for bare, r in vocab.LEAD_BARE.items():
        rank = rank.when((F.size(found) == 1) & (first == bare), r)
    for r, keys in vocab.LEAD_WORDS:
        for k in keys:
            rank = rank.when((first.startswith(k) | F.array_contains(found, k)) & (letters - len(k) <= vocab.LEAD_SPARE_LETTERS), r)
    return rank.otherwise(3)


def lead_rank(name: Column, prefix: Column | None = None, suffix: Column | None = None) -> Column:
    """stem_rank, with a second chance for what the folder's names do not share."""
    stem = base_name(name)
    rank = stem_rank(stem)
    if prefix is None or suffix is None:
        return rank
    rest = F.when((prefix != "") & F.startswith(stem, prefix), F.substr(stem, F.length(prefix) + 1)).otherwise(stem)
    rest = F.when((suffix != "") & (F.length(rest) > F.length(suffix)) & F.endswith(rest, suffix), F.left(rest, F.length(rest) - F.length(suffix))).otherwise(rest)
    again = F.when((F.trim(rest) != "") & ((prefix != "") | (suffix != "")), stem_rank(rest)).otherwise(3)
    return F.when(rank < 3, rank).otherwise(again)


def common_prefix(a: Column, b: Column) -> Column:
    most = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), most), lambda i: F.left(a, i) == F.left(b, i))
    return F.left(a, F.array_max(same))


def to_separator(text: Column) -> Column:
    """The text up to its last character that is no letter or digit, itself included."""
    return F.regexp_extract(text, "(?s)^(.*[^A-Za-z0-9])", 1)


DOC_ID = r"(?i)https?://\S*?/(\d{4})/(\d+)/HTML/([A-Za-z0-9]+)\.htm"


def doc_id_key(header: Column) -> Column:
    """Publisher's group (four digits at least) and document id from a print header; null without one."""
    group, ident = F.regexp_extract(header, DOC_ID, 2), F.regexp_extract(header, DOC_ID, 3)
    padded = F.when(F.length(group) < 4, F.lpad(group, 4, "0")).otherwise(group)
    return F.when(ident != "", F.concat(padded, F.lit("/"), ident))


def text_script(text: Column) -> Column:
    """A script other than Latin with its share of a text's letters, or ''."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    out = F.when(letters < vocab.SCRIPT_LETTERS, "")
    for name, chars in vocab.SCRIPT_CLASSES:
        out = out.when(F.regexp_count(text, F.lit(chars)) / letters >= vocab.SCRIPT_SHARE, name)
    return out.otherwise("")


def available_packs(packs: Column, installed: Column) -> Column:
    """Language packs that are installed; else eng, else the first installed one."""
    keep = F.filter(F.split(packs, r"\+"), lambda p: F.array_contains(installed, p))
    fallback = F.when(F.array_contains(installed, "eng"), "eng").otherwise(F.get(F.array_sort(installed), F.lit(0)))
    return F.when(F.size(installed) == 0, packs).when(F.size(keep) > 0, F.array_join(keep, "+")).otherwise(fallback)


def with_packs(have: Column, want: Column) -> Column:
    """Packs asked for, then those of ``want`` that are missing, in order."""
    a, b = F.split(have, r"\+"), F.split(want, r"\+")
    return F.array_join(F.array_distinct(F.concat(a, F.array_except(b, a))), "+")


def is_pdf_head(head: Column) -> Column:
    """%PDF- anywhere in the first KiB."""
    return F.locate("%PDF-", F.decode(F.substring(head, 1, 1024), "ISO-8859-1")) > 0


def looks_like_pdf(head: Column) -> Column:
    """%PDF first, after white space only."""
    return F.decode(F.substring(head, 1, 1024), "ISO-8859-1").rlike(r"^[\r\n \t\x00]*%PDF")


def raw_pages(content: Column) -> Column:
    """Page objects seen in a file's bytes, and whether that count can be trusted."""
    raw = F.decode(content, "ISO-8859-1")
    n = F.regexp_count(raw, F.lit(r"/Type\s*/Page(?![s/\w])"))
    return F.struct(n.alias("pages"), ((n > 0) | ~F.contains(raw, F.lit("/ObjStm"))).alias("trusted"))


def is_xmp(head: Column) -> Column:
    return head.rlike(r"<\?xpacket|<x:xmpmeta|<rdf:RDF")
