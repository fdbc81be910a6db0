"""Orders, runs, windows and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import draining_threads, thread_budget
from ..functions.text import base_name, doc_id_key, lead_rank, page_tokens
from ..operators import sequences
from .base import load, query

TOKENS = """list_concat(CASE WHEN regexp_matches({s}, '^[0-9]') THEN ['0'] ELSE CAST([] AS VARCHAR[]) END, list_transform(regexp_extract_all({s}, '[0-9]+|[^0-9]+'),
  t -> CASE WHEN regexp_matches(t, '^[0-9]') THEN '1' || lpad(CAST(length(regexp_replace(t, '^0+([0-9])', '\\1')) AS VARCHAR), 3, '0') || regexp_replace(t,
   '^0+([0-9])', '\\1') ELSE '0' || replace(t, chr(1), '') END))"""
SQUEEZE = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '([a-z])0', '\\1o', 'g'), '([0-9])[^a-z0-9]+([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9])[^a-z0-9\\x01]+([0-9])', '\\1' || chr(1) || '\\2', 'g'), '[^a-z0-9\\x01]', '', 'g')"""
BASE = "regexp_replace({0}, '(?i)(.)\\.(jpg|jpeg|png|gif|bmp|tif|tiff|webp|pdf)$', '\\1')"
LEAD = """CASE WHEN len(w) = 0 THEN 3 WHEN len(w) = 1 AND w[1] = 'fwd' THEN 1 WHEN (starts_with(w[1], 'cover') OR list_contains(w,
   'cover')) AND a - 5 <= 10 THEN 0 WHEN (starts_with(w[1], 'foreword') OR list_contains(w, 'foreword')) AND a - 8 <= 10 THEN 1
 WHEN (starts_with(w[1], 'title') OR list_contains(w, 'title')) AND a - 5 <= 10 THEN 1 WHEN (starts_with(w[1], 'index') OR list_contains(w,
   'index')) AND a - 5 <= 10 THEN 2 WHEN (starts_with(w[1], 'contents') OR list_contains(w, 'contents')) AND a - 8 <= 10 THEN 2 ELSE 3 END"""


def natural(source: str, folder: str, name: str) -> str:
    """DuckDB SQL of natural_order() over a source of (folder, name)."""
    return f"""WITH n0 AS (SELECT {folder} AS folder, {name} AS name, {BASE.format(name)} AS stem FROM {source}),
 n1 AS (SELECT *, {SQUEEZE.format('stem')} AS s, list_filter(string_split_regex(lower(stem), '[^a-z0-9]+'), x -> x <> '') AS w,
   length(regexp_replace(lower(stem), '[^a-z]', '', 'g')) AS a FROM n0),
 n2 AS (SELECT folder, name, {LEAD} AS lead, {TOKENS.format(s='s')} AS tokens FROM n1)
 SELECT folder, name, lead, row_number() OVER (PARTITION BY folder ORDER BY lead, tokens, lower(name), name) AS place FROM n2"""


@query(natural("pages", "regexp_extract(url, '^https?://([^/]+)', 1)", "regexp_extract(url, '^https?://[^/]+/(.*)$', 1) || '-' || page_id"))
def natural_order_urls(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("folder"), F.concat(F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1), F.lit("-"),
            F.col("page_id")).alias("name"))
    return sequences.natural_order(p, "folder", "name")


PART = """CASE p_partkey % 9 WHEN 0 THEN 'GI-' || p_size || '.jpg' WHEN 1 THEN 'B0' || p_size || '-' || p_partkey || '.TIF'
   WHEN 2 THEN 'cover' || p_partkey || '.png' WHEN 3 THEN p_size || '.2 ' || p_name ELSE p_name || '-' || p_size || '-' || p_partkey || '.pdf' END"""


def _parts(spark, sf_dir):
    key, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    kind = key % 9
    text = (F.when(kind == 0, F.concat(F.lit("GI-"), size, F.lit(".jpg"))).when(kind == 1, F.concat(F.lit("B0"), size, F.lit("-"), key, F.lit(".TIF")))
            .when(kind == 2, F.concat(F.lit("cover"), key, F.lit(".png"))).when(kind == 3,
                F.concat(size, F.lit(".2 "), name)).otherwise(F.concat(name, F.lit("-"), size, F.lit("-"), key, F.lit(".pdf"))))
    return load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("folder"), text.alias("name"), size)


@query(natural(f"(SELECT p_brand, {PART} AS part_name FROM part)", "p_brand", "part_name"))
def natural_order_parts(spark, sf_dir):
    """Names of the shapes that scanned manuals have, one folder a brand; repeated names tie."""
    return sequences.natural_order(_parts(spark, sf_dir).select("folder", "name"), "folder", "name")


@query(f"""WITH n AS (SELECT p_partkey, {PART} AS name FROM part) SELECT p_partkey, {BASE.format('name')} AS stem, lower(nullif(regexp_extract(name,
   '(?i).\\.(jpg|jpeg|png|gif|bmp|tif|tiff|webp|pdf)$', 1), '')) AS extension FROM n""")
def page_base_names(spark, sf_dir):
    from ..functions.text import page_extension

    return _parts(spark, sf_dir).select("p_partkey", base_name(F.col("name")).alias("stem"), F.nullif(page_extension(F.col("name")), F.lit("")).alias("extension"))


NAMES = [("cover.jpg",), ("GI-COVER.jpg",), ("DISCOVER.PDF",), ("coverhw.tif",), ("foreword.pdf",), ("FW Foreword.pdf",), ("fwd.pdf",), ("fwd2.pdf",),
    ("GI-FWD.jpg",), ("index.tif",), ("index-BO-1.jpg",), ("dtc_index.gif",), ("contents.pdf",), ("Medium_2002-CHEVY-TRUCK-COLUMN-COVER.jpg",),
    ("title page.png",), ("EM-2.jpg",), ("4.2 ENGINE",), ("--.jpg",)]
FRONT = ", ".join(f"('{n}')" for (n,) in NAMES)


@query(f"""WITH v AS (SELECT name, {BASE.format('name')} AS stem FROM (VALUES {FRONT}) t(name) UNION ALL SELECT {PART}, {BASE.format('(' + PART + ')')} FROM part),
 x AS (SELECT name, list_filter(string_split_regex(lower(stem), '[^a-z0-9]+'), x -> x <> '') AS w, length(regexp_replace(lower(stem), '[^a-z]', '', 'g')) AS a
   FROM v) SELECT name, {LEAD} AS lead FROM x""")
def front_matter_rank(spark, sf_dir):
    names = spark.createDataFrame(NAMES, "name string").union(_parts(spark, sf_dir).select("name"))
    return names.select("name", lead_rank(F.col("name")).alias("lead"))


@query("""WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS folder, regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS stem FROM pages),
 m AS (SELECT folder, count(*) AS n, min(stem) AS a, max(stem) AS b, min(reverse(stem)) AS c, max(reverse(stem)) AS d FROM p GROUP BY folder),
 q AS (SELECT folder, n, left(a, list_max(list_filter(range(0, least(length(a), length(b)) + 1), i -> left(a, i) = left(b, i)))) AS pre, left(c,
   list_max(list_filter(range(0, least(length(c), length(d)) + 1), i -> left(c, i) = left(d, i)))) AS suf FROM m)
 SELECT folder, CASE WHEN n > 1 THEN regexp_extract(pre, '(?s)^(.*[^A-Za-z0-9])', 1) ELSE '' END AS prefix, CASE
   WHEN n > 1 THEN reverse(regexp_extract(suf, '(?s)^(.*[^A-Za-z0-9])', 1)) ELSE '' END AS suffix FROM q""")
def folder_affix(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("folder"),
        F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1).alias("stem"))
    return sequences.folder_affixes(p, "folder", "stem")


HEADER = """CASE WHEN page_id % 3 = 0 AND regexp_extract(url, '^https?://([^/]+)', 1) LIKE 'm.%' THEN url
   ELSE 'https://docs.example/data/2022/' || page_id % 17 || '/HTML/N' || (page_id * 7919) % 1000 || '.htm 1/2' END"""


@query(f"""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS folder, {HEADER} AS header FROM pages),
 k AS (SELECT *, regexp_extract(header, '(?i)https?://\\S*?/([0-9]{{4}})/([0-9]+)/HTML/([A-Za-z0-9]+)\\.htm', 2) AS g, regexp_extract(header,
   '(?i)https?://\\S*?/([0-9]{{4}})/([0-9]+)/HTML/([A-Za-z0-9]+)\\.htm', 3) AS i FROM h),
 d AS (SELECT page_id, folder, CASE WHEN i <> '' THEN (CASE WHEN length(g) < 4 THEN lpad(g, 4, '0') ELSE g END) || '/' || i END AS doc_key FROM k),
 w AS (SELECT *, count(doc_key) OVER (PARTITION BY folder) = count(*) OVER (PARTITION BY folder) AS by_doc_id FROM d)
 SELECT page_id, folder, doc_key, by_doc_id, row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN by_doc_id THEN doc_key END NULLS FIRST, page_id) AS place FROM w""")
def docid_order(spark, sf_dir):
    """Publisher's order from print headers; mobile hosts lack some of them and keep their order."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    header = F.when((F.col("page_id") % 3 == 0) & host.startswith("m."), F.col("url")).otherwise(
        F.concat(F.lit("https://docs.example/data/2022/"), F.col("page_id") % 17, F.lit("/HTML/N"), (F.col("page_id") * 7919) % 1000, F.lit(".htm 1/2")))
    p = load(spark, sf_dir, "pages").select("page_id", host.alias("folder"), doc_id_key(header).alias("doc_key"),
        F.lpad(F.col("page_id").cast("string"), 12, "0").alias("name"))
    return sequences.order_by_doc_id(p, "folder", "doc_key", "name").select("page_id", "folder", "doc_key", "by_doc_id", "place")


@query("""WITH p AS (SELECT p_partkey, p_brand AS folder, p_type AS k, CASE WHEN p_partkey % 13 = 0 THEN 0
   ELSE p_size * p_size END AS area, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS name, p_partkey % 29 = 0 AS is_pdf FROM part),
 b AS (SELECT folder, k, max(struct_pack(area := area, name := name)) AS best, bool_or(is_pdf) AS pdf FROM p GROUP BY folder, k HAVING count(*) > 1),
 m AS (SELECT p.*, best, pdf FROM p JOIN b USING (folder, k)), c AS (SELECT folder, k,
   bool_and(name = best.name OR (area > 0 AND best.area >= 2 * area)) AS clear FROM m GROUP BY folder, k)
 SELECT folder, k AS key, name, CASE WHEN pdf OR NOT clear THEN 'keep all' WHEN name <> best.name THEN 'drop' ELSE 'keep' END AS fate FROM m JOIN c USING (folder, k)""")
def page_identity_dedupe(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("folder"), F.col("p_type").alias("key"), F.when(F.col("p_partkey") % 13 == 0,
            0).otherwise(F.col("p_size") * F.col("p_size")).alias("area"),
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("name"), (F.col("p_partkey") % 29 == 0).alias("is_pdf"))
    return sequences.page_identity_groups(p)


RUNS = """r0 AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag) AS page, l_returnflag AS dpi
   FROM lineitem), r1 AS (SELECT *, CASE WHEN lag(dpi) OVER w = dpi THEN 0 ELSE 1 END AS t FROM r0 WINDOW w AS (PARTITION BY l_suppkey
   ORDER BY page)), r2 AS (SELECT *, sum(t) OVER (PARTITION BY l_suppkey ORDER BY page ROWS UNBOUNDED PRECEDING) AS run
   FROM r1), bands AS (SELECT l_suppkey, min(page) AS first, max(page) AS last, any_value(dpi) AS dpi FROM r2 GROUP BY l_suppkey, run)"""


def _numbered(spark, sf_dir):
    """Order lines as the pages of one document a supplier."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_returnflag"))
    return load(spark, sf_dir, "lineitem").select("l_suppkey", n.cast("long").alias("page"), F.col("l_returnflag").alias("dpi"))


@query(f"WITH {RUNS} SELECT l_suppkey, first, last, dpi FROM bands")
def equal_run_bands(spark, sf_dir):
    return sequences.equal_runs(_numbered(spark, sf_dir), "l_suppkey", "page", "dpi")


@query("""WITH b AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), k AS (SELECT *, greatest(1, least(6, n // 50)) AS k
   FROM b), s AS (SELECT l_suppkey, n, CAST(ceil(n / k) AS BIGINT) AS step FROM k)
 SELECT l_suppkey, first, least(first + step - 1, n) AS last FROM (SELECT l_suppkey, n, step, unnest(range(1, n + 1, step)) AS first FROM s)""")
def shard_bands(spark, sf_dir):
    b = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("last")).withColumn("first", F.lit(1).cast("long"))
    return sequences.shard_bands(b, 6).select("l_suppkey", "first", "last")


@query("SELECT file, start, least(1000, n - start) AS pages FROM (SELECT l_suppkey AS file, count(*) AS n, unnest(range(0, count(*), 1000)) AS start FROM lineitem GROUP BY l_suppkey)")
def seek_windows(spark, sf_dir):
    return sequences.seek_windows(load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(F.count("*").alias("n_pages")))


@query("""WITH e AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS bitonal FROM events), t AS (SELECT *, CASE
   WHEN bitonal AND coalesce(lag(bitonal) OVER (PARTITION BY user_id ORDER BY event_id), false) THEN 0 ELSE 1 END AS t FROM e),
 r AS (SELECT *, sum(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM t)
   SELECT user_id, min(event_id) AS first, max(event_id) AS last, any_value(bitonal) AS bitonal FROM r GROUP BY user_id, run""")
def bitonal_runs(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").isin("view", "click").alias("bitonal"))
    return sequences.segments(e, "user_id", "event_id", "bitonal")


@query("""WITH o AS (SELECT o_orderstatus AS grp, o_orderkey AS seq, CAST(o_totalprice AS BIGINT) AS bytes
   FROM orders), t AS (SELECT grp, sum(bytes) AS total, count(*) AS n FROM o GROUP BY grp),
 r AS (SELECT o.*, CAST(total AS BIGINT) AS total, n, CAST(sum(bytes) OVER w AS BIGINT) AS done, count(*) OVER w AS i FROM o
   JOIN t USING (grp) WINDOW w AS (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 e AS (SELECT grp, seq, CASE WHEN i < n AND done > 0 AND total > done THEN (total - done) * (i * 2.5::DOUBLE / done)
   WHEN i < n THEN (n - i) * (i * 2.5::DOUBLE / i) ELSE 0.0 END AS eta FROM r) SELECT grp, seq, round_even(eta * 1000, 0) AS eta_ms, eta >= 30 AS shown FROM e""")
def eta_series(spark, sf_dir):
    """Orders as files of a batch a status, one finished each 2.5 seconds."""
    from pyspark.sql import Window as W

    o = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("seq"), F.bround("o_totalprice").cast("long").alias("bytes"))
    t = o.groupBy("grp").agg(F.sum("bytes").alias("total_bytes"), F.count("*").alias("n_files"))
    w = W.partitionBy("grp").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = o.join(t, "grp").withColumn("elapsed", F.count("*").over(w) * F.lit(2.5))
    return sequences.eta(rows, "grp", "seq").select("grp", "seq", F.bround(F.col("eta") * 1000).alias("eta_ms"), "shown")


@query("""WITH d AS (SELECT lang AS folder, doc_id AS ord, CASE WHEN doc_id % 10 <> 0 THEN source END AS section, doc_id % 7 AS pages
   FROM documents), p AS (SELECT *, coalesce(sum(pages) OVER (PARTITION BY folder ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS page
   FROM d),
 f AS (SELECT folder, section, CAST(min_by(page, ord) AS BIGINT) AS page FROM p WHERE section IS NOT NULL GROUP BY folder, section) SELECT * FROM f
   WHERE folder IN (SELECT folder FROM f GROUP BY folder HAVING count(*) > 1)""")
def section_bookmarks(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("lang").alias("folder"), F.col("doc_id").alias("ord"),
        F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("section"), (F.col("doc_id") % 7).alias("pages"))
    return sequences.section_bookmarks(d)


@query("SELECT source, doc_id, CAST(1 + coalesce(sum(doc_id % 7) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page FROM documents")
def running_page_numbers(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    return load(spark, sf_dir, "documents").select("source", "doc_id", (1 + F.coalesce(F.sum(F.col("doc_id") % 7).over(w), F.lit(0))).cast("long").alias("page"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn, max(n_chars)
   OVER (PARTITION BY source) AS top FROM documents) SELECT source, doc_id, n_chars, turn FROM r ORDER BY turn, top DESC, source LIMIT 50""")
def round_robin_spread(spark, sf_dir):
    """A spread sample of 50; the number is what is asked for."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sequences.round_robin(d, "source", "n_chars", "doc_id", 50).select("source", "doc_id", "n_chars", F.col("turn").cast("long").alias("turn"))


@query("""SELECT o_orderkey, CASE WHEN p >= 800 THEN 6 WHEN p >= 200 THEN 3 WHEN p >= 50 THEN 2 WHEN p > 0 THEN 1 WHEN b / 1048576.0 >= 50 THEN 6
   WHEN b / 1048576.0 >= 10 THEN 3 WHEN b / 1048576.0 >= 2 THEN 2 ELSE 1 END AS deserved, greatest(1, 6 // greatest(1, least(6, o_orderkey % 9))) AS draining
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 1200 END AS p, CAST(o_totalprice AS BIGINT) * 200 AS b FROM orders)""")
def thread_budgets(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 1200).alias("p"),
        (F.bround("o_totalprice").cast("long") * 200).alias("b"))
    return o.select("o_orderkey", thread_budget(F.col("p"), F.col("b"), 6).alias("deserved"),
        draining_threads(F.col("o_orderkey") % 9, 6, 6).cast("long").alias("draining"))


@query("SELECT doc_id, bytes, row_number() OVER (ORDER BY bytes DESC, doc_id) AS place FROM (SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents) ORDER BY bytes DESC, doc_id LIMIT 25")
def biggest_first(spark, sf_dir):
    """The 25 biggest files, the number that the report lists."""
    from pyspark.sql import Window as W

    top = load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).orderBy(F.desc("bytes"), "doc_id").limit(25)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("bytes"), "doc_id")).cast("long"))


@query("SELECT source, doc_id, n_chars FROM (SELECT * FROM documents ORDER BY source, doc_id LIMIT 100) ORDER BY n_chars DESC")
def limit_before_sort(spark, sf_dir):
    """A limit on path order, then the biggest first: the order of the two matters."""
    return load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").orderBy("source", "doc_id").limit(100).orderBy(F.desc("n_chars"), "doc_id")
