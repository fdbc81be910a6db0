"""Joins and multisets: copies of documents stand for what a run wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import relations, sequences
from .base import load, numbered, query


@query("""SELECT doc_id AS rel, octet_length(encode(text)) AS bytes_before, quality * 10 + toxic AS bytes_after FROM documents JOIN labels USING (doc_id)""")
def before_after_pairs(spark, sf_dir):
    """Documents as sources and labels as outputs: either table has rows that the other lacks."""
    before = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel"), F.octet_length("text").cast("long").alias("bytes"))
    after = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("rel"), (F.col("quality") * 10 + F.col("toxic")).alias("bytes"))
    return relations.before_after(before, after).select("rel", "bytes_before", "bytes_after")


@query("SELECT doc_id, source, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark, sf_dir):
    return relations.still_to_do(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "n_chars")


@query("""WITH e AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN '/archive/' || doc_id WHEN 1 THEN '/elsewhere/' || doc_id WHEN 2 THEN CAST(doc_id AS VARCHAR)
   ELSE 'x' || doc_id END AS entry FROM labels),
 s AS (SELECT entry, CASE WHEN entry LIKE '/%' THEN entry ELSE '/archive/' || entry END AS src FROM e)
 SELECT entry, src, CASE WHEN entry LIKE '/%' AND entry NOT LIKE '/archive/%' THEN 'foreign' WHEN d.doc_id IS NULL THEN 'missing' ELSE 'job' END AS route FROM s
   LEFT JOIN documents d ON s.src = '/archive/' || d.doc_id""")
def retry_routing(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    entry = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/archive/"), number)).when(F.col("doc_id") % 4 == 1,
        F.concat(F.lit("/elsewhere/"), number)).when(F.col("doc_id") % 4 == 2, number).otherwise(F.concat(F.lit("x"), number))
    catalog = load(spark, sf_dir, "documents").select(F.concat(F.lit("/archive/"), number).alias("path"))
    return relations.retry_routes(load(spark, sf_dir, "labels").select(entry.alias("entry")), catalog, "/archive")


@query("""WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS word FROM documents),
 a AS (SELECT source, word, count(*) AS n FROM w WHERE doc_id % 2 = 0 GROUP BY ALL), b AS (SELECT source, word, count(*) AS n FROM w WHERE doc_id % 2 = 1 GROUP BY ALL)
 SELECT source, word, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS lost, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS added FROM a FULL
   JOIN b USING (source, word) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def multiset_difference(spark, sf_dir):
    w = load(spark, sf_dir, "documents").select("doc_id", "source", F.explode(words(F.col("text"))).alias("word"))
    return relations.multiset_difference(w, ["source", "word"], F.col("doc_id") % 2 == 0)


@query("""WITH d AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k
   FROM documents), w AS (SELECT source AS rel, k % 2 AS side, unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS word FROM d),
 b AS (SELECT rel, word, count(*) AS nb FROM w WHERE side = 1 GROUP BY ALL), a AS (SELECT rel, word, count(*) AS na FROM w WHERE side = 0 GROUP BY ALL)
 SELECT rel, CAST(sum(nb) AS BIGINT) AS words_before, CASE WHEN sum(nb) >= 50 THEN CAST(sum(least(nb, coalesce(na,
   0))) AS BIGINT) / CAST(sum(nb) AS BIGINT) END AS recall FROM b LEFT JOIN a USING (rel, word) GROUP BY rel""")
def word_recall(spark, sf_dir):
    """How much of the words of each source's odd documents its even ones hold."""
    d = numbered(load(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id")).join(load(spark, sf_dir,
        "documents").select("doc_id", "text"), "doc_id")
    w = d.select(F.col("file").alias("rel"), (F.col("page_no") % 2 == 0).alias("first"), F.explode(words(F.col("text"))).alias("word"))
    return relations.word_recall(w, F.col("first"))


@query("""WITH d AS (SELECT l_orderkey, l_returnflag || l_linestatus AS sig, l_linenumber % 2 AS side FROM lineitem)
 SELECT a.l_orderkey, count(*) AS n_defects, bool_and(b.sig IS NOT NULL) AS inherited FROM (SELECT * FROM d WHERE side = 0) a LEFT
   JOIN (SELECT DISTINCT l_orderkey, sig FROM d WHERE side = 1) b ON a.l_orderkey = b.l_orderkey AND a.sig = b.sig GROUP BY a.l_orderkey""")
def inherited_defects(spark, sf_dir):
    """Flags of an order's even lines, forgiven if its odd lines have them."""
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("sig"), (F.col("l_linenumber") % 2).alias("side"))
    return relations.inherited(d.where("side = 0"), d.where("side = 1"), ["l_orderkey"], "sig")


@query("""WITH RECURSIVE e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
   UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
   UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
 t(node) AS (SELECT 'r0' UNION SELECT dst FROM t JOIN e ON t.node = e.src) SELECT node FROM t""")
def reachable_nodes(spark, sf_dir):
    """What one region reaches over nations, customers and orders; edges back make cycles."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c))
    o, c, n = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    edges = (o.select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst")).union(o.select(key("o", "o_orderkey"), key("c", "o_custkey")))
             .union(c.select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(n.select(key("r", "n_regionkey"),
                 key("n", "n_nationkey"))).union(n.select(key("n", "n_nationkey"), key("r", "n_regionkey"))))
    return relations.reachable(edges, spark.createDataFrame([("r0",)], "node string")).select("node")


OPS = """ops AS (SELECT user_id AS stream, event_id AS pos, CASE WHEN event_id % 5 = 0 THEN 'mode' WHEN event_id % 17 = 0 THEN 'image'
   ELSE 'show' END AS kind, CAST(event_id % 4 AS VARCHAR) AS arg FROM events)"""


def _ops(spark, sf_dir):
    """Events as the operators of one content stream a user."""
    kind = F.when(F.col("event_id") % 5 == 0, "mode").when(F.col("event_id") % 17 == 0, "image").otherwise("show")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("pos"), kind.alias("kind"),
        (F.col("event_id") % 4).cast("string").alias("arg"))


@query(f"""WITH {OPS} SELECT s.stream, s.pos, coalesce(CAST(m.arg AS INT), 0) AS mode FROM (SELECT * FROM ops WHERE kind = 'show') s ASOF LEFT JOIN (SELECT *
   FROM ops WHERE kind = 'mode') m ON s.stream = m.stream AND s.pos > m.pos""")
def render_mode_asof(spark, sf_dir):
    return relations.render_mode_asof(_ops(spark, sf_dir))


@query(f"""WITH {OPS} SELECT s.stream, s.pos, b.start, b.stop FROM (SELECT * FROM ops WHERE kind = 'show') s JOIN (SELECT stream, pos AS start, pos + 40 AS stop
   FROM ops WHERE kind = 'image') b ON s.stream = b.stream AND b.start <= s.pos AND s.pos < b.stop""")
def block_containment(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return relations.shows_in_blocks(ops.where("kind = 'show'"), ops.where("kind = 'image'").select("stream", F.col("pos").alias("start"),
        (F.col("pos") + 40).alias("stop")))


@query(f"""WITH {OPS}, l AS (SELECT *, max(CASE WHEN kind = 'image' THEN pos END) OVER (PARTITION BY stream) AS last_image FROM ops)
   SELECT stream, pos, coalesce(pos < last_image, false) AS hidden FROM l WHERE kind = 'show'""")
def covered_by_last(spark, sf_dir):
    return relations.covered_by_last_image(_ops(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, sha1(text) AS h FROM documents), g AS (SELECT h, min(doc_id) AS first, count(*) AS copies,
   list_sort(list(doc_id))[1 : 3] AS ids FROM d GROUP BY h HAVING count(*) > 1)
 SELECT h AS sha1, d.doc_id, first, copies, array_to_string(list_filter(ids, x -> x <> d.doc_id)[1 : 2], '; ') AS duplicate_of FROM g JOIN d USING (h)""")
def exact_duplicates(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return sequences.duplicate_sets(d, "sha1", "doc_id", 2)


@query("SELECT doc_id, CASE WHEN f <> doc_id THEN f END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(text)) AS f FROM documents)")
def first_seen_duplicate(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
    return sequences.first_seen(d, "sha1", "seq", "doc_id").select("doc_id", "duplicate_of")


@query("""SELECT p.p_partkey, g.k, g.d, CASE WHEN p.p_size < 25 THEN g.k * p.p_size ELSE g.d * p.p_size END AS size FROM part p, (VALUES (1, 2), (2, 3), (3, 5)) g(k, d)""")
def settings_grid(spark, sf_dir):
    """Every part under every setting of a fixed grid of three, exploded in place."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in ((1, 2), (2, 3), (3, 5))])
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", F.inline(grid))
    return p.select("p_partkey", "k", "d", F.when(F.col("p_size") < 25, F.col("k") * F.col("p_size")).otherwise(F.col("d") * F.col("p_size")).alias("size"))


@query("""SELECT p_partkey, min_by(k, size) AS smallest, max_by(k, size) AS largest FROM (SELECT p_partkey, k, CASE
   WHEN p_size < 25 THEN (k * 37) % (p_size + 3) ELSE (k * 53) % (p_size + 5) END * 10 + k AS size FROM part, (VALUES (1), (2), (3)) g(k)) GROUP BY p_partkey""")
def matrix_extremes(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    size = F.when(F.col("p_size") < 25, (F.col("k") * 37) % (F.col("p_size") + 3)).otherwise((F.col("k") * 53) % (F.col("p_size") + 5)) * 10 + F.col("k")
    return p.withColumn("size", size).groupBy("p_partkey").agg(F.min_by("k", "size").alias("smallest"), F.max_by("k", "size").alias("largest"))
