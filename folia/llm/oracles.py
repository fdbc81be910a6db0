"""DuckDB SQL for the operators that SQL can express, by the plainest way."""

COMPONENTS = """comp(id, root) AS (SELECT id, id FROM nodes UNION SELECT p.b, c.root FROM comp c JOIN pairs p ON c.id = p.a WHERE c.root < p.b)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 s AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
 nodes AS (SELECT vec_id AS id FROM v), {COMPONENTS},
 r AS (SELECT id, min(root) AS root FROM comp GROUP BY id), k AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, r.root AS component_id, v.vec_id = r.root AS kept FROM v JOIN r ON v.vec_id = r.id LEFT JOIN k ON k.a = v.vec_id
"""

DOCUMENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), often AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1), shared AS (SELECT sh.* FROM sh SEMI JOIN often USING (s)),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shared a JOIN shared b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), pairs AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 nodes AS (SELECT doc_id AS id FROM documents), {COMPONENTS}, r AS (SELECT id, min(root) AS root FROM comp GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: Texts as hexadecimal digits, two a byte, so that windows and cuts are by bytes.
REPEATS = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, h, length(h) // 2 AS n FROM h),
 w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM b WHERE n >= 100)),
 late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
 t AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS t FROM late),
 g AS (SELECT doc_id, p, sum(t) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM t),
 spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, g),
 cuts AS (SELECT doc_id, list(struct_pack(a := a, z := z) ORDER BY a) AS c FROM spans GROUP BY doc_id),
 k AS (SELECT b.doc_id, n, h, coalesce(c, []) AS c FROM b LEFT JOIN cuts USING (doc_id)),
 parts AS (SELECT doc_id, n, c, array_to_string(list_transform(range(0, len(c) + 1), lambda i: substr(h, 2 * CASE WHEN i = 0 THEN 0 ELSE c[i].z END + 1, 2 * (CASE WHEN i = len(c) THEN n ELSE c[i + 1].a END - CASE WHEN i = 0 THEN 0 ELSE c[i].z END))), '') AS kept FROM k)
SELECT doc_id, n AS n_bytes, CAST(coalesce(list_sum(list_transform(c, lambda x: x.z - x.a)), 0) AS BIGINT) AS n_removed, CAST(len(c) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM parts
"""


def _scrambled(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 12) AS BIGINT)"


def _network(y: str) -> str:
    """Four rounds over (left, right), each a struct in a list of one, which binds it."""
    step = f"[struct_pack(l := {y} // cs, r := {y} % cs)]"
    for k in (1, 2, 3, 4):
        salt = _scrambled("rank", "turn", str(k), "q.r" if k % 2 else "q.l")
        change = f"struct_pack(l := (q.l + {salt} % rs) % rs, r := q.r)" if k % 2 else f"struct_pack(l := q.l, r := (q.r + {salt} % cs) % cs)"
        step = f"list_transform({step}, lambda q: {change})"
    return f"list_transform({step}, lambda q: q.l * cs + q.r)[1]"


MIXING = f"""
WITH d AS (SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS sk, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, {_scrambled('doc_id')} % 1024 AS spread FROM documents),
 parts AS (SELECT sn, sk, spread, CAST(sum(size) AS BIGINT) AS part FROM d GROUP BY ALL), s0 AS (SELECT sn, sk, CAST(sum(part) AS BIGINT) AS source_size FROM parts GROUP BY ALL),
 s1 AS (SELECT *, row_number() OVER (ORDER BY sn, sk) AS rank, (row_number() OVER (ORDER BY sn, sk) - 1) % 3 + 1 AS weight FROM s0),
 s2 AS (SELECT *, source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_,
   CAST(sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights FROM s1),
 s3 AS (SELECT *, CAST(cap AS DOUBLE) * weights <= CAST(left_ AS DOUBLE) * weight AS full_ FROM s2),
 f AS (SELECT left_ AS fl, weights AS fw FROM s3 WHERE NOT full_ ORDER BY source_size / weight, rank LIMIT 1),
 s4 AS (SELECT s3.*, CASE WHEN full_ THEN CAST(cap AS DOUBLE) ELSE CAST(fl * weight AS DOUBLE) / fw END AS target, CAST(ceil(source_size / 64) AS BIGINT) AS blocks FROM s3 LEFT JOIN f ON true),
 s AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target * blocks / source_size + 0.5::DOUBLE) AS BIGINT), blocks * 3) ELSE 0 END AS slots FROM s4),
 j AS (SELECT rank, blocks AS n, slot, slot // blocks AS turn, slot % blocks AS y, CAST(ceil(sqrt(CAST(blocks AS DOUBLE))) AS BIGINT) AS rs FROM (SELECT rank, blocks, unnest(range(0, slots)) AS slot FROM s WHERE slots > 0)),
 k AS (SELECT *, CAST(ceil(n / rs) AS BIGINT) AS cs FROM j), y0 AS (SELECT * EXCLUDE (y), {_network("y")} AS y FROM k),
 {{walk}}
 shards AS (SELECT greatest(1, CAST(ceil(sum(slots) / 16384) AS BIGINT)) AS shards FROM s),
 balls AS (SELECT rank, {_scrambled("0", "rank", "ball")} % shards AS shard FROM (SELECT rank, unnest(range(0, slots)) AS ball FROM s WHERE slots > 0), shards),
 ranges AS (SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY shard) - 1 AS slot FROM balls),
 times AS (SELECT rank, y AS blk, count(*) AS times, min(shard) AS shard FROM y{{last}} JOIN ranges USING (rank, slot) GROUP BY ALL),
 places AS (SELECT p.sn, p.sk, p.spread, s.rank, s.source_size, s.target, CAST(coalesce(sum(part) OVER (PARTITION BY p.sn, p.sk ORDER BY p.spread ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM parts p JOIN s USING (sn, sk)),
 laid AS (SELECT doc_id, size, rank, source_size, target, base + CAST(coalesce(sum(size) OVER (PARTITION BY d.sn, d.sk, d.spread ORDER BY doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN places USING (sn, sk, spread)),
 cells AS (SELECT rank, start, blk, least(start + size, (blk + 1) * 64) - greatest(start, blk * 64) AS words FROM (SELECT *, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS blk FROM laid WHERE size > 0)),
 taken AS (SELECT rank, start, CAST(sum(words * times) AS BIGINT) AS taken, min(shard) AS first_shard FROM cells JOIN times USING (rank, blk) GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_shard FROM laid LEFT JOIN taken ON laid.rank = taken.rank AND laid.start = taken.start AND laid.size > 0
"""
_WALK = " ".join(f"y{k} AS (SELECT * EXCLUDE (y), CASE WHEN y < n THEN y ELSE {_network('y')} END AS y FROM y{k - 1})," for k in range(1, 4))
MIXING = MIXING.replace("{walk}", _WALK).replace("{last}", "3")
