"""Each operator against a brute-force form, and on nulls, empty tables, ties and repeated rows."""

import collections
import hashlib
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(n=160, seed=3):
    """Small texts with copies, near copies, shared passages, junk, nulls and empties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfgst") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = []
    for k in range(n):
        kind = rng.random()
        if texts and kind < 0.1:
            text = rng.choice(texts)
        elif texts and kind < 0.25:
            words = (rng.choice(texts) or "x").split(" ")
            words[rng.randrange(len(words))] = "Changed"
            text = " ".join(words)
        elif kind < 0.3:
            text = None
        elif kind < 0.35:
            text = rng.choice(["", " \n\t", "one", "two words", "é", "a b c d"])
        elif kind < 0.45:
            text = " ".join(f"{rng.choice(vocabulary)}{rng.choice(['***', '&&&', '###'])}" for _ in range(60))
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
            text = " ".join(words).capitalize() + rng.choice(["", ".\nÜber the líne\n", "\n\n"])
            if kind > 0.85:
                text = text + " " + passage + " tail"
        texts.append(text)
    return [(k * 3 + 1, t, "en", f"s{k % 5}" if k % 11 else None, len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def odd(spark):
    """Rows that repeat, a null id, and a column whose name clashes with the operators'."""
    rows = [(5, "the same text " * 20, 1), (5, "the same text " * 20, 2), (5, "another text", 3), (None, "the same text " * 20, 4), (None, None, 5), (7, "", 6)]
    return spark.createDataFrame(rows, "doc_id long, text string, score long").withColumn("source", F.lit(None).cast("string")).withColumn("key",
        F.lit(1)).withColumn("copies", F.lit(2))


# 1 ---------------------------------------------------------------------------


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base_and_score(spark, docs, rows):
    import xxhash

    from folia.llm.quality_rules import BUCKETS, quality_rules

    good = [r[0] for r in rows if "***" not in (r[1] or "") and "&&&" not in (r[1] or "")][:60]
    got = {r.doc_id: r for r in quality_rules(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), threshold=-0.1).collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    one = lambda w, seed=42: xxhash.xxh64_intdigest(w.encode(), seed)

    def grams(text):
        words = WORD.findall(text or "")
        for a, b in zip(words, [*words[1:], None]):
            yield signed(one(a)) % BUCKETS
            yield signed(one(a) if b is None else one(b, one(a))) % BUCKETS + BUCKETS

    raw, target = collections.Counter(), collections.Counter()
    for i, text, *_ in rows:
        g = list(grams(text))
        raw.update(g)
        if i in good:
            target.update(g)
    ratio = {}
    for k in (0, BUCKETS):
        span = range(k, k + BUCKETS)
        nr, nt = (sum(c[b] + 1 for b in span) for c in (raw, target))
        ratio |= {b: round(1000 * math.log((target[b] + 1) / nt * nr / (raw[b] + 1))) for b in span}
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_of(text)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed
        g = list(grams(text))
        assert r.score == pytest.approx(sum(ratio[b] for b in g) / (len(g) * 1000) if g else 0, abs=1e-9)
        assert r.kept == (not failed and r.score >= -0.1)


def test_quality_rules_edges(spark, nothing):
    from folia.llm.quality_rules import quality_rules

    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules(nothing, none).count() == 0
    out = quality_rules(odd(spark), none).collect()
    assert len(out) == 6 and all(r.score == 0 for r in out)
    text = "a b c a b c a b c"
    r = quality_rules(spark.createDataFrame([(1, text), (2, "x x x x")], "doc_id long, text string"), none).orderBy("doc_id").collect()
    assert [x.n_repeat_words for x in r] == [9, 4]


# 2 ---------------------------------------------------------------------------


def test_embeddings_against_all_pairs(spark):
    from folia.llm.embed_dedup import linked_vectors

    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 64))
    rows = []
    for k, b in enumerate(base):
        rows.append(b)
        for c in range(k % 4):
            noise = rng.standard_normal(64)
            rows.append(b + noise * np.linalg.norm(b) / np.linalg.norm(noise) * (0.05 + 0.08 * c))
    rows += [rows[3]] * 40
    vectors = np.array(rows, np.float32)
    data = [(int(i) * 2, [float(x) for x in v]) for i, v in enumerate(vectors)]
    data += [(9001, None), (9003, []), (9005, [0.0] * 64), (9007, [float("nan")] * 64), (9009, [1.0, None]), (9011, [1.0, 2.0, 3.0]), (9013, [2.0, 4.0, 6.0])]
    got = {r.vec_id: r for r in linked_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    v = vectors.astype(float)
    close = (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)) >= 0.95
    root = list(range(len(v)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in zip(*np.nonzero(close)):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    for i in range(len(v)):
        assert got[2 * i].n_links == close[i].sum() - 1
        assert got[2 * i].component_id == 2 * find(i) and got[2 * i].kept == (find(i) == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (9001, 9003, 9005, 9007, 9009))
    assert got[9011].n_links == got[9013].n_links == 1 and got[9013].component_id == 9011


def test_embeddings_edges(spark):
    from folia.llm.embed_dedup import linked_vectors, turned

    assert linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    out = linked_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])],
        "vec_id long, embedding array<float>").withColumn("links", F.lit(1))).collect()
    assert sorted((r.vec_id is None, r.n_links) for r in out) == [(False, 1), (False, 1), (True, 0)]
    x = turned(np.eye(8, dtype=np.float32), 3) / 8**1.5
    assert np.allclose(x @ x.T, np.eye(8), atol=1e-5)
    wide = [(k, [float(x) for x in np.random.default_rng(k // 2).standard_normal(768) + 0.2 * np.random.default_rng(900 + k).standard_normal(768)]) for k in range(120)]
    got = linked_vectors(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got) >= 118


def test_embeddings_hot_bucket_in_blocks(spark, monkeypatch):
    """A cloud of near vectors that fills more than a block, against all pairs."""
    from folia.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "BLOCK", 50)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    v = np.array([centre + 0.16 * rng.standard_normal(64) for _ in range(300)], np.float32)
    got = {r.vec_id: r for r in embed_dedup.linked_vectors(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)],
        "vec_id long, embedding array<float>")).collect()}
    w = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links = (w @ w.T >= 0.95).sum(1) - 1
    assert sum(got[k].n_links for k in range(300)) >= 0.9999 * links.sum() and all(got[k].n_links <= links[k] for k in range(300))
    assert all(r.component_id == 0 for r in got.values() if links[r.vec_id])


# 3 ---------------------------------------------------------------------------


def water_levels(sizes):
    """Targets by repeated resharing, the plain way."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_targets_and_limits(spark, docs, rows):
    from folia.llm.mixing import mixed_documents, taken_per_document

    extra = spark.createDataFrame([(9000 + k, "w " * 900, "en", "zz-big", 1) for k in range(6)] + [(9100, "tiny one", "en", "a-small", 1)], DOCS)
    everything = docs.union(extra)
    out = taken_per_document(everything, 8).join(everything.select("doc_id", "source"), "doc_id").collect()
    again = taken_per_document(everything, 8).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = water_levels(sizes)
    for r in out:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 + 0.02 * want[s]
    mixed = mixed_documents(everything, 8)
    assert mixed.columns == everything.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == collections.Counter({r.doc_id: r.taken for r in out if r.taken})


def test_mixing_permutation_is_one(spark):
    from folia.llm.mixing import permuted

    for n in (1, 2, 3, 7, 100, 1000, 4097):
        d = permuted(spark.range(n), F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(0))
        assert sorted(r["at"] for r in d.collect()) == list(range(n))


def test_mixing_draws_shard_counts(spark):
    """Counts add up to each source's slots, ranges tile them, and counts over seeds are as a multinomial's."""
    from folia.llm.mixing import shard_counts, shard_ranges, slot_blocks

    slots = {1: 40, 2: 900, 3: 0, 4: 2000}
    targets = spark.createDataFrame([(k, n, max(1, n // 2)) for k, n in slots.items()], "rank long, slots long, blocks long")
    seen, spread = [], 0.0
    for seed in range(5):
        counts = shard_counts(targets, 300, seed)
        got = {(r["rank"], r["shard"]): r["count"] for r in counts.collect()}
        assert {k: sum(n for (rank, _), n in got.items() if rank == k) for k in slots} == slots
        seen.append(got)
        expected = slots[4] / 10
        spread += sum((got.get((4, h), 0) - expected) ** 2 / expected for h in range(10))
    assert 18 < spread < 85 and len({tuple(sorted(x.items())) for x in seen}) == 5  # chi-square of 45 degrees of freedom
    ranges = sorted((r["rank"], r["begin"], r["count"]) for r in shard_ranges(shard_counts(targets, 300)).collect())
    at = collections.Counter()
    for rank, begin, count in ranges:
        assert begin == at[rank]
        at[rank] += count
    rows = slot_blocks(targets, shard_counts(targets, 300)).collect()
    assert len(rows) == sum(slots.values()) and len({(r["rank"], r["slot"]) for r in rows}) == len(rows)
    times = collections.Counter((r["rank"], r["at"]) for r in rows)
    assert set(times.values()) == {2} and len({r["shard"] for r in rows}) == 10


def test_mixing_many_sources(spark):
    from folia.llm.mixing import taken_per_document

    rows = [(k, "word " * (1 + 37 * k % 400), "en", f"h{k:03d}" if k else None, 1) for k in range(300)]
    sizes = collections.Counter({r[3]: len(r[1].split()) for r in rows})
    want = water_levels(sizes)
    for r in taken_per_document(spark.createDataFrame(rows, DOCS), 8).collect():
        assert r.target == pytest.approx(want[f"h{r.doc_id:03d}" if r.doc_id else None])


def test_mixing_edges(spark, nothing):
    from folia.llm.mixing import mixed_documents, taken_per_document

    assert taken_per_document(nothing).count() == 0
    out = taken_per_document(odd(spark), 8).collect()
    assert len(out) == 6 and all(r.taken <= 3 * r["size"] for r in out)
    names = ["size", "rank", "segments", "start", "at", "spread", "before", "base", "target", "blocks", "slots", "shard", "worded", "copy",
        "mix_text", "part", "_0", "first_shard", "s_null", "s.key"]
    wide = spark.createDataFrame([(1, "a b c " * 30, "s"), (2, "d e f " * 30, None)], "doc_id int, text string, source string")
    wide = wide.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    back = mixed_documents(wide, 8)
    assert back.columns == wide.columns and back.schema["doc_id"].dataType.simpleString() == "int"
    assert all(r[c] == k for r in back.collect() for k, c in enumerate(names))
    blank = taken_per_document(odd(spark).withColumn("text", F.lit(" "))).collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 6


# 4 ---------------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_minhash_against_all_pairs(spark, docs, rows):
    from folia.llm.minhash import near_duplicates, one_of_each_group

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert sorted(r.doc_id for r in one_of_each_group(docs).collect()) == sorted(i for i in sets if find(i) == i)


def test_minhash_chain_of_near_copies(spark):
    """Neighbours are linked, the ends are not: a star of the first misses most links."""
    from folia.llm.minhash import near_duplicates

    words = [f"w{k}" for k in range(260)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(40)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {0}


def test_stranger_blocks_hold_every_pair_of_roots_once(spark):
    from folia.llm.minhash import in_stranger_blocks

    rows = [("hot", k, 0 if k < 200 else k) for k in range(230)] + [("one", k, 7) for k in range(50)] + [("two", k, k % 2) for k in range(11)]
    out = in_stranger_blocks(spark.createDataFrame(rows, "band string, doc_id long, root long"), "band", 20).collect()
    groups = collections.defaultdict(lambda: ([], []))
    for r in out:
        groups[r.band, r.x, r.y][0 if r.asks else 1].append(r)
    assert max(len(a) + len(b) for a, b in groups.values()) < 90 and sum(r.band == "hot" and r.root == 0 for r in out) == 400
    met = collections.Counter()
    for (band, _, _), (ask, asked) in groups.items():
        for a in ask:
            for b in asked:
                if a.root != b.root and (not b.stranger or b.doc_id > a.doc_id):
                    met[band, min(a.doc_id, b.doc_id), max(a.doc_id, b.doc_id)] += 1
    assert met == collections.Counter({(x[0], x[1], y[1]): 1 for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[2] != y[2]})


def test_minhash_keeps_the_same_row_of_a_repeated_id(spark):
    from folia.llm.minhash import one_of_each_group

    rows = [(1, f"text number {k} " * 9, k) for k in range(8)] + [(None, "x", 9), (None, "x", 10)]
    one = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, kept_id long").repartition(5)).collect()
    two = one_of_each_group(spark.createDataFrame(rows[::-1], "doc_id long, text string, kept_id long").repartition(3)).collect()
    assert len(one) == 3 and sorted(r.kept_id for r in one) == sorted(r.kept_id for r in two)


def test_minhash_edges(spark, nothing):
    from folia.llm.minhash import near_duplicates, one_permutation

    assert near_duplicates(nothing).count() == 0
    out = near_duplicates(odd(spark)).collect()
    assert len(out) == 6 and all(r.kept for r in out if r.doc_id is None)
    assert one_permutation(np.array([5], np.uint64)).shape == (128,)


# 5 ---------------------------------------------------------------------------


def test_warc_round_trip_over_small_splits(spark):
    from folia.llm.runtime import new_path
    from folia.llm.warc import archive_round_trip, read_archives, with_record_types, write_archives

    big = "<p>" + "same payload " * 20 + "é</p>"
    rows = [(k, f"http://h/{k} x\n", big if k % 3 == 0 else f"<p>{k} {'z' * k}</p>") for k in range(4, 120)] + [(500, None, None), (501, "u", ""),
        (None, "n", big), (502, "r", "\x1f" + big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: r for r in archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = html == big and i != 6
        assert (r.record_type, r.refers_to) == (("revisit", 6) if again else ("response", None))
    folder = new_path(spark, "warc")
    files = write_archives(with_record_types(pages).coalesce(2), folder)
    for split in (97, 1000, 1 << 20):
        back = read_archives(spark, folder, files, payloads=True, split=split).collect()
        assert len(back) == len(rows)
    texts = {r.record_id: bytes(r.payload) for r in back if r.record_type == "response"}
    assert texts["urn:page:502"] == ("\x1f" + big).encode()
    import gzip

    assert gzip.open(files[0][0]).read().startswith(b"WARC/1.1\r\n")


def test_warc_member_at_the_end_of_what_is_loaded():
    import io

    import pyarrow as pa

    from folia.llm.warc import members, parse_record, record_bytes

    payload = "é some page ".encode() * 50
    record = record_bytes(7, "u", payload, hashlib.sha256(payload).hexdigest(), "response", None)
    for short in (3, 10, 40, 100):
        data = b"\0" * (4096 - short) + record + record
        found = list(members(pa.PythonFile(io.BytesIO(data), "r"), len(data), 0, len(data), step=4096))
        assert [at for at, _ in found] == [4096 - short, 4096 - short + len(record)]
        assert all(parse_record(x)["payload"] == payload for _, x in found)


def test_warc_empty_table(spark):
    from folia.llm.warc import archive_round_trip

    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 6 ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, really, many.</div>
<div id="main"><article><h1>Head &amp; shoulders</h1><p><b>First,  para<br>graph with &eacute; and &lt;tags&gt;.<p>Second one, a bit longer, with
a line break. <a href="x">link</a></p><!-- no --><ul><li>item one<li>item two</ul><form><input>Mail</form><div class="ad">Buy</div></article>
<aside>Other news</aside><section class="comments"><p>Reader says, loudly, that, this is wrong.</p></section></div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    from folia.llm.html_extract import main_text

    assert main_text(PAGE).split("\n\n") == ["Head & shoulders", "First, para graph with é and <tags>.",
        "Second one, a bit longer, with a line break. link", "item one", "item two"]
    plain = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>" + "Words, and words. " * 20 + "</p><p>End.</p></div></body>"
    assert main_text(plain).split("\n\n")[1:] == ["End."]
    named = '<div class="layout has-sidebar"><div class="post-header"><h1>Own head</h1></div><div class="content"><p>' + "Words, and words. " * 9 + '</p></div><div class="widget">No</div></div>'
    assert main_text(named).split("\n\n")[0] in ("Own head", ("Words, and words. " * 9).strip()) and "No" not in main_text(named)
    assert main_text("") == "" and main_text("<nav>x</nav>") == "" and main_text("just text") == "just text"
    assert main_text("<p>" * 3000 + "deep, text here" + "</div>" * 50)


ARTICLE = "<p>" + "A long sentence, with commas, that reads as an article. " * 6 + "</p>"


@pytest.mark.parametrize("page,times", [
    (f"<main>{ARTICLE}<svg width=1 />{ARTICLE}</main>", 12), (f"<main>{ARTICLE}<iframe src=x/>{ARTICLE}<iframe src=y>{ARTICLE}</main>", 18),
    (f'<head><script src="x"/></head><body><article>{ARTICLE}</article>', 6), (f"<head><title>name<body><article>{ARTICLE}</article>", 6),
    (f'<div class="promotion-story">{ARTICLE}</div>', 6), (f'<div class="promotion">{ARTICLE}</div><article>{ARTICLE}</article>', 6), (f"<form>{ARTICLE}</form>", 6),
    (f'<main>{ARTICLE}<div id="discussion"><p>Reader remark.</p></div></main>', 6),
    (f'<main>{ARTICLE}<section id="discussion"><article><p>Reader remark.</p></article></section></main>', 6),
    (f"<article>{ARTICLE}<article><p>Reader remark.</p></article></article>", 6),
    (f'<main>{ARTICLE}<p title="a > b">{"A long sentence." * 9}</p><p id=it\'s>A long sentence.</p></main>', 16),
])
def test_main_text_keeps_the_article(page, times):
    from folia.llm.html_extract import main_text

    text = main_text(page)
    assert text.count("A long sentence") == times and "remark" not in text and "name" not in text


def test_main_text_of_papers_and_menus():
    from folia.llm.html_extract import main_text

    assert "It follows." in main_text(f'<main><section id="methods">{ARTICLE}</section><section id="discussion"><p>It follows.</p></section></main>')
    assert main_text('<nav><a href="/">Home</a></nav><div class="menu"><a>One</a></div>') == ""


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a b="<x>"' * 100_000, "<div><p>x y z" * 100_000, "<svg>" * 100_000, "<" * 1_000_000,
    "<ul><li>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000])
def test_main_text_of_hostile_pages_is_fast(page):
    import time

    from folia.llm.html_extract import main_text

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 8


def test_tree_scoring_against_brute_force():
    """Random trees, scored from the definition: every container adds up what each text below passes up to it."""
    from folia.llm.html_extract import BASE, LEVELS, main_text

    rng = random.Random(5)

    def tree(depth):
        kids = [tree(depth + 1) if depth < 5 and rng.random() < 0.5 else ("p", [" ".join(rng.choice(["one,", "two",
            "three"]) for _ in range(rng.randint(1, 40)))]) for _ in range(rng.randint(1, 4))]
        return rng.choice(["div", "section", "blockquote", "ul"]), kids

    def written(node):
        return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(written, node[1])) + f"</{node[0]}>"

    def below(node, path=()):
        for k in node[1]:
            if isinstance(k, str):
                yield (*path, id(node)), k
            else:
                yield from below(k, (*path, id(node)))

    def every(node):
        yield node
        for k in node[1]:
            if not isinstance(k, str):
                yield from every(k)

    for _ in range(40):
        top = ("body", [tree(0) for _ in range(3)])
        texts, nodes = list(below(top)), {id(n): n for n in every(top)}
        up = {id(k): id(n) for n in every(top) for k in n[1] if not isinstance(k, str)}
        points = {}
        for n in nodes:
            gained = [1 + t.count(",") + min(len(t) / 100, 3) for path, t in texts if n in path[:-1]]
            levels = [len(path) - 2 - path.index(n) for path, t in texts if n in path[:-1]]
            parts = [g / ((1, 2, 6, 9)[lv] if lv < 4 else 3 * lv) for g, lv in zip(gained, levels) if lv < LEVELS]
            if parts:
                points[n] = BASE.get(nodes[n][0], 0.0) + sum(parts)
        depth = {n: next(len(path[: path.index(n)]) for path, _ in texts if n in path) for n in points}
        best = max(points, key=lambda n: (points[n], -depth[n]))
        keep = {best} | {n for n in points if up.get(n) == up.get(best) and best in up and points[n] >= max(10.0, 0.2 * points[best]) and nodes[n][0] != "ul"}
        reads = lambda path, t: best in up and len(path) > 1 and path[-2] == up[best] and (len(t) > 80 or t.rstrip()[-1:] in ".!?")
        assert main_text(written(top)) == "\n\n".join(" ".join(t.split()) for path, t in texts if keep & set(path) or reads(path, t))


def test_extract_pages(spark):
    from folia.llm.html_extract import extract_pages

    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, ""), (None, "x", "<p>é")],
        "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = sorted(extract_pages(pages).collect(), key=lambda r: r.n_chars)
    assert [r.n_chars for r in out] == [0, 0, 1, len(out[3].text)]
    assert extract_pages(pages.limit(0)).count() == 0


# 7 ---------------------------------------------------------------------------


def test_packing_tokens_and_places(spark, docs, rows):
    from tokenizers import Tokenizer

    from folia.llm.packing import default_vocabulary, pack_documents

    tokenizer = Tokenizer.from_file(default_vocabulary())
    extra = [(9001, "it's I'LL ΑΣ <|endoftext|> ½ 日本 _x_ İ\x1c", "en", "s", 1), (9002, "longword" * 3000 + " " + "many words " * 900, "en", "s", 1)]
    out = pack_documents(docs.union(spark.createDataFrame(extra, DOCS)), sequence=256).collect()
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for i, text, *_ in rows + extra:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [
            (k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256)]
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.05 * math.ceil(sum(r.length for r in out) / 256) + 1


def plain_sum_of_squares(lengths, capacity):
    """The rule with every possible place tried in turn."""
    gaps, wanted, opened = [], -(-sum(lengths) // capacity), 0
    total = lambda g: sum(n * n for gap, n in collections.Counter(g).items() if 0 < gap < capacity)
    out = []
    for a in lengths:
        best = None
        for k in sorted(range(len(gaps)), key=lambda k: gaps[k]):
            if gaps[k] >= a and gaps[k] < capacity:
                cost = total(gaps[:k] + [gaps[k] - a] + gaps[k + 1 :])
                if best is None or cost < best[0]:
                    best = (cost, k)
        fresh = total(gaps + [capacity - a])
        if best is None or (fresh < best[0] and opened < wanted):
            gaps.append(capacity - a)
            opened += 1
            out.append(total(gaps))
        else:
            gaps[best[1]] -= a
            out.append(total(gaps))
    return len(gaps), out


def test_sum_of_squares_rule():
    from folia.llm.packing import sum_of_squares

    rng = random.Random(5)
    for _ in range(20):
        lengths = [rng.randint(1, 20) for _ in range(60)]
        bins, offsets = sum_of_squares(lengths, 20)
        fill, squares = collections.Counter(), []
        for n, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
            assert fill[b] == o
            fill[b] += n
            squares.append(sum(k * k for gap, k in collections.Counter(20 - f for f in fill.values()).items() if gap))
        count, want = plain_sum_of_squares(lengths, 20)
        assert squares == want and len(fill) == count


def test_packing_edges(spark, nothing):
    from folia.llm.packing import pack_documents

    assert pack_documents(nothing).count() == 0
    assert pack_documents(odd(spark)).count() == 6


# 8 ---------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    from folia.llm.classifier import good_documents, quality_scores

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    rows = []
    for k in range(500):
        bad = k % 4 == 0
        rows.append((k, " ".join(rng.choice(words) + ("!!" if bad else "") for _ in range(40)), int(not bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    out = {r.doc_id: r for r in quality_scores(d, d.select("doc_id", "quality"), per_class=100).collect()}
    for k, _, q in rows:
        assert out[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert out[k].predicted == q == int(out[k].score >= 0.5) and 0 <= out[k].score <= 1
    assert good_documents(d, d.select("doc_id", "quality")).count() == sum(q for *_, q in rows)
    swapped = d.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_scores(d, swapped.select("doc_id", "quality"), per_class=100).collect()}
    assert again == {k: r.score for k, r in out.items()}


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    from folia.llm.classifier import dual_coordinate_descent

    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(40)]
    sign = np.where(rng.random(40) < 0.5, 1, -1)
    values = rng.standard_normal(12)
    w, b = dual_coordinate_descent(rows, values, sign, 0.5, epochs=4000)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r], x[i, 12] = values[r], 1

    def primal(v):
        return v @ v / 2 + 0.5 * np.maximum(0, 1 - sign * (x @ v)).sum()

    best = np.append(w, b)
    for _ in range(300):
        assert primal(best) <= primal(best + rng.standard_normal(13) * 0.02) + 1e-4


def test_classifier_edges(spark, nothing):
    from folia.llm.classifier import quality_scores

    labels = spark.createDataFrame([(5, 1), (5, None), (None, 0)], "doc_id long, quality int")
    assert quality_scores(nothing, labels).count() == 0
    out = quality_scores(odd(spark), labels.limit(0)).collect()
    assert len(out) == 6 and all(r.score == 0.5 for r in out)
    assert quality_scores(odd(spark), labels).count() == 6


# 9 ---------------------------------------------------------------------------


def test_sharding_round_trip_and_versions(spark, docs, rows):
    from folia.llm.runtime import new_path
    from folia.llm.sharding import ManifestConflict, ShardedTable, sharded

    back, told = sharded(docs)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, docs.collect()))
    assert told == {"n_arrivals": told["n_arrivals"], "version_rows": len(rows), "n_full_tiers": 0, "n_oversized": 0} and told["n_arrivals"] > 10
    table = ShardedTable(spark, new_path(spark, "shards"), target_bytes=1 << 16, smallest=1 << 12, fan_in=3)
    with pytest.raises(ValueError):
        table.read()
    for k in range(7):
        table.append(docs.where(F.col("doc_id") % 7 == k).coalesce(1))
    assert table.version() == 7 and len(table.manifest()["runs"]) == 7
    second, opened = table.manifest(2), table.read(2)
    before = sorted(r.doc_id for r in opened.collect())
    manifest = table.compact()
    tiers = collections.Counter(table.tier(r["bytes"]) for r in manifest["runs"])
    assert all(n < 3 for n in tiers.values()) and manifest["version"] == table.version() > 7
    # older versions, and readers that were open, read what they did
    assert second == table.manifest(2) and sorted(r.doc_id for r in table.read(2).collect()) == before == sorted(r.doc_id for r in opened.collect())
    assert table.read().count() == len(rows) == sum(r["rows"] for r in manifest["runs"])
    with pytest.raises(ManifestConflict):
        table.commit(3, [])
    table.expire()
    assert table.versions() == [manifest["version"]] and table.read().count() == len(rows) and table.manifest() == manifest
    kept = {f for r in manifest["runs"] for f in r["files"]}
    assert {f for r in second["runs"] for f in r["files"] if f not in kept and os.path.exists(f.removeprefix("file:"))} == set()


def test_sharding_of_two_writers_one_gets_the_version(spark, monkeypatch):
    """A writer that saw the same last version loses, an append then goes on top, and a merge leaves the table alone."""
    from folia.llm.runtime import new_path
    from folia.llm.sharding import ManifestConflict, ShardedTable

    root = new_path(spark, "shards")
    one, two = ShardedTable(spark, root, fan_in=2), ShardedTable(spark, root, fan_in=2)
    for k in range(2):
        one.append(spark.createDataFrame([(k,)], "a long"))
    stale = two.manifest()
    fresh = ShardedTable.manifest
    one.append(spark.createDataFrame([(7,)], "a long"))
    seen = []
    monkeypatch.setattr(two, "manifest", lambda version=None: stale if version is None and not seen.append(1) and len(seen) == 1 else fresh(two, version))
    two.append(spark.createDataFrame([(8,)], "a long"))
    assert sorted(r.a for r in one.read().collect()) == [0, 1, 7, 8] and one.version() == 4
    seen.clear()
    with pytest.raises(ManifestConflict):
        two.compact()
    assert sorted(r.a for r in one.read().collect()) == [0, 1, 7, 8]


def test_sharding_keeps_columns_of_later_runs(spark):
    from folia.llm.runtime import new_path
    from folia.llm.sharding import ShardedTable

    table = ShardedTable(spark, new_path(spark, "shards"), fan_in=2)
    table.append(spark.createDataFrame([(1,)], "a long"))
    table.append(spark.createDataFrame([(2, "x")], "a long, b string"))
    for _ in range(2):
        assert sorted((r.a, r.b) for r in table.read().select("a", "b").collect()) == [(1, None), (2, "x")]
        table.compact()


def test_sharding_edges(spark, nothing):
    from folia.llm.sharding import through_shards

    assert through_shards(nothing).count() == 0
    wide = odd(spark).withColumn("Arrival", F.lit("x")).withColumn("arrival_", F.lit("y")).withColumn("n_arrivals", F.lit(3)).withColumn("a.b", F.lit(4))
    back = through_shards(wide)
    assert back.columns == wide.columns and sorted(map(repr, back.collect())) == sorted(map(repr, wide.collect()))


# 10 --------------------------------------------------------------------------


def removed_bytes(rows, length):
    seen, out = set(), {}
    for i, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        cut = bytearray(len(text))
        for p in range(len(text) - length + 1):
            w = text[p : p + length]
            if w in seen:
                cut[p : p + length] = b"\1" * length
            seen.add(w)
        out[i] = (text, cut)
    return out


def test_suffix_dedup_against_all_windows(spark, docs, rows):
    from folia.llm.suffix_dedup import documents_without_repeats, without_repeats

    periodic = [(9001, "ab" * 300, "en", "s", 600), (9002, "x" + "ab" * 200, "en", "s", 401), (9003, "é" * 400, "en", "s", 400)]
    everything = docs.union(spark.createDataFrame(periodic, DOCS))
    want = removed_bytes(rows + periodic, 100)
    got = {r.doc_id: r for r in without_repeats(everything).collect()}
    assert len(got) == len(want)
    for i, (text, cut) in want.items():
        spans = sum(1 for k in range(len(cut)) if cut[k] and (not k or not cut[k - 1]))
        kept = bytes(c for c, m in zip(text, cut) if not m)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(text), sum(cut), spans, kept)
    texts = {r.doc_id: r.text for r in documents_without_repeats(everything).collect()}
    assert texts == {i: bytes(g.kept).decode("utf-8", "ignore") for i, g in got.items()}
    assert documents_without_repeats(everything).columns == everything.columns


def test_suffix_dedup_of_hot_anchors_and_long_texts_in_pieces(spark, docs, rows, monkeypatch):
    """With every open anchor hot, and texts cut into small pieces, the same bytes go."""
    from folia.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(150))
    around = [(9000 + k, "".join(rng.choice("klmno") for _ in range(rng.randint(0, 700))) + passage[k % 7 :] + f"{k} " * 30, "en", "s", 1) for k in range(60)]
    want = removed_bytes(rows + around, 100)
    for r in suffix_dedup.without_repeats(docs.union(spark.createDataFrame(around, DOCS))).collect():
        text, cut = want[r.doc_id]
        assert bytes(r.kept) == bytes(c for c, m in zip(text, cut) if not m)


def test_maximal_repeats_against_all_substrings():
    from folia.llm.suffix_dedup import maximal_repeats

    rng = random.Random(8)
    for _ in range(30):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(3)]
        places = collections.defaultdict(list)
        for t, text in enumerate(texts):
            for a in range(len(text)):
                for b in range(a + 8, len(text) + 1):
                    places[text[a:b]].append((t, a))
        want = []
        for s, at in places.items():
            before = {texts[t][a - 1] if a else (t, "start") for t, a in at}
            after = {texts[t][a + len(s)] if a + len(s) < len(texts[t]) else (t, "end") for t, a in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                want.append((len(s), sorted(at)))
        found = [x for x in maximal_repeats(texts, 8)]
        assert sorted(want) == sorted(x for x in found if x in want)
        for n, at in found:
            assert len({texts[t][a : a + n] for t, a in at}) == 1 and sorted(places[texts[at[0][0]][at[0][1] : at[0][1] + n]]) == at


def test_suffix_dedup_edges(spark, nothing):
    from folia.llm.suffix_dedup import without_repeats

    assert without_repeats(nothing).count() == 0
    out = without_repeats(odd(spark)).collect()
    assert len(out) == 6 and [r.n_removed for r in out if r.doc_id is None and r.n_bytes] == [280]


def test_suffix_dedup_repeated_rows(spark):
    from folia.llm.suffix_dedup import documents_without_repeats, without_repeats

    assert sorted(r.n_removed for r in without_repeats(odd(spark)).collect() if r.doc_id == 5) == [0, 266, 266]
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, other = text(600), text(600)
    once = [(1, passage), (2, "x" + passage[100:400] + text(90) + other[:200]), (3, text(80) + passage[50:350] + "y"), (4, other)]
    want = {i: bytes(c for c, m in zip(t, cut) if not m) for i, (t, cut) in removed_bytes(once, 100).items()}
    rows = spark.createDataFrame([*once, *once, once[0]] + [(None, "z" + text(300))] * 3, "doc_id long, text string").repartition(5)
    out = without_repeats(rows).collect()
    assert len(out) == 12 and all(bytes(r.kept) == want[r.doc_id] for r in out if r.doc_id)
    assert [r.n_removed for r in out if r.doc_id is None] == [0] * 3
    assert sorted(r.text for r in documents_without_repeats(rows).collect()) == sorted(bytes(r.kept).decode() for r in out)


def test_suffix_dedup_texts_of_one_id_whose_short_hashes_are_equal(spark):
    from folia.llm.suffix_dedup import without_repeats

    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(300))
    texts = spark.range(1 << 18).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit(passage), F.format_string("%08d", "id")).alias("text"))
    pair = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).where("size(texts) = 2").orderBy("h").limit(1).collect()[0].texts
    assert pair[0] != pair[1]
    out = without_repeats(spark.createDataFrame([(1, t) for t in pair], "doc_id long, text string")).collect()
    shared = max(k for k in range(309) if pair[0][:k] == pair[1][:k])
    assert sorted(r.n_removed for r in out) == [0, shared]


# all ---------------------------------------------------------------------------

NAMES = """score features good held_out predicted bucket kept words n_words h1 h2 id copies links root component_id n_shingles set_hi set_lo signature band a b part partner
 kept_id kept_text whole doc twin packed wanted kind n_bytes arrival grp piece start length size rank segments spread slot shard worded at x y family stranger asks _0 _1 key k salt""".split()


def test_columns_of_any_name_are_carried_or_ignored(spark):
    """Every operator and stage over a table whose other columns have the operators' own names."""
    from folia.llm import classifier, minhash, mixing, packing, quality_rules, sharding, suffix_dedup

    rows = [(k, f"plain words of text number {k} " * 12, f"s{k % 2}") for k in range(12)] + [(3, "another text of number three " * 9, None),
        (None, None, None), (20, "", "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(NAMES)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    for stage in (lambda x: classifier.good_documents(x, labels), minhash.one_of_each_group, suffix_dedup.documents_without_repeats,
        lambda x: mixing.mixed_documents(x, 8), sharding.through_shards):
        out = stage(d)
        assert out.columns == d.columns
        assert all(r[c] == k for r in out.collect() for k, c in enumerate(NAMES))
    for operator in (lambda x: quality_rules.quality_rules(x, labels), lambda x: classifier.quality_scores(x, labels), minhash.near_duplicates,
        suffix_dedup.without_repeats, mixing.taken_per_document):
        assert operator(d).count() == len(rows)
    assert {r.doc_id for r in packing.pack_documents(d).select("doc_id").collect()} == {r[0] for r in rows}


def test_long_texts(spark):
    """A text of some millions of words, and one of a single word, through every kernel that works in parts."""
    from folia.llm import classifier, kernels, minhash, packing, suffix_dedup

    rng = random.Random(3)
    words = [f"{rng.choice('abcdefgh')}{k % 977}" for k in range(700_000)]
    long = " ".join(words)
    buf = np.frombuffer(long.encode(), np.uint8)
    starts, ends, _ = kernels.word_spans(buf, np.array([0, len(buf)]))
    whole = kernels.span_hash(kernels.prefix_hash(buf), starts, ends)
    assert len(buf) > 3 << 20 and np.array_equal(kernels.word_hashes(buf, np.array([0, len(buf)]))[0], whole)
    rows = [(1, long), (2, long + " end"), (3, "w" * 3_000_000), (4, "short " * 60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r for r in minhash.near_duplicates(d).collect()}
    assert near[2].component_id == 1 and near[3].n_shingles == 1 and near[1].n_shingles == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    left = {r.doc_id: r for r in suffix_dedup.without_repeats(d).collect()}
    assert left[2].n_removed >= len(buf) and left[3].n_removed == 3_000_000 - 1 and left[1].n_bytes == len(buf)
    scored = classifier.quality_scores(d, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")).collect()
    assert len(scored) == 4
    encoder = packing.Encoder(packing.default_vocabulary())
    assert encoder.encode([long])[0] == encoder.whole(long)
    assert sum(r.length for r in packing.pack_documents(d.where("doc_id <> 3")).collect()) > 700_000


# pipeline --------------------------------------------------------------------


def groups_by_brute_force(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_pipeline_stages(spark, docs, rows, tmp_path):
    """Each stage on its predecessor's rows against a brute-force form; the classifier against its own scores."""
    import corpus_pipeline
    from folia.llm import classifier, packing

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int("***" not in (r[1] or "") and "&&&" not in (r[1] or "") and "###" not in (r[1] or "")), 0) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), [rows]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == now.columns, name
            out.write.parquet(f"{tmp_path}/out{k}")
            now = spark.read.parquet(f"{tmp_path}/out{k}")
            seen.append([tuple(r) for r in now.collect()])
    first, good, single, cut, mix = seen
    scores = {r.doc_id: r.predicted for r in classifier.quality_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert sorted(map(repr, good)) == sorted(repr(r) for r in first if scores[r[0]]) and len(good) < len(first)
    roots = groups_by_brute_force({r[0]: shingles(r[1]) for r in good}, 80)
    assert sorted(map(repr, single)) == sorted(repr(r) for r in good if roots[r[0]] == r[0]) and len(single) < len(good)
    want = {i: bytes(c for c, m in zip(t, gone) if not m).decode("utf-8", "ignore") for i, (t, gone) in removed_bytes(single, 100).items()}
    assert {r[0]: r[1] for r in cut} == want and any(want[r[0]] != (r[1] or "") for r in single)
    sizes, source, taken = collections.Counter(), {r[0]: r[3] for r in cut}, collections.Counter()
    words = {r[0]: WORD.findall(r[1] or "") for r in cut}
    for i, w in words.items():
        sizes[source[i]] += len(w)
    of_doc = collections.defaultdict(collections.Counter)
    for r in mix:
        taken[r[3]] += len(WORD.findall(r[1]))
        of_doc[r[0]].update(WORD.findall(r[1]))
    levels = water_levels(sizes)
    assert all(abs(taken[s] - levels[s]) <= 2 * 64 + 0.02 * levels[s] for s in sizes)
    assert all(n <= 3 * collections.Counter(words[i])[w] for i, c in of_doc.items() for w, n in c.items())
    packed = out.collect()
    encoder = packing.Encoder(packing.default_vocabulary())
    tokens = sorted((r[0], len(encoder.whole(r[1] or "")) // 4 + 1) for r in mix)
    pieces = collections.defaultdict(list)
    for r in packed:
        pieces[r.sequence_id].append((r.offset, r.length))
    assert sum(n for _, n in tokens) == sum(r.length for r in packed)
    for group in pieces.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 4096
    key = ("doc_id", "piece", "length", "ids_crc32")
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).select(*key).collect())) == sorted(repr(r) for r in out.select(*key).collect())


def test_pipeline_links_near_copies_from_080_on(spark):
    import corpus_pipeline

    rows, want = [], set()
    for n in range(44, 66):  # one other word in the middle: similarities from 0.78 to below 0.85
        words = [f"w{n}x{j}" for j in range(n)]
        texts = [" ".join(words), " ".join([*words[:20], "other", *words[21:]])]
        a, b = map(shingles, texts)
        near = 100 * len(a & b) >= 80 * len(a | b)
        assert 100 * len(a & b) < 85 * len(a | b) and near == (n >= 49)
        rows += [(2 * n, texts[0]), (2 * n + 1, texts[1])]
        want |= {2 * n} if near else {2 * n, 2 * n + 1}
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in out} == want and len(out) == len(want)
