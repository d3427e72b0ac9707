"""The operators against brute force, hand cases and awkward rows."""

import base64
import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagtide.llm import (components, decontam, embed_dedup, html_extract, langid, licenses, line_dedup, mph, packing,
                         simhash, toxicity, warc)
from tagtide.llm.common import held_out, ship
from tagtide.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, id string, th int, fp int, gone int, score int, line_dedup int"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "x", 1, 2, 3, 4, 5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abcdefghijklmnop"), 4)) for _ in range(400)]
    return lambda n, seed: " ".join(np.random.default_rng(seed).choice(stems, n))


def least_reachable(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    rel = con.sql(ORACLE_SQL[name])
    order = [rel.columns.index(c) for c in df.columns]
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall()) and got


# --- helpers -------------------------------------------------------------

def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    links += [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(700, 760)] + [(9, 9)]
    rows = spark.createDataFrame([*links, links[0]], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(rows).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == least_reachable(nodes, [x for x in links if x[0] != x[1]])


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    h = np.random.default_rng(n).integers(0, 2**63, (2, n)).astype(np.uint64)
    m = mph.PerfectHash.from_bytes(mph.PerfectHash.build(h[0], h[1]).to_bytes())
    assert sorted(m.slots(h[0], h[1])) == list(range(n))


# --- op1 -----------------------------------------------------------------

def test_decontamination_tolerates_substitutions_and_takes_both_join_paths(spark, words):
    item = words(30, 7)
    swapped = item.split()
    for k in (3, 11, 19, 27):
        swapped[k] = "zzz"
    d = docs(spark, [(1, words(50, 1) + " " + item.upper().replace(" ", ", ") + " " + words(50, 2)),
                     (2, words(20, 3) + "\n" + " ".join(swapped)), (3, words(200, 4)), (4, None), (5, ""),
                     (6, " ".join(item.split()[8:24])), (6, " ".join(item.split()[8:24])), (None, item),
                     (7, " ".join(item.split()[:5])), (8, "a " * 3000)])
    t = spark.createDataFrame([(10, item), (10, item), (11, None), (12, ""), (None, item), (13, words(3, 9))],
                              "item_id bigint, text string")
    got = sorted(decontam.contaminated(d, t).collect(), key=str)
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 10), (2, 10), (6, 10), (None, 10)}
    one = next(r for r in got if r["doc_id"] == 1)
    assert (one["doc_start"], one["item_start"], one["matched"]) == (50, 0, 13)
    assert sorted(decontam.contaminated(d, t, broadcast_seeds=0).collect(), key=str) == got
    left = [r["doc_id"] for r in decontam.drop_contaminated(d, t).collect()]
    assert sorted(left) == [3, 4, 5, 7, 8]


def test_masks_reach_every_pattern_that_is_accepted():
    from itertools import combinations
    for size in range(1, decontam.WINDOW + 1):
        masks = decontam.MASKS if size == decontam.WINDOW else decontam.SHORT_MASKS[size]
        for gone in combinations(range(size), decontam.allowed(size)):
            assert any(all(at + o not in gone for o in m) for m in masks for at in range(size - max(m))), (size, gone)
    assert [decontam.allowed(n) for n in (1, 6, 7, 8, 9, 12, 13)] == [0, 0, 1, 1, 2, 2, 3]


def test_decontamination_of_isolated_windows_short_items_and_unspaced_scripts(spark, words):
    def with_gaps(text, gaps):
        return " ".join("zzz" if k in gaps else w for k, w in enumerate(text.split()))

    item, nine, seven, four = words(13, 21), words(9, 22), words(7, 23), "Which colour is chalk?"
    chinese, thai = "中国的首都是哪一座城市", "เมืองหลวงของประเทศไทย"
    around = lambda t: words(20, 31) + " " + t + " " + words(20, 32)
    d = docs(spark, [(1, around(with_gaps(item, (3, 6, 7)))), (2, around(with_gaps(nine, (2, 5)))),
                     (3, around(with_gaps(nine, (2, 4, 5)))), (4, around(with_gaps(seven, (3,)))),
                     (5, around(with_gaps(seven, (0, 6)))), (6, around(four.lower())), (7, around("which colour has chalk")),
                     (8, "我想知道" + chinese + "吗"), (9, "ถามว่า" + thai + "คืออะไร"), (10, around(with_gaps(item, (1, 3, 6, 7))))])
    t = spark.createDataFrame([(20, item), (21, nine), (22, seven), (23, four), (24, chinese), (25, thai)],
                              "item_id bigint, text string")
    want = {(1, 20), (2, 21), (4, 22), (6, 23), (8, 24), (9, 25)}
    for limit in (500_000, 0):
        got = decontam.contaminated(d, t, broadcast_seeds=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {r["doc_id"] for r in decontam.drop_contaminated(d, t).collect()} == {3, 5, 7, 10}


# --- op2 -----------------------------------------------------------------

def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    import xxhash
    grams = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, words):
    base = words(600, 1)
    near = [base.replace(base.split()[k], "other", 1) for k in range(5, 40)]
    rows = [(100 + k, t) for k, t in enumerate(near)] + [(7, base), (90, base), (3, None), (4, ""), (5, " \n\t"),
            (11, "OneÉ two"), (12, words(60, 2)), (13, words(60, 3)), (13, words(60, 3)), (20, "word " * 20_000)]
    got = simhash.near_duplicates(docs(spark, [*rows, (None, base)])).collect()
    assert len(got) == len(rows) + 1
    fp = {i: plain_fingerprint(t) for i, t in rows}
    want = least_reachable(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    for r in got:
        if r["id"] is None:
            assert r["component_id"] is None and int(r["fingerprint"], 16) == plain_fingerprint(base)
        else:
            assert (int(r["fingerprint"], 16), r["component_id"]) == (fp[r["id"]], want[r["id"]])
    assert len({want[i] for i, _ in rows}) < len(fp) - 30


def test_shard_links_reach_every_pair_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.uint64(sum(1 << int(b) for b in rng.choice(50, k, False)))
                                             for k in (1, 2, 3, 4, 5, 6)]))
    for block in (1 << 22, 5000):  # one pass, and many
        links = simhash.shard_links(fps, np.zeros(len(fps), np.int8), 52, 2, 4, block)
        pairs = [(int(a), int(b)) for a, b in links]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        near = [(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 4]
        nodes = [int(f) for f in fps]
        assert least_reachable(nodes, pairs) == least_reachable(nodes, near)


def test_simhash_shards_do_not_change_the_links(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 30)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, n, False)) for b in base for n in (0, 1, 2, 4, 5)})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = least_reachable(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    for bits in (None, 3, 16):
        got = [tuple(r) for r in simhash.fingerprint_links(df, 4, bits).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in got) and least_reachable(fps, got) == want
    for hot in (2_000, 20_000):  # shards dealt again, over several levels
        got = [tuple(r) for r in simhash.fingerprint_links(df, 4, 6, hot).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in got) and least_reachable(fps, got) == want
    with pytest.raises(ValueError):
        simhash.fingerprint_links(df, 3)


def test_simhash_family_of_one_head_is_dealt_again(spark):
    """Fingerprints that share their head do not meet in one task: no shard
    that the levels leave is over its size, and all links stay."""
    rng = np.random.default_rng(8)
    fps = np.unique(np.uint64(0xABC << 52) | rng.integers(0, 2**52, 20_000).astype(np.uint64))
    fps = np.unique(np.r_[fps, fps[:500] ^ np.uint64(0b1011 << 40)])
    df = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    levels = simhash._hot_levels(df, 12, 2, simhash.HOT)
    assert [d for d, _ in levels] == [12] and 0xABC in levels[0][1]
    parts = list(simhash._shards(fps, levels, 12, 2))
    for depth, _, prefix, flips in parts:
        weight = np.array([simhash._ball(64 - depth, 2 - f) for f in range(3)])[flips]
        assert not len(prefix) or np.bincount(np.unique(prefix, return_inverse=True)[1], weight).max() <= simhash.HOT
    got = [tuple(r) for r in simhash.fingerprint_links(df, 4, 12).collect()]
    linked = {frozenset(p) for p in got}
    value, other = fps.view(np.int64).tolist(), (fps ^ np.uint64(0b1011 << 40)).view(np.int64).tolist()
    known = set(value)
    want = {frozenset(p) for p in zip(value, other) if p[1] in known}
    assert len(want) >= 500 and want <= linked


# --- op3 -----------------------------------------------------------------

LONG = "A sentence, with commas, that is long enough to be taken for prose, and then some more words."


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("   ", ""), ("plain &amp; bare", "plain & bare"), ("<p></p>", ""),
    (f"<body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>{LONG}<p><b>{LONG}<br>x</article>"
     f"<footer>f</footer>", f"Head\n\n{LONG}\n\n{LONG} x"),
    (f"<script>var t='</p>';</script><style>p{{}}</style><div id=main><p>{LONG}</p><ul><li>One</li><li>Two</ul></div>"
     f"<div class='sidebar'><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", f"{LONG}\n\nOne\n\nTwo"),
    (f"<header><p>{LONG}</p></header><main><header><h1>T</h1></header><p>{LONG} &eacute;&#8364;</p>"
     f"<form><p>{LONG}</p></form><aside>{LONG}</aside></main>", f"T\n\n{LONG} é€"),
])
def test_html_main_text(html, want):
    assert html_extract.extract(html) == want


@pytest.mark.parametrize("html,want", [
    # tags that may be left out: the head's end, the body
    (f"<html><head><title>t</title><body><article><p>{LONG}</article>", LONG),
    (f"<head><meta charset=utf-8><p>{LONG}<p>{LONG}", f"{LONG}\n\n{LONG}"),
    # frames with furniture's names, and a form around the page
    (f"<div class='layout with-sidebar'><div class=text><p>{LONG}</div></div>", LONG),
    (f"<div id=header><main><p>{LONG}</main></div>", LONG),
    (f"<form id=aspnet><input><article><p>{LONG}</article></form>", LONG),
    # comments that are articles, hidden parts, advert boxes, notices
    (f"<article><p>{LONG}</p></article><article class='comment-body'><p>{LONG} {LONG}</p></article>", LONG),
    (f"<section id=comments><article class=comment><p>{LONG}</article></section><div><p>{LONG}</div>", LONG),
    (f"<article><p>{LONG}<div style='display: none'>{LONG}</div><ins class=adsbygoogle>buy</ins>"
     f"<div class='cookie-notice'><p>{LONG}</div><div role=search>find</div></article>", LONG),
])
def test_html_frames_and_furniture(html, want):
    assert html_extract.extract(html) == want


@pytest.mark.parametrize("name", ["social-impact", "related-work", "side-effects", "Search_algorithms", "recommendations",
                                  "share", "notice"])
@pytest.mark.parametrize("tag", ["section", "div"])
def test_html_slug_ids_are_no_furniture(tag, name):
    html = f"<article><h1>Head</h1><p>{LONG}</p><{tag} id='{name}'><h2 id='{name}'>Part</h2><p>{LONG} {LONG}</p></{tag}></article>"
    assert html_extract.extract(html) == f"Head\n\n{LONG}\n\nPart\n\n{LONG} {LONG}"
    prose = f"<article><p>{LONG}</p><{tag} class='{name}'><p>{LONG} {LONG}</p></{tag}></article>"
    assert html_extract.extract(prose) == f"{LONG}\n\n{LONG} {LONG}"


@pytest.mark.parametrize("part", [
    "<div class=share-buttons><span>Share</span></div>", f"<div id=related-posts><a href=x>{LONG}</a> {LONG[:30]}</div>",
    f"<div class='related'><a href=x>{LONG}</a><a href=y>{LONG}</a>{LONG}</div>", f"<section id=comments><p>{LONG} {LONG}</section>",
    f"<div class=comments-area><p>{LONG} {LONG}</div>", f"<div role=complementary><p>{LONG} {LONG}</div>"])
def test_html_named_furniture_inside_an_article(part):
    assert html_extract.extract(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>") == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize("top", ["article", "main", "div"])
def test_html_every_part_of_a_page_in_sections(top):
    five = [(f"Part {i}, with commas, and more, " + LONG * 3)[:300] for i in range(5)]
    first, short = "".join(f"<p>{t}</p>" for t in five), (LONG * 3)[:200]
    quote = "<h3>Sub</h3><ul><li>Item</li></ul><blockquote>Quote</blockquote><pre>code</pre><table><tr><td>cell</table>"
    html = (f"<body><nav><a href=x>{LONG}</a></nav><{top}><h1>Head</h1><section>{first}</section><h2>Two</h2>{quote}"
            f"<section><p>{short}</p></section><div><a href=x>{LONG}</a></div></{top}><div><a href=y>{LONG}</a></div></body>")
    assert html_extract.extract(html) == "\n\n".join(["Head", *five, "Two", "Sub", "Item", "Quote", "code", "cell", short])


def test_html_parts_wrapped_one_level_further_out():
    first = "".join(f"<p>{LONG} {LONG} {k}</p>" for k in range(5))
    for inner in (f"<div><div>{first}</div></div><h2>Two</h2><div><p>{LONG} {LONG}</p><p>{LONG}</p></div>",
                  f"<div><div><div>{first}</div></div></div><div><div><p>{LONG} {LONG}</p><p>{LONG}</p></div></div>"):
        got = html_extract.extract(f"<body><h1>Head</h1>{inner}<ul><li><a href=x>{LONG}</a></ul></body>").split("\n\n")
        assert got == ["Head", *[f"{LONG} {LONG} {k}" for k in range(5)], *(["Two"] if "Two" in inner else []), f"{LONG} {LONG}", LONG]


def test_html_deep_and_long_pages():
    assert html_extract.extract("<div>" * 20_000 + LONG) == LONG
    assert html_extract.extract("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").count(LONG) == 3000


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (2, None, None, "y"),
                                   (None, "v", "<p>é</p>", "z")], "page_id bigint, url string, html string, text string")
    got = sorted(map(tuple, html_extract.extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", LONG, len(LONG))] * 2 + [(2, None, "", 0), (None, "v", "é", 1)], key=str)


# --- op4 and op9 -----------------------------------------------------------

def test_toxicity_on_unseen_documents(spark, words):
    bad = ["slurkon", "slurkat", "slurkus", "vilemo", "vilexa"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = words(40, 1000 + i).split()
        if toxic:
            for k in range(1 + i % 3):
                w[7 * k + 3] = bad[(i // 4 + k) % 5]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "x"), (5, "again")]
    marks = spark.createDataFrame([*labels, (3, 1, None), (1001, 1, 7), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_toxicity(docs(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["id"] is not None and r["id"] < 400]
    assert held and all(zlib.crc32(str(r["id"]).encode()) % 4 == 2 for r in held)
    right = sum(r["predicted"] == (r["id"] % 4 == 0) for r in held)
    assert right / len(held) > 0.95
    hit = next(r for r in held if r["predicted"])
    assert any(s["text"].split()[0] in bad for s in hit["spans"])


def test_marginals_equal_enumeration():
    from itertools import product
    rng = np.random.default_rng(5)
    score, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    start = np.array([0, 3, 4, 7])
    p, pairs = toxicity.marginals(score, start, trans)
    total = np.zeros((2, 2))
    for lo, hi in zip(start[:-1], start[1:]):
        z, on = 0.0, np.zeros(hi - lo)
        part = np.zeros((2, 2))
        for y in product((0, 1), repeat=hi - lo):
            w = np.exp(sum(score[lo + k] * y[k] for k in range(hi - lo)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z, on = z + w, on + w * np.array(y)
            for a, b in zip(y, y[1:]):
                part[a, b] += w
        assert np.allclose(p[lo:hi], on / z)
        total += part / z
    assert np.allclose(pairs, total)


def test_language_on_unseen_documents(spark):
    sets = {"xx": ["alfa", "bravo", "delta"], "yy": ["wuza", "quix", "zyzz"], "zz": ["omi", "ono", "ulu"]}
    rows = []
    for i in range(300):
        lang = list(sets)[i % 3]
        rows.append((i, " ".join(np.random.default_rng(i).choice(sets[lang], 12)), lang))
    rows += [(900, None, "xx"), (901, "", None), (902, "12 + 3", "yy"), (None, "alfa bravo", None), (1, "wuza quix", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(1))
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["id"]: r["lang_pred"] for r in got if r["id"] != 1}
    assert all(by[i] == lang for i, _, lang in rows[2:300])
    assert by[900] == by[901] == by[902] == "und" and by[None] == "xx"


def test_ngrams_of_a_chunked_text_are_the_same(monkeypatch):
    text = "Äpfel und Birnen, 3 Stück – " * 20
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 17)
    cut = langid.ngram_counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


# --- op5 -----------------------------------------------------------------

def test_license_variants(spark):
    mit = licenses.TEXTS["MIT"]
    d = docs(spark, [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub-license").replace(" ", "\n")),
                     (3, mit + " Except on Mondays."), (4, "Prose.\nreleased under the mit licence!\nMore."), (5, None),
                     (6, ""), (None, mit), (1, mit)])
    got = sorted(((r["doc_id"], r["license_id"], r["notices"]) for r in licenses.scan(d).collect()), key=str)
    assert got == sorted([(1, "MIT", ""), (1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "MIT"),
                          (5, None, ""), (6, None, ""), (None, "MIT", "")], key=str)


def test_entire_texts_by_digest_and_notice_lines_of_every_known_id(spark):
    from pathlib import Path
    files = {"Apache-2.0": "Apache-2.0", "GPL-1.0-only": "GPL-1", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3",
             "LGPL-2.0-only": "LGPL-2", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3", "MPL-1.1": "MPL-1.1",
             "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2-only": "GFDL-1.2", "GFDL-1.3-only": "GFDL-1.3",
             "Artistic-1.0-Perl": "Artistic"}
    assert set(files) == set(licenses.DIGESTS)
    folder = Path("/usr/share/common-licenses")
    here = {k: (folder / f).read_text() for k, f in files.items() if (folder / f).exists()}
    end = "END OF TERMS AND CONDITIONS"
    whole = [(k, t.upper()) for k, t in here.items()]
    whole += [(k, t[:t.index(end) + n]) for k, t in here.items() if end in t for n in (0, len(end))]
    lines = [*{*licenses.TEXTS, *licenses.DIGESTS, "GPL-2.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only", "CC-BY-4.0"}]
    rows = whole + [(k, f"prose\n# SPDX-License-Identifier: {k}\nmore") for k in lines]
    rows += [("BSD-3-Clause", "prose\nLicensed under the BSD 3-Clause License."),
             ("MPL-2.0", "prose\nReleased under the Mozilla Public License, v. 2.0"),
             ("LGPL-3.0-only", "prose\nThis project is licensed under the GNU Lesser General Public License, version 3.")]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, [(i, t) for i, (_, t) in enumerate(rows)])).collect()}
    for i, (k, _) in enumerate(rows):
        assert got[i]["license_id" if i < len(whole) else "notices"] == k


# --- op6 -----------------------------------------------------------------

def test_line_dedup_of_a_document_that_loses_very_many_lines(spark):
    """30,000 of its 90,000 lines go: the look-up is one pass over the lines."""
    lines = [f"{i} this line stands in more than one of the documents" for i in range(30_000)]
    most = "\n".join(f"{line}\nshort {i}\n{line[::-1]} alone" for i, line in enumerate(lines))
    rows = [(1, most), *[(i, "\n".join(lines)) for i in range(2, 6)], (9, "\n".join(lines))]
    got = {r["doc_id"]: r for r in line_dedup.keep_lines(docs(spark, rows)).collect()}
    want = "\n".join(f"short {i}\n{line[::-1]} alone" for i, line in enumerate(lines))
    assert got[1]["text"] == want and tuple(got[1]["line_dedup"]) == (90_000, 30_000)
    assert got[9]["text"] == rows[-1][1] and got[2]["text"] == ""


def test_line_dedup_hand_case(spark):
    line = "The same long line that stands in many documents."
    rows = [(i, f"own {i}\n  {line.upper()}\t\nend {i}") for i in range(1, 7)]
    rows += [(6, line), (50, "short"), (51, None), (52, ""), (None, line), (3, f"{line}\n{line}")]
    got = line_dedup.keep_lines(docs(spark, rows), probes_per_task=2, keys_per_shard=2).collect()
    assert len(got) == len(rows)
    kept = Counter((r["doc_id"], r["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_dropped"]) for r in got)
    want = Counter([(i, f"own {i}\nend {i}", 3, 1) for i in range(1, 6)])
    want.update([(6, rows[5][1], 3, 0), (6, line, 1, 0), (50, "short", 1, 0), (51, "", 1, 0), (52, "", 1, 0),
                 (None, line, 1, 0), (3, "", 2, 2)])
    assert kept == want


# --- op7 -----------------------------------------------------------------

def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(10_000, None), (10_001, ""), (10_002, "a   b\n c\t<|endoftext|> don't １２ \x1c 你好 "), (10_003, "x" * 5000)]
    rows = table.union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    pieces = packing.pack(rows, tokenizer_path()).toPandas()
    want = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
            for r in rows.collect()}
    for doc, part in pieces.groupby("doc_id"):
        ids, at = want.pop(doc), 0
        for p in part.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert not want
    padding = 0
    for _, seq in pieces.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == seq.length.cumsum() - seq.length).all()
        n = int(seq.length.sum())
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding == 0


def test_packer_takes_the_level_of_least_squares():
    p = packing.Packer(10, 0)
    for k, n in enumerate((4, 4, 6, 3)):
        p.add(str(k), np.zeros(n, np.uint32))
    # 4 opens (+1); 4 joins it (0) rather than open a second window of level 4 (+3); 6 fits
    # nowhere and opens; 3 joins the 6 (0) rather than open (+1)
    assert {h: int(c) for h, c in enumerate(p.count) if c} == {8: 1, 9: 1}


def test_packer_pours_every_piece():
    p = packing.Packer(64, 0)
    for k in range(500):
        p.add(str(k), np.full(1 + k * 7 % 63, k, np.uint32))
    p.pour()
    got = Counter()
    for r in p.take().itertuples():
        got[r.doc_id] += r.length
    assert got == {str(k): 1 + k * 7 % 63 for k in range(500)}


def test_packing_closes_sequences_by_the_level_array(spark):
    """Of eight tasks' sequences that are no whole window of one document, nine in ten are not poured."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(8, "doc_id")
    pieces = packing.pack(table, tokenizer_path()).toPandas()
    sizes = pieces.groupby("sequence_id")["length"].agg(["sum", "count"])
    mixed = int(((sizes["count"] > 1) | (sizes["sum"] < 2048)).sum())
    # the pour cuts pieces at window edges: a document's part that neither begins nor ends on a window's multiple
    ends = (pieces["start"] + pieces["length"] == pieces["doc_tokens"]) & (pieces["start"] % 2048 == 0)
    whole = (pieces["length"] == 2048) & (pieces["start"] % 2048 == 0)
    cut = pieces[~ends & ~whole]["sequence_id"].nunique()
    assert mixed > 3000 and cut < 0.1 * mixed


# --- op8 -----------------------------------------------------------------

@pytest.mark.parametrize("batch", [5, 10000])  # groups that go on over several batches, and many groups in one
def test_embeddings_equal_brute_force(spark, batch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 32))
    x = [*base, *(base[:20] + 0.1 * rng.standard_normal((20, 32))), *([base[3]] * 30),
         *(base[5] + 0.05 * rng.standard_normal((120, 32)))]
    rows = [(i, [float(np.float32(v)) for v in r], i % 2 if i < 60 else 1) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [float("nan")] * 32, 1), (904, [None] + [1.0] * 31, 1),
           (905, rows[3][1], None), (906, [float("inf")] * 32, 1), (907, [1.0, 2.0], 1), (None, rows[3][1], 1)]
    df = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>, label int").withColumn("cls", F.lit(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = embed_dedup.near_duplicates(df, block=16).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) + len(odd)
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    cos = u @ u.T
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] == rows[j][2] and cos[i, j] >= 0.98]
    deg = Counter(n for p in links for n in p)
    comp = least_reachable(range(len(rows)), links)
    for r in got:
        if r["vec_id"] is not None and r["vec_id"] < 900:
            assert (r["n_links"], r["component_id"]) == (deg[r["vec_id"]], comp[r["vec_id"]])
            assert r["kept"] == (r["vec_id"] == r["component_id"])
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], r["vec_id"] is not None)


def test_small_buckets_are_pooled_whole():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = rng.integers(1, 9, rng.integers(1, 12))
        cut, alone = np.r_[0, np.cumsum(sizes)], rng.random(len(sizes)) < 0.2
        runs = list(embed_dedup.pooled(cut, alone, 10))
        assert [lo for lo, _ in runs] == [0, *[hi for _, hi in runs[:-1]]] and runs[-1][1] == cut[-1]
        for lo, hi in runs:
            inside = [g for g in range(len(sizes)) if lo <= cut[g] < hi]
            assert set(cut[inside]) | {hi} <= set(cut)
            assert len(inside) == 1 or (hi - lo <= 10 and not alone[inside].any())


def test_embedding_tables_grow_with_the_vectors():
    sizes = [embed_dedup.hash_size(n, 0.98, 1024) for n in (0, 10**6, 10**8, 10**10)]
    assert sizes[0] == sizes[1] == (17, 14) and sizes == sorted(sizes) and sizes[3][1] == 24
    for tables, bits in sizes:
        meet = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - meet) ** tables <= embed_dedup.MISS


# --- op10 ----------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/ü x", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (3, None, "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (7, "u", None),
            (8, "u", ""), (9, "line\nbreak", "z" * 200_000), (5, "v", "other"), (None, "n", "other"), (2**60 + 1, "b", "big")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, file int")
    rows.append((11, "https://x.org/a%20b?q=ü: y", "escaped"))
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, file int")
    index = warc.archive(pages.repartition(3), f"file://{tmp_path}/warc")
    got = sorted(warc.read_records(index).collect(), key=str)
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first[h or ""] if i is not None and i != first[h or ""] else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if refers is None else "revisit", refers, data if refers is None else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    r["payload"] and bytes(r["payload"]) if r["payload"] else r["payload"]) for r in got), key=str) == sorted(
        ((*w[:5], bytearray(w[5]) if w[5] == b"" else w[5]) for w in want), key=str)
    urls = Counter(r["url"] for r in got)
    assert urls == Counter(None if u is None else u.replace("\n", "%0A") for _, u, _ in rows)
    some = warc.read_records(index.where("length > 100 and id = 9"))
    assert [r["page_id"] for r in some.collect()] == [9]


# --- empty tables and the pipeline ---------------------------------------

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "pages", "embeddings", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_held_out_rule(spark):
    rows = spark.range(200).withColumn("h", held_out("id")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_pipeline_keeps_columns_of_clashing_names_and_clean_documents(spark):
    import corpus_pipeline as cp
    rows = [(1, "We went to Paris last year", "en", "a", 5), (2, None, None, None, None), (3, "long words " * 40_000, "en", "a", 6)]
    extra = spark.createDataFrame([(*r, 7, "x", 8) for r in rows], "doc_id bigint, text string, lang string, source string, "
                                  "n_chars bigint, line_dedup int, __kept string, gone int")
    assert cp.drop_repeated_lines(spark, extra.drop("__kept"), SMALL).columns == extra.drop("__kept").columns
    items = spark.createDataFrame([(1, "Paris"), (2, "went to Paris last")], "item_id bigint, text string")
    assert decontam.drop_contaminated(extra, items, min_tokens=7).count() == 3
    assert decontam.drop_contaminated(extra, items).count() == 2
    found = decontam.contaminated(extra, items).collect()
    assert {r["item_id"] for r in found} == {1, 2}
    for stage in (cp.drop_repeated_lines, cp.drop_near_copies, cp.drop_benchmark):
        assert stage(spark, extra.limit(0).drop("__kept"), SMALL).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    ship(spark)
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = spark.createDataFrame([(70_000, None, "en", None, 0), (70_001, "123 456", "en", "s", 7), (None, "Thonth and the of.", None, "s", 18)],
                                 d.schema)
    rows = d.unionByName(junk)
    one = cp.identify_language(spark, rows, SMALL)
    assert one.columns == d.columns and {70_000, 70_001}.isdisjoint(r["doc_id"] for r in one.select("doc_id").collect())
    assert one.where("doc_id < 70000").count() >= 0.99 * d.count()
    two = cp.drop_repeated_lines(spark, rows, SMALL)
    assert two.columns == d.columns and two.count() == rows.count()
    three = cp.drop_near_copies(spark, rows, SMALL)
    groups = simhash.near_duplicates(rows).where("id is not null").select("component_id").distinct().count()
    assert three.columns == d.columns and three.count() == groups + 1
    four = cp.drop_benchmark(spark, rows, SMALL)
    bad = {r["doc_id"] for r in QUERIES["op1_decontamination"](spark, SMALL).collect()}
    assert four.columns == d.columns
    assert {r["doc_id"] for r in rows.collect()} - {r["doc_id"] for r in four.collect()} == bad
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    out = cp.run(spark, SMALL)
    assert out.columns[0] == "doc_id" and out.count() > 0
