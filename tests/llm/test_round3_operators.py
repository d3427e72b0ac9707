"""Spelling variants, piecewise fingerprints and ranked search against brute force and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tagtide.llm import piecewise, ranked_search, spelling
from tagtide.llm.queries import QUERIES

DOCS = ("doc_id bigint, text string, word string, n bigint, pair string, near int, item string, term int, terms int, "
        "score int, rank int, id string, part int, tie int, head int")
ITEMS = "item_id bigint, text string, doc_id bigint, score string, item int, rank int"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "w", 1, "p", 2, "i", 3, 4, 5, 6, "x", 7, 8, 9) for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in rows], ITEMS)


# --- op11 ----------------------------------------------------------------

def spelled(rows, least=6, count=5, ratio=5):
    """The contract, word by word and pair by pair."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        others = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form[w] = others[0] if others and n[others[0]] >= ratio * n[w] else None
        out[w] = [len(others)]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], out[w][0], n[form[w]] if form[w] else None)
    return sorted(out.values())


@pytest.fixture(scope="module")
def misspelled():
    rng = np.random.default_rng(5)
    rows = []
    for doc in range(400):
        words = []
        for _ in range(60):
            w = ["spelling", "variant", "éclairage", "corpus", "abcdefghij", "jihgfedcba", "aaaaaaaaaaaa"][
                int(rng.integers(0, 7))]
            for _ in range(int(rng.integers(0, 40) == 0) + int(rng.integers(0, 200) == 0)):
                at = int(rng.integers(0, len(w)))
                w = [w[:at] + w[at + 1:], w[:at] + "xé"[at % 2] + w[at + 1:], w[:at] + "n" + w[at:]][doc % 3]
            words.append(w.title() if rng.integers(0, 9) == 0 else w)
        rows.append((doc, " ".join(words)))
    return rows


@pytest.mark.parametrize("chunk", [4096, 7])
def test_spelling_equals_brute_force(spark, misspelled, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rows = [*misspelled, (None, "Spelling spelling"), (7, None), (8, ""), (9, "spelling"), (9, "spelling"),
            (500, "É" * 30_000 + " ÉCLAIRAGE×÷ " + "tiny " * 9)] + [(600 + k, "z" * 20_000) for k in range(6)]
    rows += [(700 + k, "linkedword " * 200 + "linkedworx " * 30 + "linkedwoxx " * 5) for k in range(4)]
    got = sorted(map(tuple, spelling.variants(docs(spark, rows)).collect()))
    want = spelled(rows)
    assert got == want and sum(r[1] is not None for r in want) > 20
    assert any(r[1] != r[2] and r[1] for r in want)  # a chain of two


def test_steps_reach_every_edit():
    """Every single edit moves the class counts by one of STEPS, or back by it."""
    def key(w):
        own = [sum(c in letters for c in w) for letters in spelling.CLASSES]
        return (*own, len(w) - sum(own))

    steps = {*spelling.STEPS, *(tuple(-x for x in s) for s in spelling.STEPS)}
    word, letters = "tonédal", "etdéz"
    edits = {word[:k] + word[k + 1:] for k in range(7)} | {word[:k] + c + word[k + 1:] for k in range(7) for c in letters}
    for other in edits:
        assert tuple(a - b for a, b in zip(key(other), key(word))) in steps
    assert len(spelling.STEPS) == len(set(spelling.STEPS)) == 11


def test_near_pairs_equal_all_pairs():
    rng = np.random.default_rng(2)
    a = ["".join(rng.choice(list("abéÿ"), 6)) for _ in range(200)]
    b = ["".join(rng.choice(list("abéÿ"), 7)) for _ in range(200)]
    got = set(zip(*(x.tolist() for x in spelling.near_pairs(a, b))))
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if any(y[:k] + y[k + 1:] == x for k in range(7))}
    got = set(zip(*(x.tolist() for x in spelling.near_pairs(a, None))))
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(a)
                   if i < j and sum(p != q for p, q in zip(x, y)) == 1}


# --- op12 ----------------------------------------------------------------

def trial(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = []
    for (doc, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = (piecewise.fingerprint(t.encode()) for t in (text, edited, after))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, piecewise.likeness(a, b),
                    piecewise.likeness(a, c)))
    return sorted(out, key=repr)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghiéñ"), rng.integers(2, 9))) for _ in range(n))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_edit_trial_equals_plain_python(spark, parts):
    rows = [(k * 7, prose(k, k + 1)) for k in range(40)] + [(None, "no id"), (500, None), (501, ""), (502, "x"),
                                                            (503, "long " * 30_000), (504, "ÿ")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = piecewise.edit_trial(docs(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(tuple, got), key=repr) == trial(rows)


def test_edit_trial_of_few_and_repeated_rows(spark):
    assert piecewise.edit_trial(docs(spark, [])).count() == 0
    alone = piecewise.edit_trial(docs(spark, [(1, "only one text here")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    twice = piecewise.edit_trial(docs(spark, [(1, "a b c"), (1, "a b c"), (2, "zzz zzz")])).collect()
    assert sorted(r.near_next == 1.0 for r in twice) == [False, False, True]


def test_fingerprints_of_edited_texts_are_near():
    near, far = [], []
    for k in range(60):
        a, b = prose(k, 40 + 37 * k), prose(1000 + k, 300)
        cut = len(a) // 3
        near.append(piecewise.likeness(piecewise.fingerprint(a.encode()),
                                       piecewise.fingerprint((a[:cut] + "changed" + a[cut + 5:]).encode())))
        far.append(piecewise.likeness(piecewise.fingerprint(a.encode()), piecewise.fingerprint(b.encode())))
    assert min(near) > 0.8 and max(far) < 0.2


def test_edit_distance_equals_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
            row = new
        assert piecewise.edit_distance(a, b) == row[-1]


@pytest.mark.parametrize("text", [b"", b"a", b"\x00" * 5000, b"ab" * 70_000, "ÿ".encode() * 3_000, bytes(range(256)) * 9])
def test_fingerprints_of_odd_texts(monkeypatch, text):
    whole = piecewise.fingerprint(text)
    k, *signed = whole.split(":")
    assert len(signed) == piecewise.SIZES and len(signed[0]) <= 2 * piecewise.PIECES
    monkeypatch.setattr(piecewise, "STEP", 101)  # texts hashed in steps give the same
    assert piecewise.fingerprint(text) == whole and piecewise.likeness(whole, whole) == 1.0


# --- op13 ----------------------------------------------------------------

def searched(rows, wanted, top=50):
    def terms(text):
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(
            r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    found = [(doc, terms(text)) for doc, text in rows]
    found = [(doc, Counter(t), len(t)) for doc, t in found if t]
    big, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, own, _ in found for t in own)
    by_item = {}
    for item, text in wanted:
        by_item.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in by_item.items():
        scores = []
        for doc, tf, n in found:
            m = 100 - 50 + (50 * n * big) // total
            s = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in own if t in tf)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [8192, 16])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    rng = np.random.default_rng(8)
    vocabulary = [f"t{k}" for k in range(150)] + ["Été", "日本", "x_y"]
    chance = 1 / np.arange(1, len(vocabulary) + 1)
    chance /= chance.sum()
    text = lambda n: ", ".join(rng.choice(vocabulary, n, p=chance))
    rows = [(k, text(int(rng.integers(1, 60)))) for k in range(300)] + [
        (None, text(30)), (301, None), (302, ""), (303, " ,; "), (304, "T1 t1"), (304, "T1 t1"), (305, "T1 t1"),
        (306, "t3 " * 50_000)]
    wanted = [(1, text(5)), (2, text(140)), (3, " ".join(vocabulary)), (4, "absent"), (5, None), (6, ""), (7, "T1"),
              (None, "t2 t9"), (8, "t4"), (8, "t5")]
    got = ranked_search.search(docs(spark, rows), items(spark, wanted))
    assert sorted(map(tuple, got.collect()), key=repr) == searched(rows, wanted)


def test_search_in_several_sets_and_of_nothing(spark, monkeypatch):
    rows = [(k, f"a{k % 3} b{k % 5}") for k in range(30)]
    wanted = [(k, f"a{k} b{k} a1") for k in range(6)]
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 60)
    got = ranked_search.search(docs(spark, rows), items(spark, wanted), top=4)
    assert sorted(map(tuple, got.collect()), key=repr) == searched(rows, wanted, 4)
    assert ranked_search.search(docs(spark, []), items(spark, wanted)).count() == 0
    assert ranked_search.search(docs(spark, rows), items(spark, [])).count() == 0


def test_search_leaves_masks_unscored():
    """Documents that match rare terms fill the top; those of the common term alone are never scored."""
    n = 5000
    common, rare = np.arange(n), np.arange(0, n, 50)
    best = ranked_search.Best(50)
    scored = ranked_search.search_block([common, rare], [np.full(n, 3), np.full(len(rare), 1000)], np.arange(n),
                                        np.ones(n, bool), best)
    assert scored <= 150 and best.doc.tolist() == rare[:50].tolist()


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_ranked_search"])
def test_queries_take_tables_without_rows(spark, tmp_path, name):
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
