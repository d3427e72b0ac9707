"""Spelling variant grouping by blocked Gram matrices of letter counts.

Words at most one edit apart have letter counts at most a squared distance of
two apart, lengths at most one apart, and in every class of letters a count at
most one apart.  Words are therefore dealt to blocks by their counts per
letter class (these sum to the length), a block of many words to chunks of
bounded size, and every pair of chunks whose counts one edit can lead from one
to the other is one unit of work: a NumPy product of the two count matrices
gives all squared distances, pairs of one or two are kept and their edit is
verified.  No pair that is not near leaves a task, and no task holds more than
two chunks at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import materialize, pick, ship

#: fixed values of the contract
MIN_LENGTH, MIN_COUNT, RATIO, DAMAGE = 6, 5, 5, 199
LETTERS = r"[A-Za-zÀ-ÿ]"
#: letter classes that name a block, beside all other letters: frequent letters dealt in turn
CLASSES = ("eoiln", "tashr", "dcumf")
CHUNK = 4096        # words of a chunk at most
CHUNK_CHARS = 1 << 18  # code points of a chunk at most, about
TILE = 1024         # rows of a product at a time
SLOTS = 26 + 64     # a-z, and the code points from U+00C0 to U+00FF

_n = len(CLASSES) + 1
#: count changes that one edit can make, a pair of blocks in one direction only: none (a replacement within a class),
#: one more letter of a class, one letter of a class for one of another
STEPS = ([(0,) * _n] + [tuple(int(k == i) for k in range(_n)) for i in range(_n)]
         + [tuple((k == i) - (k == j) for k in range(_n)) for i in range(_n) for j in range(i + 1, _n)])
KEY = [f"c{k}" for k in range(_n)]


def damaged(run: Column, doc: Column, every: int = DAMAGE) -> Column:
    """The run without its code point h mod length, where h is the crc32 of
    ``doc:run`` and ``every`` divides it; else the run."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of every word of (id, text) with at least ``min_length`` code
    points and ``min_count`` occurrences."""
    found = docs.select("id", F.explode(F.regexp_extract_all(
        F.col("text").cast("string"), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")  # lower() touches A-Z alone only in ASCII text
    capitals = "".join(map(chr, range(65, 91)))
    run = F.when(plain, F.lower("run")).otherwise(F.translate("run", capitals, capitals.lower()))
    word = found.select("id", run.alias("run")).select(damaged(F.col("run"), F.col("id")).alias("word"))
    return (word.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    slot = np.where(codes < 128, codes.astype(np.int64) - 97, codes.astype(np.int64) - 0xC0 + 26)
    at = (slot + np.arange(len(codes))[:, None] * SLOTS).ravel()
    return np.bincount(at, minlength=len(codes) * SLOTS).reshape(-1, SLOTS)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row k of ``b`` is row k of ``a`` with exactly one code point
    replaced or, where its rows are longer by one, inserted."""
    size = a.shape[1]
    if size == b.shape[1]:
        return (a != b).sum(1) == 1
    head, tail = a == b[:, :size], a == b[:, 1:]
    prefix = np.where(head.all(1), size, np.argmin(head, 1))
    suffix = np.where(tail.all(1), size, np.argmin(tail[:, ::-1], 1))
    return prefix + suffix >= size


def near_pairs(left: list[str], right: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the words one edit apart; words of ``left`` have one
    length, those of ``right`` that length or one more.  Without ``right``,
    the pairs within ``left``, i < j."""
    a = _codes(left)
    b = a if right is None else _codes(right)
    ca = _letter_counts(a)
    cb = ca if right is None else _letter_counts(b)
    exact = np.float32 if b.shape[1] < 2000 else np.float64  # squares of the counts stay whole numbers in it
    used = np.flatnonzero(ca.any(0) | cb.any(0))
    ca, cb = ca[:, used].astype(exact), cb[:, used].astype(exact)
    ones = lambda x: np.ones((len(x), 1), exact)
    # one product gives |x|^2 + |y|^2 - 2 x.y
    x = np.hstack([-2 * ca, (ca * ca).sum(1, keepdims=True), ones(ca)])
    y = np.hstack([cb, ones(cb), (cb * cb).sum(1, keepdims=True)]).T.copy()
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(a), TILE):
        first = 0 if right is not None else lo
        d = x[lo:lo + TILE] @ y[:, first:]
        i, j = np.divmod(np.flatnonzero((d < 2.5) & (d > 0.5)), d.shape[1])
        i, j = i + lo, j + first
        if right is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 18):
            p, q = i[k:k + (1 << 18)], j[k:k + (1 << 18)]
            same = one_edit(a[p], b[q])
            out_i.append(p[same])
            out_j.append(q[same])
    return np.concatenate(out_i), np.concatenate(out_j)


def _chunk_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, alone, left key and chunk, right key and chunk) for all chunks that one
    edit can connect, every two chunks once; and the blocks with their number of chunks."""
    chars = F.greatest(F.lit(1), F.lit(CHUNK_CHARS) / F.greatest(sum(F.col(k) for k in KEY), F.lit(1)))
    blocks = words.groupBy(*KEY).agg(F.count("*").alias("size")).select(
        *KEY, F.ceil(F.col("size") / F.least(F.lit(CHUNK), chars)).cast("int").alias("chunks"))
    blocks = materialize(blocks, "spelling-blocks")
    steps = F.array(*[F.struct(F.lit(k).alias("step"), *[F.lit(d).alias(c) for c, d in zip(KEY, s)])
                      for k, s in enumerate(STEPS)])
    left = blocks.select(*[F.col(c).alias(f"l_{c}") for c in KEY], F.col("chunks").alias("l_chunks"),
                         F.explode(steps).alias("by"))
    right = blocks.select(*[F.col(c).alias(f"r_{c}") for c in KEY], F.col("chunks").alias("r_chunks"))
    met = left.join(right, [F.col(f"l_{c}") + F.col(f"by.{c}") == F.col(f"r_{c}") for c in KEY])
    pairs = met.withColumn("l_chunk", F.explode(F.sequence(F.lit(0), F.col("l_chunks") - 1)))
    own = F.col("by.step") == 0
    pairs = pairs.withColumn("r_chunk", F.explode(F.sequence(F.when(own, F.col("l_chunk")).otherwise(0),
                                                             F.col("r_chunks") - 1)))
    pairs = pairs.withColumn("alone", own & (F.col("l_chunk") == F.col("r_chunk")))
    names = [f"{s}_{c}" for s in "lr" for c in [*KEY, "chunk"]]
    pairs = pairs.select(F.monotonically_increasing_id().alias("pair"), "alone", *names)
    return materialize(pairs, "spelling-pairs"), blocks


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n), in both directions, for all words of (word, n)
    that are exactly one inserted, deleted or replaced code point apart."""
    ship(words.sparkSession)
    count = [F.length(F.regexp_replace("word", f"[^{letters}]", "")) for letters in CLASSES]
    keyed = words.select("word", "n", *[c.alias(k) for c, k in zip(count, KEY)])
    keyed = keyed.withColumn(KEY[-1], F.length("word") - sum(F.col(k) for k in KEY[:-1]))
    pairs, blocks = _chunk_pairs(keyed)
    keyed = keyed.join(blocks, KEY).withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    keyed = materialize(keyed.select("word", "n", *KEY, "chunk"), "spelling-words")

    def side(name: str, wanted: DataFrame, mark: int) -> DataFrame:
        at = wanted.select("pair", *[F.col(f"{name}_{c}").alias(c) for c in [*KEY, "chunk"]])
        return keyed.join(at, [*KEY, "chunk"]).select("pair", F.lit(mark).alias("side"), "word", "n")

    dealt = side("l", pairs, 0).unionByName(side("r", pairs.where(~F.col("alone")), 1))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # parts of the pair at hand
        done: list[tuple] = []
        now = None

        def meet() -> None:
            word, n, mark = held[0] if len(held) == 1 else map(np.concatenate, zip(*held))
            cut = int(np.searchsorted(mark, 1))
            whole = cut == len(word)
            if not cut or len(word) < 2:
                return
            i, j = near_pairs(word[:cut].tolist(), None if whole else word[cut:].tolist())
            if len(i):
                j = j if whole else j + cut
                done.append((word[i], word[j], n[j]))
                done.append((word[j], word[i], n[i]))

        def rows() -> pd.DataFrame:
            word, near, n = (np.concatenate(c) for c in zip(*done))
            done.clear()
            return pd.DataFrame({"word": word, "near": near, "near_n": n})

        for b in batches:  # rows of a pair stand together, its left side first
            pair, word = b["pair"].to_numpy(), b["word"].to_numpy(object)
            n, mark = b["n"].to_numpy(np.int64), b["side"].to_numpy()
            cut = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True]) if len(pair) else []
            for lo, hi in zip(cut[:-1], cut[1:]):
                if pair[lo] != now and held:
                    meet()
                    held.clear()
                now = pair[lo]
                held.append((word[lo:hi], n[lo:hi], mark[lo:hi]))
            if done:
                yield rows()
        if held:
            meet()
        if done:
            yield rows()

    return (dealt.repartition(F.col("pair")).sortWithinPartitions("pair", "side")
            .mapInPandas(compare, "word string, near string, near_n bigint"))


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, where no
    chain has more than ``hops`` links.  Each round doubles the links taken."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, hops))))):
        out = materialize(out, "spelling-roots")
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("later"))
        out = out.join(onward, "root", "left").select("word", F.coalesce("later", "root").alias("root"))
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """One row per word of the corpus: word, form, root, n, n_near, form_n.

    A null or empty text has no words; a null id is written as an empty text
    where runs are chosen for damage.  Repeated rows count each.  Texts are
    read whole, whatever their length.  Of near words with the same count the
    first in code-point order is the form.  No words: no rows.  Other columns
    are not read."""
    words = materialize(word_counts(pick(docs, id=id_col, text=text_col), min_length, min_count), "spelling-counts")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    chosen = words.join(best, "word", "left").select("word", "n", "n_near", F.col("best.near").alias("near"),
                                                     (-F.col("best.minus")).alias("near_n"))
    usual = F.col("near_n") >= ratio * F.col("n")
    chosen = materialize(chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                       F.when(usual, F.col("near")).alias("form"),
                                       F.when(usual, F.col("near_n")).alias("form_n")), "spelling-forms")
    # a form occurs at least ratio times as often as its word, which bounds the links of a chain
    most = words.agg(F.max("n")).first()[0] or min_count
    hops = 1 + int(math.log(max(1, most / min_count)) / math.log(ratio) + 1e-9)
    found = roots(chosen.where("form is not null"), hops)
    return chosen.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                     "n_near", "form_n")
