"""Ranked lexical search by presence-mask grouping.

The documents are tokenised once into a forward index that holds, of each
document, only the terms of the query items.  Every task then takes its
documents in blocks.  In a block each item term is a bit: OR-ing the bits of
the terms into their documents gives each document's mask of matched terms,
and documents with one mask form a group.  A mask's best possible score is the
sum of its terms' best scores in the block.  Masks are evaluated by descending
best score until the next cannot reach the item's worst kept score; the rest
is never scored.  The kept documents of all tasks are merged by rank.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.common import materialize, pick, ship

TOP = 50
BLOCK = 8192             # documents of a block
BLOCK_TERMS = 4_000_000  # entries of a block
ITEM_BYTES = 32_000_000  # terms of a set of items that is searched at once, in bytes
MERGES = 64              # parts in which an item's kept documents are merged first

#: bytes outside terms become spaces, A-Z become a-z; bytes of other scripts stay
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
              for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order, with repeats; null has none."""
    return (text or b"").translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term) rows, once each, of (id, text); rows of one id are one item."""
    ship(items.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, t) for i, text in zip(b["id"], b["text"]) for t in set(terms(text))]
            yield pd.DataFrame(rows, columns=["item", "term"])

    rows = items.select(F.col("id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "item string, term binary").distinct()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every row of (id, text) with a term: all its
    terms with repeats, then those of the vocabulary as numbers, ascending,
    with their occurrences."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        for b in batches:
            out = []
            for doc, text in zip(b["id"], b["text"]):
                found = terms(text)
                if found:
                    own = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                    out.append((doc, len(found), [t for t, _ in own], [c for _, c in own]))
            yield pd.DataFrame(out, columns=["id", "n", "terms", "tfs"])

    rows = docs.select(F.col("id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "id string, n bigint, terms array<int>, tfs array<bigint>").withColumn(
        "id", F.col("id").cast("bigint"))


class Best:
    """The ``top`` best documents of one item so far: highest score first,
    then least id, a null id (``ids`` false) last."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.score, self.doc, self.known = (np.zeros(0, t) for t in (np.int64, np.int64, bool))

    def floor(self) -> int:
        """A score below this cannot enter any more."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        s, d, k = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.known, known)))
        order = np.lexsort((d, ~k, -s))[:self.top]
        order = order[s[order] > 0]
        self.score, self.doc, self.known = s[order], d[order], k[order]


def masks_of(postings: list[np.ndarray], n_docs: int) -> np.ndarray:
    """A row of 64-bit words per document; bit j is set if the document is in
    the j-th posting list."""
    out = np.zeros((n_docs, max(1, -(-len(postings) // 64))), np.uint64)
    for j, at in enumerate(postings):
        out[at, j // 64] |= np.uint64(1 << (j % 64))
    return out


def search_block(postings: list[np.ndarray], scores: list[np.ndarray], doc: np.ndarray, known: np.ndarray,
                 best: Best) -> int:
    """Enter the block's documents into ``best``; ``postings`` and ``scores``
    are, per item term, the ascending rows that hold it and the term's score
    there.  Returns the number of documents scored."""
    masks = masks_of(postings, len(doc))
    hit = np.flatnonzero(masks.any(1))
    if not len(hit):
        return 0
    word = masks[hit]
    key = word[:, 0] if word.shape[1] == 1 else np.ascontiguousarray(word).view(f"V{8 * word.shape[1]}").ravel()
    distinct, group = np.unique(key, return_inverse=True)
    distinct = np.ascontiguousarray(distinct).view(np.uint64).reshape(len(distinct), -1)
    bound = np.zeros(len(distinct), np.int64)
    for j, s in enumerate(scores):
        if len(s):
            bound += ((distinct[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64) * int(s.max())
    ranked = np.argsort(-bound, kind="stable")
    place = np.empty(len(ranked), np.int64)
    place[ranked] = np.arange(len(ranked))
    by_mask = np.argsort(place[group], kind="stable")
    rows, bounds = hit[by_mask], bound[group][by_mask]
    done, step = 0, 2 * best.top
    while done < len(rows) and bounds[done] >= best.floor():
        # whole masks, while their bound still reaches the floor
        end = int(np.searchsorted(-bounds, -bounds[min(done + step, len(rows)) - 1], "right"))
        end = min(end, int(np.searchsorted(-bounds, -best.floor(), "right")))
        part = np.sort(rows[done:end])
        total = np.zeros(len(part), np.int64)
        for at, s in zip(postings, scores):
            if len(at):
                k = np.minimum(np.searchsorted(at, part), len(at) - 1)
                total += np.where(at[k] == part, s[k], 0)
        best.add(total, doc[part], known[part])
        done, step = end, 2 * step
    return done


def _search(index: DataFrame, vocabulary: dict[bytes, int], items: list[tuple], weight: np.ndarray, n_docs: int,
            n_terms: int, top: int) -> DataFrame:
    """The kept documents of every task for every item: item, id, score, part."""
    sc = index.sparkSession.sparkContext
    shared = sc.broadcast((items, weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, w = shared.value
        best = [Best(top) for _ in wanted]

        def block(x: pd.DataFrame) -> None:
            doc, n = x["id"], x["n"].to_numpy(np.int64)
            known = doc.notna().to_numpy()
            ids = doc.fillna("0").astype("int64").to_numpy()
            sizes = x["terms"].map(len).to_numpy()
            if not sizes.sum():
                return
            row = np.repeat(np.arange(len(x)), sizes)
            term = np.concatenate(x["terms"].to_list()).astype(np.int64)
            tf = np.concatenate(x["tfs"].to_list()).astype(np.int64)
            m = 50 + (50 * n * n_docs) // n_terms
            score = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
            order = np.argsort(term, kind="stable")  # rows stay ascending within a term
            term, row, score = term[order], row[order], score[order]
            at = np.searchsorted(term, np.arange(len(w) + 1))
            for (_, own), kept in zip(wanted, best):
                search_block([row[at[t]:at[t + 1]] for t in own], [score[at[t]:at[t + 1]] for t in own], ids, known,
                             kept)

        held: list[pd.DataFrame] = []
        size = entries = 0
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo:lo + 1024]
                held.append(part)
                size += len(part)
                entries += int(part["terms"].map(len).sum())
                if size >= BLOCK or entries >= BLOCK_TERMS:
                    block(pd.concat(held, ignore_index=True))
                    held, size, entries = [], 0, 0
        if held:
            block(pd.concat(held, ignore_index=True))
        part = TaskContext.get().partitionId()
        for lo in range(0, len(wanted), 256):
            rows = [(item, str(d) if k else None, s, part) for (item, _), kept in zip(wanted[lo:lo + 256],
                    best[lo:lo + 256]) for s, d, k in zip(kept.score.tolist(), kept.doc.tolist(), kept.known.tolist())]
            yield pd.DataFrame(rows, columns=["item", "id", "score", "part"])

    rows = index.select(F.col("id").cast("string").alias("id"), "n", "terms", "tfs")
    return rows.mapInPandas(run, "item string, id string, score bigint, part bigint").withColumn(
        "id", F.col("id").cast("bigint"))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, id, score): the ``top`` best documents with a score above 0 of every item.

    Null and empty texts have no term: such documents count nowhere, such
    items get no row.  Repeated rows of a document each count and rank;
    repeated rows of an item id (null too) are one item with the terms of all.
    Equal scores rank by ascending id, null ids last.  Texts are read whole.
    Other columns are not read.  Items are searched in sets with terms of
    about ITEM_BYTES, so what is broadcast is bounded; each set reads the
    documents once."""
    spark = docs.sparkSession
    docs = pick(docs, id=id_col, text=text_col)
    wanted = materialize(item_terms(pick(items, id=item_col, text=item_text_col)), "search-items")
    sets = 1 + (wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) // ITEM_BYTES
    kept = None
    for k in range(sets):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(sets)) == k).collect()
        by_item: dict[str | None, list[bytes]] = {}
        for item, term in own:
            by_item.setdefault(item, []).append(bytes(term))
        vocabulary = {t: i for i, t in enumerate(sorted({t for ts in by_item.values() for t in ts}))}
        index = materialize(forward_index(docs, vocabulary), "search-index")
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        weight = np.zeros(len(vocabulary), np.int64)
        for term, df in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        query = [(i, sorted(vocabulary[t] for t in ts)) for i, ts in by_item.items()]
        found = _search(index, vocabulary, query, weight, n_docs, n_terms or 1, top)
        kept = found if kept is None else kept.unionByName(found)
    kept = materialize(kept, "search-kept")
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    first = Window.partitionBy("item", F.pmod("part", F.lit(MERGES))).orderBy(*best)
    last = Window.partitionBy("item").orderBy(*best)
    merged = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    merged = merged.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return merged.select(F.col("item").cast(dict(items.dtypes)[item_col]).alias("item"), "rank", "id", "score")
