"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Document frequencies cover every learning document.  The classifier is fitted
on a bounded sample (about ``per_lang`` documents a language, chosen by a hash
of the id): each of ``learners`` tasks runs follow-the-regularised-leader
(McMahan et al., 2013) with L1 and L2 penalties over its share, and the
learners' weights are averaged.  A fifth of the sample is kept out of that and
sets the temperature of the softmax.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import held_out, ids_as_text, materialize, pick, ship

BITS = 16          # n-gram hash bits
ORDERS = (1, 2, 3)
PER_LANG = 2000    # bound of the fitting sample: documents per language, in expectation
LEARNERS = 6
MAX_LANGS = 1000   # distinct labels that a model may have
_CHUNK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash buckets and counts of the whole text's character n-grams, lower
    case, every non-letter a space; None without a letter."""
    if not text:
        return None
    total, any_letter, tail = np.zeros(1 << BITS, np.int64), False, np.zeros(0, np.uint64)
    for lo in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[lo:lo + _CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[codes]
        any_letter = any_letter or bool(letter.any())
        new = np.where(letter, codes, 32).astype(np.uint64)
        c = np.concatenate([tail, new])
        for n in ORDERS:
            first = max(0, len(tail) - n + 1)  # n-grams that end in this chunk
            k = len(c) - n + 1 - first
            if k <= 0:
                continue
            h, seen = np.full(k, n, np.uint64), np.zeros(k, bool)
            for j in range(n):
                part = c[first + j:first + j + k]
                h = (h ^ part) * _MIX
                h ^= h >> np.uint64(29)
                seen |= part != 32
            total += np.bincount((h[seen] >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        tail = c[max(0, len(c) - max(ORDERS) + 1):]
    if not any_letter:
        return None
    idx = np.flatnonzero(total)
    return idx, total[idx]


def _tfidf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    got = ngram_counts(text)
    if got is None:
        return None
    idx, n = got
    x = (1 + np.log(n)) * idf[idx]
    return idx, x / np.sqrt((x * x).sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float, beta: float,
         l1: float, l2: float) -> np.ndarray:
    """Weights (classes, buckets) after ``epochs`` online passes."""
    z, n, w = (np.zeros((classes, 1 << BITS)) for _ in range(3))
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            idx, x, y = rows[r]
            wi, ni, zi = w[:, idx], n[:, idx], z[:, idx]
            p = _softmax(wi @ x)
            p[y] -= 1
            g = p[:, None] * x[None, :]
            root = np.sqrt(ni + g * g)
            zi += g - (root - np.sqrt(ni)) / alpha * wi
            n[:, idx], z[:, idx] = ni + g * g, zi
            w[:, idx] = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2), 0)
    return w


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets, langs)
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        got = _tfidf(text, self.idf)
        return None if got is None else got[1] @ self.weights[got[0]]

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if self.langs else None
        if z is None:
            return "und", 0.0
        p = _softmax(z / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, max(0.0, p[k])))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with a letter, and how many hold each n-gram bucket, over all rows of (text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for text in b["text"]:
                if (got := ngram_counts(text)) is not None:
                    df[got[0]] += 1
                    n += 1
        hot = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.r_[-1, hot], "n": np.r_[n, df[hot]]})

    rows = docs.select("text").mapInPandas(run, "bucket bigint, n bigint").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()  # at most 2^BITS + 1 rows
    df = np.zeros(1 << BITS, np.int64)
    hot = rows[rows.bucket >= 0]
    df[hot.bucket.to_numpy()] = hot.n.to_numpy()
    return int(rows.loc[rows.bucket < 0, "n"].sum()), df


def fit(learn: DataFrame, per_lang: int = PER_LANG, learners: int = LEARNERS, epochs: int = 3, alpha: float = 2.0,
        beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> Model:
    """Learn from (id, text, lang) rows; null langs and null texts teach nothing."""
    spark = learn.sparkSession
    ship(spark)
    learn = learn.where("lang is not null and text is not null")
    counts = learn.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return Model([], np.zeros(0), np.zeros((0, 0)))
    total, df = document_frequencies(learn)
    idf = np.log((1 + total) / (1 + df)) + 1

    share = spark.createDataFrame([(r["lang"], langs.index(r["lang"]), min(1.0, per_lang / r["count"]))
                                   for r in counts], "lang string, y int, share double")
    draw = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = learn.join(F.broadcast(share), "lang").where(draw(11) < F.col("share")).select(
        "text", "y", (draw(13) < 0.2).alias("calibrate"), F.pmod(F.xxhash64("id", F.lit(17)), F.lit(learners)).alias("k"))
    sample = materialize(sample, "langid-sample")
    k = len(langs)

    def learner(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(*got, int(y)) for text, y in zip(pdf["text"], pdf["y"]) if (got := _tfidf(text, idf)) is not None]
        w = ftrl(rows, k, epochs, alpha, beta, l1, l2).astype(np.float32)
        return pd.DataFrame({"y": range(k), "n": len(rows), "w": [w[i].tobytes() for i in range(k)]})

    taught = sample.where("not calibrate").groupBy("k").applyInPandas(learner, "y int, n bigint, w binary").collect()
    weights, seen = np.zeros((1 << BITS, k)), sum(r["n"] for r in taught if r["y"] == 0)
    for r in taught:
        weights[:, r["y"]] += np.frombuffer(r["w"], np.float32) * (r["n"] / max(1, seen))
    model = Model(langs, idf, weights)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(z.tolist(), y) for text, y in zip(b["text"], b["y"]) if (z := model.logits(text)) is not None]
            yield pd.DataFrame({"z": [g[0] for g in got], "y": [g[1] for g in got]})

    held = sample.where("calibrate").select("text", "y").mapInPandas(judge, "z array<double>, y int").collect()
    if held:
        z, y = np.array([r["z"] for r in held]), np.array([r["y"] for r in held])
        model.temperature = _temperature(z, y)
    return model


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a grid of powers."""
    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return min((2.0 ** (e / 8) for e in range(-48, 25)), key=loss)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(id, lang_pred, score) for every row of (id, text): `und` with score 0
    where the text is null or has no letter, or nothing was learned."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS x languages numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            got = [m.predict(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "lang_pred": [g[0] for g in got],
                                "score": np.array([g[1] for g in got], float)})

    return docs.select(ids_as_text("id"), "text").mapInPandas(run, "id string, lang_pred string, score double").withColumn(
        "id", F.col("id").cast("bigint"))


def keep_identified(docs: DataFrame, model: Model, text_col: str, min_score: float) -> DataFrame:
    """The rows of ``docs`` whose text has a language that scores at least ``min_score``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        m = sent.value
        got = [m.predict(t) for t in texts]
        return pd.Series([lang != "und" and p >= min_score for lang, p in got], dtype=bool)

    return docs.where(known(F.col(f"`{text_col}`").cast("string")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             **settings: float) -> DataFrame:
    """(id, held_out, lang_pred, score): learned on the documents outside the
    held-out fold, applied to every document.  Repeated rows get a row each; a
    null id is not held out; other columns are not read."""
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col).withColumn("id", F.col("id").cast("bigint"))
    model = fit(rows.where(~held_out("id")), **settings)
    return predict(rows, model).select("id", held_out("id").alias("held_out"), "lang_pred", "score")
