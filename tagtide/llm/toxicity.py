"""Toxic spans by a linear-chain conditional random field.

Token labels come from the document labels: over all learning documents, the
hashed forms of a token (the word and its prefixes) are counted in toxic and
in clean documents, and a token of a toxic document is labelled toxic if its
most specific form that enough documents hold is much commoner among toxic
ones.  The field (two states;
emissions from hashed word forms, transitions) is fitted on a bounded sample:
each learner climbs the likelihood of its share with AdaGrad over
forward-backward marginals, and the weights are averaged.  A document's score
is a logistic function of its largest marginal and its expected number of
toxic tokens, fitted on the part of the sample that no learner saw.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import held_out, ids_as_text, materialize, pick, ship

BITS = 18
PREFIXES = (8, 7, 6, 5, 4, 3)
PER_CLASS = 2000   # bound of the fitting sample: documents per label, in expectation
LEARNERS = 6
STEPS = 30
SEGMENT = 128      # tokens of a chain that are worked through at once; messages join the parts
THRESHOLD = 0.3    # fixed value of the contract
_TOKEN = re.compile(r"\w+|\n")
_MASK = (1 << BITS) - 1
_CACHE = 300_000


def forms(word: str) -> list[int]:
    """Hash buckets of a token's forms, the most specific first: the word, its
    prefixes.  A prefix longer than the word repeats the word's own bucket."""
    w = word.lower()
    whole = crc32(("=" + w).encode("utf-8", "replace")) & _MASK
    return [whole, *[crc32(f"{n}<{w[:n]}".encode("utf-8", "replace")) & _MASK if len(w) > n else whole
                     for n in PREFIXES]]


def suffix(word: str) -> int:
    return crc32((">" + word.lower()[-3:]).encode("utf-8", "replace")) & _MASK


@dataclass
class Field:
    """bias + emission weights of the toxic state against the other; transition scores."""
    emit: np.ndarray
    bias: float
    trans: np.ndarray
    doc: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 0.0]))
    cache: dict = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.cache]
        if new:
            if len(self.cache) > _CACHE:
                self.cache.clear()
                new = list(set(words))
            f = np.array([[*forms(w), suffix(w)] for w in new])
            self.cache.update(zip(new, (self.emit[f].sum(1) + self.bias).tolist()))
        return np.fromiter(map(self.cache.__getitem__, words), float, len(words))


def _messages(e: np.ndarray, t: np.ndarray, first: np.ndarray, size: np.ndarray, rank: np.ndarray,
              last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into every part of a chain from the parts before it and from
    those behind it.  Every part is one 2x2 matrix, the product of its steps."""
    into, out = np.ones((len(first), 2)), np.ones((len(first), 2))
    of = np.flatnonzero((rank > 0) | ~last)  # parts of chains that have several
    of = of[np.argsort(-size[of], kind="stable")]
    m = np.broadcast_to(np.eye(2), (len(of), 2, 2)).copy()
    for k in range(int(size[of].max(initial=0))):
        n = int(np.searchsorted(-size[of], -k, side="left"))
        x = m[:n] @ t
        if k == 0:
            x[rank[of[:n]] == 0] = np.eye(2)  # nothing leads into a chain
        x = x * e[first[of[:n]] + k][:, None, :]
        m[:n] = x / x.sum((1, 2), keepdims=True)
    through = np.zeros((len(first), 2, 2))
    through[of] = m
    for r in range(1, int(rank.max(initial=0)) + 1):
        at = np.flatnonzero(rank == r)
        x = (into[at - 1][:, None, :] @ through[at - 1])[:, 0]
        into[at] = x / x.sum(1, keepdims=True)
    for r in range(int(rank.max(initial=0)) - 1, -1, -1):
        at = np.flatnonzero((rank == r) & ~last)
        x = (through[at + 1] @ out[at + 1][:, :, None])[:, :, 0]
        out[at] = x / x.sum(1, keepdims=True)
    return into, out


def marginals(score: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.  ``score``: emissions of the
    toxic state, chain after chain; ``start``: where each chain starts, and the
    end.  Returns the toxic marginal of each token and the summed 2x2
    transition marginals.

    All chains are stepped through together, in parts of SEGMENT tokens, so
    that a long chain does not make many steps for itself alone; the parts of a
    chain hand each other their messages, so the result is that of the whole."""
    whole = np.diff(start)
    parts = -(-whole // SEGMENT)
    chain = np.repeat(np.arange(len(whole)), parts)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.asarray(start)[:-1][chain] + rank * SEGMENT
    size = np.minimum(whole[chain] - rank * SEGMENT, SEGMENT)
    n, t = len(score), np.exp(trans - trans.max())
    e = np.ones((n, 2))
    e[:, 1] = np.exp(np.clip(score, -40, 40))
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    pairs = np.zeros((2, 2))
    goes_on = rank > 0
    if goes_on.any():
        into, out = _messages(e, t, first, size, rank, rank == parts[chain] - 1)
        beta[first + size - 1] = out
    joints = first[goes_on]
    order = np.argsort(-size, kind="stable")
    first, size, goes_on = first[order], size[order], goes_on[order]
    live = [int(np.searchsorted(-size, -k, side="left")) for k in range(int(size.max(initial=0)) + 1)]  # parts longer than k
    for k in range(len(live) - 1):
        at = first[:live[k]] + k
        a = e[at] if k == 0 else (alpha[at - 1] @ t) * e[at]
        if k == 0 and len(joints):
            a = np.where(goes_on[:, None], into[order] @ t, 1.0) * a
        alpha[at] = a / a.sum(1, keepdims=True)

    def steps(at: np.ndarray) -> np.ndarray:
        x = alpha[at - 1][:, :, None] * t[None] * (e[at] * beta[at])[:, None, :]
        return (x / x.sum((1, 2), keepdims=True)).sum(0)

    for k in range(len(live) - 2, 0, -1):
        at = first[:live[k]] + k
        b = (e[at] * beta[at]) @ t.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
        pairs += steps(at)
    if len(joints):
        pairs += steps(joints)
    m = alpha * beta
    return m[:, 1] / m.sum(1), pairs


def chains(text: str | None) -> tuple[list[str], list[int], list[int]]:
    """Words, their offsets in code points, and the starts of the chains: a chain is a line."""
    words, offsets, starts, fresh = [], [], [], True
    for m in _TOKEN.finditer(text or ""):
        w = m.group()
        if w == "\n":
            fresh = True
            continue
        if fresh:
            starts.append(len(words))
            fresh = False
        words.append(w)
        offsets.append(m.start())
    return words, offsets, starts


def associations(learn: DataFrame) -> np.ndarray:
    """(2, buckets): clean and toxic documents that hold each word form, over all rows of (text, toxic)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = np.zeros((2, 1 << BITS), np.int64), {}
        total = [0, 0]
        for b in batches:
            for text, y in zip(b["text"], b["toxic"]):
                words = {w.lower() for w in _TOKEN.findall(text or "")}
                if len(seen) > _CACHE:
                    seen.clear()
                hit = [seen[w] if w in seen else seen.setdefault(w, forms(w)) for w in words]
                total[int(y)] += 1
                if hit:
                    n[int(y), np.unique(np.array(hit))] += 1
        hot = np.flatnonzero(n.any(0))
        yield pd.DataFrame({"bucket": np.r_[-1, hot], "clean": np.r_[total[0], n[0, hot]],
                            "toxic": np.r_[total[1], n[1, hot]]})

    rows = learn.select("text", "toxic").mapInPandas(run, "bucket bigint, clean bigint, toxic bigint").groupBy(
        "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # <= 2^BITS + 1 rows
    out = np.zeros((2, (1 << BITS) + 1), np.int64)
    out[:, rows.bucket.to_numpy()] = rows[["clean", "toxic"]].to_numpy().T  # bucket -1: the documents, at the end
    return out


def toxic_forms(counts: np.ndarray, min_docs: int = 5, ratio: float = 25.0) -> np.ndarray:
    """By bucket: 1 much commoner among toxic documents, -1 not, 0 too rare to tell."""
    clean, toxic = counts[0, -1] + 1, counts[1, -1] + 1
    lift = ((counts[1, :-1] + 0.5) / toxic) / ((counts[0, :-1] + 0.5) / clean)
    return np.where(counts[:, :-1].sum(0) < min_docs, 0, np.where(lift >= ratio, 1, -1)).astype(np.int8)


def _marked(forms_of: np.ndarray, verdict: np.ndarray) -> np.ndarray:
    """Whether the most specific form with a verdict is a toxic one."""
    v = verdict[forms_of]
    return v[np.arange(len(v)), (v != 0).argmax(1)] == 1


def train_field(texts: list[str], labels: list[int], marked: np.ndarray, steps: int = STEPS) -> Field:
    """AdaGrad on the whole share: word forms are looked up once per distinct word."""
    words, starts, y = [], [], []
    for text, toxic in zip(texts, labels):
        w, _, s = chains(text)
        starts += [len(words) + i for i in s]
        words += w
        y += [toxic] * len(w)
    f = Field(np.zeros(1 << BITS), -4.0, np.zeros((2, 2)))
    if not words:
        return f
    vocab, at = np.unique(np.array(words, dtype=object), return_inverse=True)
    feats = np.array([[*forms(w), suffix(w)] for w in vocab])
    gold = (_marked(feats[:, :-1], marked)[at] & (np.array(y) == 1)).astype(float)
    start = np.array([*starts, len(words)])
    inside = np.ones(len(words), bool)
    inside[start[:-1]] = False
    prev = np.flatnonzero(inside)
    truth = np.zeros((2, 2))
    np.add.at(truth, (gold[prev - 1].astype(int), gold[prev].astype(int)), 1)
    he, hb, ht = np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(steps):
        p, pairs = marginals((f.emit[feats].sum(1) + f.bias)[at], start, f.trans)
        per_word = np.bincount(at, weights=p - gold, minlength=len(vocab))
        g = np.bincount(feats.ravel(), weights=np.repeat(per_word, feats.shape[1]), minlength=1 << BITS)
        g += 0.1 * f.emit
        gb, gt = per_word.sum(), pairs - truth + 0.1 * f.trans
        he, hb, ht = he + g * g, hb + gb * gb, ht + gt * gt
        f.emit -= 0.5 * g / np.sqrt(he)
        f.bias -= 0.5 * gb / np.sqrt(hb)
        f.trans -= 0.25 * gt / np.sqrt(ht)
    return f


def doc_features(texts: list[str | None], f: Field) -> list[tuple[np.ndarray, list[str], list[int]]]:
    """Token marginals, words and offsets of each text."""
    parsed = [chains(t) for t in texts]
    words = [w for p in parsed for w in p[0]]
    base = np.cumsum([0, *[len(p[0]) for p in parsed]])
    start = np.array([b + s for b, p in zip(base, parsed) for s in p[2]] + [len(words)], np.int64)
    p, _ = marginals(f.emissions(words), start, f.trans) if words else (np.zeros(0), None)
    return [(p[lo:hi], x[0], x[1]) for lo, hi, x in zip(base[:-1], base[1:], parsed)]


def _document(p: np.ndarray) -> tuple[float, float]:
    top = float(np.clip(p.max(initial=0.0), 1e-6, 1 - 1e-6))
    return float(np.log(top / (1 - top))), float(np.log1p(p[p > 0.05].sum()))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, x.T @ (q - y) + 0.1 * w), -2, 2)
    return w


def fit(learn: DataFrame, per_class: int = PER_CLASS, learners: int = LEARNERS) -> Field:
    """Learn from (id, text, toxic) rows, toxic 0 or 1."""
    ship(learn.sparkSession)
    counts = associations(learn)
    marked = toxic_forms(counts)
    clean, toxic = (max(1, int(c)) for c in counts[:, -1])
    draw = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = learn.where(draw(21) < F.when(F.col("toxic") == 1, per_class / toxic).otherwise(per_class / clean)).select(
        "text", "toxic", (draw(23) < 0.25).alias("calibrate"), F.pmod(F.xxhash64("id", F.lit(27)), F.lit(learners)).alias("k"))
    sample = materialize(sample, "toxicity-sample")

    def learner(pdf: pd.DataFrame) -> pd.DataFrame:
        f = train_field(pdf["text"].tolist(), pdf["toxic"].tolist(), marked)
        return pd.DataFrame({"n": [len(pdf)], "emit": [f.emit.astype(np.float32).tobytes()], "bias": [float(f.bias)],
                             "trans": [f.trans.ravel().tolist()]})

    taught = sample.where("not calibrate").groupBy("k").applyInPandas(
        learner, "n bigint, emit binary, bias double, trans array<double>").collect()
    f, n = Field(np.zeros(1 << BITS), 0.0, np.zeros((2, 2))), sum(r["n"] for r in taught)
    for r in taught:
        f.emit += np.frombuffer(r["emit"], np.float32) * (r["n"] / n)
        f.bias += r["bias"] * (r["n"] / n)
        f.trans += np.array(r["trans"]).reshape(2, 2) * (r["n"] / n)
    if not taught:
        f.bias = -4.0

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo:lo + 256]
                x = [_document(p) for p, _, _ in doc_features(part["text"].tolist(), f)]
                yield pd.DataFrame({"a": [v[0] for v in x], "b": [v[1] for v in x], "y": part["toxic"].to_numpy()})

    held = sample.where("calibrate").select("text", "toxic").mapInPandas(judge, "a double, b double, y int").collect()
    y = np.array([r["y"] for r in held], float)
    if len(y) and 0 < y.sum() < len(y):
        f.doc = _logistic(np.array([[1.0, r["a"], r["b"]] for r in held]), y)
        # the sample is balanced, the corpus is not
        f.doc[0] += np.log(toxic / clean) - np.log(y.sum() / (len(y) - y.sum()))
    return f


SCORED = "id string, score double, spans array<struct<start:int,length:int,text:string,p:double>>"


def score(docs: DataFrame, f: Field, span_threshold: float = 0.5) -> DataFrame:
    """(id, score, spans) for every row of (id, text); spans are the runs of
    tokens whose marginal reaches the threshold, as code point offsets."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(f)  # 2^BITS weights

    def spans(text: str, p: np.ndarray, words: list[str], offsets: list[int]) -> list[dict]:
        out, last = [], -2
        for i in np.flatnonzero(p >= span_threshold):
            end = offsets[i] + len(words[i])
            if i == last + 1:
                out[-1]["length"] = end - out[-1]["start"]
                out[-1]["p"] = max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": offsets[i], "length": end - offsets[i], "p": float(p[i])})
            last = i
        for s in out:
            s["text"] = text[s["start"]:s["start"] + s["length"]]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = sent.value
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo:lo + 256]
                got = doc_features(part["text"].tolist(), f)
                z = np.array([f.doc @ np.array([1.0, *_document(p)]) for p, _, _ in got], float)
                yield pd.DataFrame({"id": part["id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30))),
                                    "spans": [spans(t, *g) for t, g in zip(part["text"], got)]})

    return docs.select(ids_as_text("id"), "text").mapInPandas(run, SCORED).withColumn("id", F.col("id").cast("bigint"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", threshold: float = THRESHOLD, **settings: int) -> DataFrame:
    """(id, held_out, score, predicted, spans) for every row of ``docs``.

    Learns from the labelled documents outside the held-out fold; labels other
    than 0 and 1 and null texts teach nothing, and a document that is labelled
    several times counts once, as toxic if any label says so.  A null or empty
    text has no token and gets the score of the least marginal.  Without
    labels every score is low.  Repeated rows get a row each."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint"))
    marks = pick(labels, id=id_col, toxic=label_col).where("toxic in (0, 1)").groupBy(
        F.col("id").cast("bigint").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # labels grow with the corpus: the same join at every size, never a broadcast
    learn = rows.where(~held_out("id") & F.col("text").isNotNull()).join(marks.hint("merge"), "id")
    f = fit(materialize(learn, "toxicity-learn"), **settings)
    return score(rows, f).select("id", held_out("id").alias("held_out"), "score",
                                 (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
