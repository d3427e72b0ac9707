"""Embedding near-duplicates by random-hyperplane signs.

Equal vectors of a label form a class first.  Each class vector gets a sign
hash in each of several tables; classes that share a bucket are compared by
exact cosine in double precision, and links go to distributed connected
components.  Small buckets share a matrix product.  A bucket larger than a block is dealt over pairs of blocks, each
a task's matrix product; a pair is counted in the first table where it meets,
so the counts hold every link once and no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import materialize, pick, ship
from tagtide.llm.components import components

THRESHOLD = 0.98   # fixed value of the contract
MISS = 3e-4        # chance that a pair at the threshold meets in no table
MIN_BITS = 14      # 17 tables at a threshold of 0.98
BLOCK = 1024
POOL = 256          # rows of small buckets that share a matrix product
SEED = 42


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def hash_size(n: int, threshold: float, block: int, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits) for n classes: the bits grow with log n, so that a bucket
    of unlike vectors stays about a block, and the tables with the bits, so
    that a pair at the threshold is missed no more often than ``miss``."""
    bits = max(MIN_BITS, (n // block).bit_length())
    meet = (1 - np.arccos(threshold) / np.pi) ** bits
    return int(np.ceil(np.log(miss) / np.log1p(-meet))), bits


def signatures(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """(vectors, tables) sign hashes."""
    on = (x @ planes(x.shape[1], tables, bits, seed) > 0).reshape(len(x), tables, bits)
    return (on * (1 << np.arange(bits))).sum(2).astype(np.int32)


def block_links(rows: pd.DataFrame, bucket: np.ndarray, half: int | None, threshold: float) -> pd.DataFrame:
    """Links within the buckets of ``rows`` (half None), or of the first
    ``half`` rows with the others: rows met by each class, weighted by copies,
    and a spanning forest of the links."""
    x = np.array(rows["x"].tolist(), np.float64)
    cls, sub, copies, table = (rows[c].to_numpy(np.int64) for c in ("cls", "sub", "copies", "tab"))
    if half is None:
        i, j = np.nonzero(x @ x.T >= threshold)
        own = (i < j) & (bucket[i] == bucket[j])
        i, j = i[own], j[own]
    else:
        i, j = np.nonzero(x[:half] @ x[half:].T >= threshold)
        j = j + half
    if len(i) and table.any():  # met in an earlier table already
        sig = np.array(rows["sig"].tolist(), np.int32)
        order = np.arange(sig.shape[1])
        new = np.ones(len(i), bool)
        for lo in range(0, len(i), 1 << 18):
            s = slice(lo, lo + (1 << 18))
            new[s] = ~((sig[i[s]] == sig[j[s]]) & (order < table[i[s], None])).any(1)
        i, j = i[new], j[new]
    met = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    label = np.arange(len(rows))
    while True:  # least label over the links, with pointer jumping
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    linked, counted = np.flatnonzero(label != np.arange(len(rows))), np.flatnonzero(met)
    none = lambda n: pd.array([pd.NA] * n, dtype="Int64")
    counts = pd.DataFrame({"cls": cls[counted], "sub": sub[counted],
                           "n": pd.array(met[counted].astype(np.int64), dtype="Int64"), "other": none(len(counted))})
    forest = pd.DataFrame({"cls": cls[linked], "sub": np.zeros(len(linked), np.int64), "n": none(len(linked)),
                           "other": pd.array(cls[label[linked]], dtype="Int64")})
    return pd.concat([counts, forest], ignore_index=True)


def pooled(edges: np.ndarray, alone: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of whole groups, given the edges of the groups: small
    ones together up to ``rows`` rows; one that is larger, or marked, alone."""
    lo = 0
    for g in range(len(alone)):
        start, end = int(edges[g]), int(edges[g + 1])
        if lo < start and (alone[g] or end - lo > rows):
            yield lo, start
            lo = start
        if alone[g] or end - lo > rows:
            yield lo, end
            lo = end
    if lo < int(edges[-1]):
        yield lo, int(edges[-1])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD, tables: int | None = None, bits: int | None = None,
                    block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    rows without a label and rows without an id link with nothing; the latter
    have a null component and are not kept.  Vectors of different length are
    never compared.  Repeated rows of an id are vectors of their own that
    count as links of each other where they are alike; the rows of an id share a component.  Other columns are not read."""
    ship(vectors.sparkSession)
    rows = pick(vectors, id=id_col, v=vector_col, label=label_col).select(
        F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"),
        F.col("label").cast("string").alias("label"))
    sound = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
             & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("v", lambda x: x != 0))
    rows = materialize(rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws(
        "|", "label", F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",")), 256))), "vectors")
    classes = materialize(rows.where("key is not null").groupBy("key").agg(
        F.min("id").alias("cls"), F.count("*").alias("copies"), F.any_value("v").alias("v"),
        F.any_value("label").alias("label")).withColumn("sub", F.xxhash64("key")), "vector-classes")

    if tables is None or bits is None:
        auto = hash_size(classes.count(), threshold, block)
        tables, bits = tables or auto[0], bits or auto[1]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["v"].map(len)
            for dim, part in b.groupby(size):
                x = np.array(part["v"].tolist(), np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                yield pd.DataFrame({"label": part["label"], "dim": dim, "cls": part["cls"], "sub": part["sub"],
                                    "copies": part["copies"], "x": list(x), "sig": list(signatures(x, tables, bits, seed))})

    signed = materialize(classes.select("label", "cls", "sub", "copies", "v").mapInPandas(
        hashed, "label string, dim int, cls bigint, sub bigint, copies bigint, x array<double>, sig array<int>"), "signed")
    bucket = ["label", "dim", "tab", "h"]
    met = signed.select("label", "dim", "cls", "sub", F.posexplode("sig").alias("tab", "h"))
    sizes = met.groupBy(*bucket).count().where("count > 1")
    nb = F.ceil(F.col("count") / block).cast("int")
    # a row goes to every pair of blocks that holds its own
    dealt = (met.join(sizes, bucket).withColumn("nb", nb)
             .withColumn("b", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("cls", "sub", *bucket, "b", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2")))
    group = [*bucket, "b1", "b2"]
    dealt = dealt.join(signed.select("cls", "sub", "copies", "x", "sig"), ["cls", "sub"]).repartition(
        *[F.col(c) for c in group]).sortWithinPartitions(*group, "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the group that the next batch may go on with

        def edges(rows: pd.DataFrame) -> np.ndarray:
            keys = [rows[c].to_numpy() for c in group]
            return np.r_[0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1, len(rows)]

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            cut = edges(rows)
            bucket = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            b, b1, b2 = (rows[c].to_numpy() for c in ("b", "b1", "b2"))
            across = (b1 != b2)[cut[:-1]]
            for lo, hi in pooled(cut, across, POOL):
                half = int((b[lo:hi] == b1[lo]).sum()) if b1[lo] != b2[lo] else None
                if hi - lo > 1 and half != hi - lo:
                    yield block_links(rows.iloc[lo:hi], bucket[lo:hi], half, threshold)

        for batch in batches:
            if not len(batch):
                continue
            if held and any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in group):
                yield from done(pd.concat(held, ignore_index=True))
                held = []
            last = int(edges(batch)[-2])
            if last:
                yield from done(pd.concat([*held, batch.iloc[:last]], ignore_index=True))
                held = []
            held.append(batch.iloc[last:])
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    found = materialize(dealt.mapInPandas(compare, "cls bigint, sub bigint, n bigint, other bigint"), "vector-links")
    comp = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    links = found.where("n is not null").groupBy("cls", "sub").agg(F.sum("n").alias("n"))
    per_class = (classes.select("key", "cls", "sub", "copies").join(links, ["cls", "sub"], "left")
                 .join(comp, F.col("cls") == F.col("node"), "left")
                 .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "cls").alias("component_id")))
    out = rows.select("id", "key").join(per_class, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
