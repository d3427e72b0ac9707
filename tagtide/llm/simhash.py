"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint emits every variant within half the radius (2 of 4 bits: 2,081
variants).  Two fingerprints at most 4 bits apart meet at a variant, and two
that meet are at most 4 bits apart.  The variants are shuffled by their
leading ``shard_bits``: of the 2,081 variants only those with another head go
to another shard, so one fingerprint crosses the shuffle 1 + b + b(b-1)/2
times and each shard writes out the tails itself, sorts, deduplicates and
verifies what meets there.  A variant links its least fingerprint with the
others that meet there: linear in the variants, never all pairs of a group.
A shard with far more variants than usual (a family of texts whose
fingerprints share their head) is dealt again by its next bits, the same
emission one level down, until no shard is over its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import ids_as_text, materialize, pick, ship
from tagtide.llm.components import components

#: fixed values of the contract
SHINGLE, MAX_BITS, SEED = 4, 4, 42
SHARD, MIN_SHARD_BITS = 4096, 12  # a shard's own fingerprints; fewest head bits that name a shard
HOT, MORE_BITS, LAST_BITS = 1 << 24, 8, 16  # variants of a shard that is dealt again, by how many bits, down to which tail


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the shingles, repeats included; 0 without words.
    bytes.lower and bytes.split touch ASCII only: A-Z, and the characters
    \\x20 and \\x09-\\x0D."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, 32768):
        h = np.fromiter((digest(b" ".join(words[i:i + shingle]), seed) for i in range(lo, min(n, lo + 32768))),
                        np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)
    return int(bits[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row of (id, text); fp is the fingerprint's 64 bits as a bigint."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fp})

    return docs.select(ids_as_text("id"), F.col("text").cast("binary").alias("text")).mapInPandas(
        run, "id string, fp bigint").withColumn("id", F.col("id").cast("bigint"))


def _masks(bits: range, flips: int) -> np.ndarray:
    """XOR masks that flip exactly ``flips`` of the given bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(bits, flips)], np.uint64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values in a sorted array, and the end."""
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def shard_links(fps: np.ndarray, flips: np.ndarray, tail_bits: int, radius: int, max_bits: int,
                block: int = 1 << 22) -> np.ndarray:
    """Links within one shard: fingerprints that came with ``flips`` bits of
    their head flipped write out their tails within the rest of the radius;
    the least fingerprint at a variant links with the others there.  Tails
    are dealt over passes by a hash of the variant, so memory is bounded."""
    masks = [np.concatenate([_masks(range(tail_bits), k) for k in range(radius - f + 1)]) for f in range(radius + 1)]
    total = sum(int((flips == f).sum()) * len(masks[f]) for f in range(radius + 1))
    passes = max(1, -(-total // block))
    low = np.uint64((1 << tail_bits) - 1)
    found = []
    for p in range(passes):
        variants, owners = [], []
        for f in range(radius + 1):
            own = np.flatnonzero(flips == f)
            step = max(1, block // len(masks[f]))
            for lo in range(0, len(own), step):
                idx = own[lo:lo + step]
                v = ((fps[idx] & low)[:, None] ^ masks[f][None, :]).ravel()
                o = np.repeat(idx.astype(np.int32), len(masks[f]))
                if passes > 1:
                    keep = (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                    keep = keep % np.uint64(passes) == np.uint64(p)
                    v, o = v[keep], o[keep]
                variants.append(v)
                owners.append(o)
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        starts = _runs(v)
        sizes = np.diff(starts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        meet = sizes[group] > 1
        if not meet.any():
            continue
        o, group = o[meet], group[meet]
        value = fps[o]
        starts = _runs(group)[:-1]
        least = np.repeat(np.minimum.reduceat(value, starts), np.diff(np.r_[starts, len(value)]))
        apart = least ^ value
        near = np.unpackbits(apart.view(np.uint8).reshape(-1, 8), axis=1).sum(1) <= max_bits
        pairs = np.stack([value[near], least[near]], 1)
        found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)


def _ball(bits: int, radius: int) -> int:
    """Number of variants of ``bits`` bits within the radius."""
    return sum(comb(bits, k) for k in range(radius + 1))


def _emit(fp: np.ndarray, prefix: np.ndarray, flips: np.ndarray, depth: int, bits: int, radius: int) -> tuple:
    """(fp, prefix, flips) one level down: the next ``bits`` bits behind
    ``depth`` with every change that the rest of the radius allows."""
    own = (fp << np.uint64(depth)) >> np.uint64(64 - bits)
    out = []
    for f in range(radius + 1):
        here = flips == f
        for k in range(radius - f + 1):
            mask = _masks(range(bits), k)
            head = (prefix[here] << np.uint64(bits) | own[here])[:, None] ^ mask[None, :]
            out.append((np.repeat(fp[here], len(mask)), head.ravel(), np.full(head.size, f + k, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _shards(fp: np.ndarray, levels: list[tuple[int, np.ndarray]], shard_bits: int, radius: int) -> Iterator[tuple]:
    """(depth, fp, prefix, flips) of every shard that the fingerprints go to.
    ``levels`` are (depth, sorted prefixes of the shards of that depth that
    are dealt again)."""
    rows = _emit(fp, np.zeros(len(fp), np.uint64), np.zeros(len(fp), np.int8), 0, shard_bits, radius)
    depth = shard_bits
    for at, hot in levels:
        again = np.isin(rows[1], hot)
        yield (at, *(x[~again] for x in rows))
        rows = _emit(*(x[again] for x in rows), at, MORE_BITS, radius)
        depth = at + MORE_BITS
    yield (depth, *rows)


def _hot_levels(fps: DataFrame, shard_bits: int, radius: int, hot: int) -> list[tuple[int, np.ndarray]]:
    """The levels' shards of over ``hot`` variants, counted in Spark.  Only
    the numbers of such shards reach the driver: each stands for ``hot`` of
    the variants, at most one for some thousands of fingerprints."""
    levels: list[tuple[int, np.ndarray]] = []
    depth = shard_bits
    while 64 - depth > LAST_BITS:
        weight = np.array([_ball(64 - depth, radius - f) for f in range(radius + 1)], np.int64)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo in range(0, len(b), 4096):
                    fp = b["fp"].to_numpy(np.int64)[lo:lo + 4096].view(np.uint64)
                    *_, (_, _, prefix, flips) = _shards(fp, levels, shard_bits, radius)
                    shard, at = np.unique(prefix, return_inverse=True)
                    n = np.zeros(len(shard), np.int64)
                    np.add.at(n, at, weight[flips])
                    yield pd.DataFrame({"shard": shard.view(np.int64), "n": n})

        found = (fps.select("fp").mapInPandas(count, "shard bigint, n bigint").groupBy("shard")
                 .agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("shard").collect())
        if not found:
            break
        levels.append((depth, np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))))
        depth += MORE_BITS
    return levels


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, shard_bits: int | None = None,
                      hot: int = HOT) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) at most
    ``max_bits`` apart, an even number: half of it is the balls' radius.
    ``shard_bits`` sets the number of shards, not the links; by default it
    follows the number of fingerprints, so that a shard has about SHARD of its
    own.  A shard of over ``hot`` variants is dealt again by its next bits:
    the same links, from more and smaller shards."""
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even: two balls of one radius meet at an even distance")
    ship(fps.sparkSession)
    if shard_bits is None:
        shard_bits = max(MIN_SHARD_BITS, (fps.count() // SHARD).bit_length())
    radius = (max_bits + 1) // 2
    levels = _hot_levels(fps, shard_bits, radius, hot)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 4096):
                fp = b["fp"].to_numpy(np.int64)[lo:lo + 4096].view(np.uint64)
                for depth, own, prefix, flips in _shards(fp, levels, shard_bits, radius):
                    yield pd.DataFrame({"depth": np.full(len(own), depth, np.int8), "shard": prefix.view(np.int64),
                                        "fp": own.view(np.int64), "flips": flips})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = lambda part: (part["depth"].iloc[0], part["shard"].iloc[0])

        def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
            x = pd.concat(parts)
            pairs = shard_links(x["fp"].to_numpy(np.int64).view(np.uint64), x["flips"].to_numpy(),
                                64 - int(x["depth"].iloc[0]), radius, max_bits)
            return pd.DataFrame({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)})

        for b in batches:  # rows of a shard stand together
            depth, shard = b["depth"].to_numpy(), b["shard"].to_numpy()
            turns = np.flatnonzero((depth[1:] != depth[:-1]) | (shard[1:] != shard[:-1])) + 1
            for lo, hi in zip(np.r_[0, turns], np.r_[turns, len(b)]):
                part = b.iloc[lo:hi]
                if not len(part):
                    continue
                if held and key(held[-1]) != key(part):
                    yield done(held)
                    held = []
                held.append(part)
        if held:
            yield done(held)

    shards = fps.select("fp").mapInPandas(emit, "depth tinyint, shard bigint, fp bigint, flips tinyint")
    return (shards.repartition("depth", "shard").sortWithinPartitions("depth", "shard")
            .mapInPandas(link, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, shard_bits: int | None = None) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least id reachable over links of at most ``max_bits``
    differing bits; equal fingerprints are linked.  A null or empty text has
    fingerprint zero and links like any other.  Repeated rows of an id each
    get a row, and their fingerprints belong together as one document's.  A
    row with a null id keeps its fingerprint, gets a null component and links
    nothing.  Other columns are not read."""
    fps = materialize(fingerprints(pick(docs, id=id_col, text=text_col), shingle), "simhash")
    classes = fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    classes = materialize(classes, "simhash-classes")
    links = fingerprint_links(classes, max_bits, shard_bits)
    rep = lambda side: classes.select(F.col("fp").alias(f"{side}_fp"), F.col("rep").alias(f"{side}_rep"))
    edges = (links.join(rep("a"), F.col("a") == F.col("a_fp")).join(rep("b"), F.col("b") == F.col("b_fp"))
             .select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    # an id that stands in several rows ties the classes of its fingerprints
    several = fps.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).where(
        "n > 1 and lo <> hi and id is not null").select("id")
    tied = fps.join(several, "id").join(classes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(edges.union(tied))
    known = classes.join(comp, classes.rep == comp.node, "left").select(
        "fp", F.least(F.coalesce("component", "rep"), F.col("rep")).alias("component_id"))
    joined = fps.join(known, "fp", "left")
    return joined.select(
        F.col("id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
