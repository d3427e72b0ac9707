"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the UTF-8 text; where its low ``k``
bits are zero a piece ends, so pieces have about 2^k bytes and an edit moves
only the boundaries next to it.  A piece, with the bytes that the rolling hash
saw before it, is hashed to two base-64 characters of the signature.  ``k`` is
the least block size at which a text has at most 64 pieces; the fingerprint
is ``k`` and the signatures at k, k + 1 and k + 2, so that texts of up to
about four times another's length still share a block size with it.  A text
that repeats itself can go without boundaries for long: a piece also ends
after four times the block size.
Fingerprints are compared where a block size is common to both, by edit
distance of the signatures (insertions and deletions of pieces).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.common import ids_as_text, materialize, pick, ship

WINDOW = 7       # bytes that the rolling hash looks at
PIECES = 64      # pieces of a signature at most, above the largest block size excepted
LONGEST = 4      # block sizes that a piece may be long
LEAST, MOST = 0, 28  # least block size of a fingerprint's first signature and largest, as powers of two
SIZES = 3        # block sizes in a fingerprint
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
CODES = [a + b for a in _ALPHABET for b in _ALPHABET]  # 12 bits of a hash
_MULTIPLIER = 0x2C1B3C6D
_POWERS = [pow(_MULTIPLIER, k + 1, 1 << 32) for k in range(WINDOW)]
STEP = 1 << 20   # bytes that are hashed at once


def _hits(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose rolling hash has ``k`` low zero bits, and the hashes there."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for lo in range(0, len(data), STEP):
        before = min(lo, WINDOW - 1)
        part = data[lo - before:lo + STEP].astype(np.uint32) + np.uint32(1)
        h = part * np.uint32(_POWERS[0])
        for j in range(1, min(WINDOW, len(part))):
            h[j:] += part[:-j] * np.uint32(_POWERS[j])
        h = h[before:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        at = np.flatnonzero((h & np.uint32((1 << k) - 1)) == 0)
        places.append(at + lo)
        hashes.append(h[at])
    return np.concatenate(places), np.concatenate(hashes)


def _cuts(at: list[int], size: int, k: int) -> list[int]:
    """0 and the end of every piece: after each hit, and after LONGEST times
    the block size where there is none for so long."""
    cuts, last, limit = [0], 0, LONGEST << k
    for hit in [*at, size - 1]:
        end = hit + 1
        if end - last > limit:
            cuts.extend(range(last + limit, end, limit))
        if end > last:
            cuts.append(end)
        last = end
    return cuts


def _signature(data: bytes, cuts: list[int]) -> str:
    """Two characters per piece."""
    before, crc = WINDOW - 1, zlib.crc32
    codes = [crc(data[lo - before if lo > before else 0:hi]) & 0xFFF for lo, hi in zip(cuts, cuts[1:])]
    return "".join([CODES[c] for c in codes])


def fingerprint(data: bytes) -> str:
    """Fingerprint of a UTF-8 text, all of it; equal texts have equal ones."""
    raw, size = np.frombuffer(data, np.uint8), len(data)
    k = max(LEAST, (size // PIECES).bit_length() - 3)  # most often below the block size sought
    at, h = _hits(raw, k)
    if k > LEAST and len(at) < PIECES and len(_cuts(at.tolist(), size, k)) <= PIECES + 1:
        k = LEAST
        at, h = _hits(raw, k)
    signed, first = [], k
    while len(signed) < SIZES:
        # more hits than pieces allowed: no need to cut
        cuts = _cuts(at.tolist(), size, k) if len(at) <= PIECES or k >= MOST else None
        if signed or k >= MOST or cuts and len(cuts) <= PIECES + 1:
            first = first if signed else k
            signed.append(_signature(data, cuts))
        k += 1
        keep = (h & np.uint32((1 << k) - 1)) == 0
        at, h = at[keep], h[keep]
    return ":".join([str(first), *signed])


def edit_distance(a: list[str], b: list[str]) -> int:
    """Fewest insertions and deletions that turn ``a`` into ``b``: the lengths
    less twice the longest common subsequence, whose table rows are bits of one integer."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - len(a) + 2 * row.bit_count()


def _alike(a: str, b: str) -> float:
    x, y = ([s[i:i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    return 1 - edit_distance(x, y) / (len(x) + len(y)) if x or y else 1.0


def likeness(a: str, b: str) -> float:
    """0 to 1 for two fingerprints: the better of the block sizes they share,
    0 where they share none; 1 for equal ones."""
    if a == b:
        return 1.0
    (k, *x), (m, *y) = a.split(":"), b.split(":")
    x, y = dict(enumerate(x, int(k))), dict(enumerate(y, int(m)))
    return max((_alike(x[s], y[s]) for s in x if s in y), default=0.0)


def half_replaced(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


ROW = ("id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _compared(doc: str | None, text: str, fp: str, after: str, after_fp: str) -> tuple:
    edited = half_replaced(text, after).encode()
    edited_fp = fingerprint(edited)
    return (doc, len(text), hashlib.sha256(edited).hexdigest(), fp, edited_fp, likeness(fp, edited_fp),
            likeness(fp, after_fp))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row's whole text; a null text is empty, a
    null id stays null, repeated rows each get a row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fingerprint": [fingerprint(t) for t in b["text"]]})

    rows = pick(docs, id=id_col, text=text_col).select(
        ids_as_text("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInPandas(run, "id string, fingerprint string").withColumn("id", F.col("id").cast("bigint"))


def edit_trial(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document and of its edited text, whose last half
    is taken from the next document by ascending id (after the last: the
    first): id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The documents are dealt by ranges of the id, so a document's follower is
    the next row of its task; the last row of a task meets the first of the
    next range in a second step, one row a task.  Null ids come first, rows of
    one id in the order of a hash of their texts, so repeated rows follow one
    another; a single document follows itself.  A null text is empty.  Other
    columns are not read."""
    ship(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col).select(
        F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        first = last = None
        none = (None,) * 3
        for b in batches:
            out = []
            for doc, text in zip(b["id"], b["text"]):
                fp = fingerprint(text.encode())
                if last is None:
                    first = (text, fp)
                else:
                    out.append((*_compared(*last, text, fp), *none))
                last = (doc, text, fp)
            yield pd.DataFrame(out, columns=names)
        if last is not None:  # the edges of this range: its last document, and the first text
            doc, text, fp = last
            yield pd.DataFrame([(doc, len(text), None, fp, None, None, None, part, text, first[0])], columns=names)

    schema = f"{ROW}, part bigint, text string, head string"
    names = [c.split()[0] for c in schema.split(", ")]
    ranged = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    done = materialize(ranged.select(ids_as_text("id"), "text").mapInPandas(run, schema), "piecewise")
    edges = done.where("part is not null")
    # one narrow row a task: which range comes next, the first after the last
    order = Window.orderBy("part")
    after = edges.select("part").withColumn("next", F.lead("part").over(order))
    after = after.withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    heads = edges.select(F.col("part").alias("next"), F.col("head").alias("after"))
    pairs = edges.drop("head").join(after, "part").join(heads, "next")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_compared(doc, text, fp, after, fingerprint(after.encode())) for doc, text, fp, after
                                in zip(b["id"], b["text"], b["fingerprint"], b["after"])],
                               columns=names[:-3])

    tails = pairs.select("id", "text", "fingerprint", "after").mapInPandas(close, ROW)
    return done.where("part is null").select(*names[:-3]).unionByName(tails).withColumn(
        "id", F.col("id").cast("bigint"))
