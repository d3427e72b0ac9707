"""Lines repeated over many documents, by a sharded minimal perfect hash.

The distinct line hashes (128 bits) are dealt over shards; a shard holds a
minimal perfect hash and, by slot, arrays of a 32-bit fingerprint, the number
of documents and the largest document id.  Documents probe the arrays with
their line hashes: a shard's arrays travel to its probes once for every
``probes_per_task`` of them, and stream past in sorted order, so a line that a
third of the documents hold is dealt over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import materialize, pick, ship
from tagtide.llm.mph import PerfectHash

#: fixed values of the contract
MIN_CHARS, MIN_DOCS = 40, 5
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def _eligible(text: Column, min_chars: int) -> Column:
    """Distinct hashes of a text's keys of at least min_chars code points."""
    keys = F.array_distinct(F.filter(F.transform(_lines(text), line_key), lambda k: F.length(k) >= min_chars))
    return F.transform(keys, _hash)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, h1, h2): one row per document and distinct eligible line key."""
    return docs.where("id is not null").select("id", F.explode(_eligible(F.col("text"), min_chars)).alias("h")).select(
        "id", "h.h1", "h.h2")


def build_index(hashes: DataFrame, n_shards: int) -> DataFrame:
    """(shard, n_probes, mph, fp, n_docs, last): one row per shard."""
    counts = (hashes.distinct().groupBy("h1", "h2")
              .agg(F.count("*").alias("n_docs"), F.max("id").alias("last")))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1 = pdf["h1"].to_numpy(np.int64).view(np.uint64)
        h2 = pdf["h2"].to_numpy(np.int64).view(np.uint64)
        mph = PerfectHash.build(h1, h2)
        slot = mph.slots(h1, h2)
        fp, n, last = np.empty(len(pdf), np.uint32), np.empty(len(pdf), np.uint32), np.empty(len(pdf), np.int64)
        fp[slot], n[slot], last[slot] = h2 >> np.uint64(32), pdf["n_docs"], pdf["last"]
        return pd.DataFrame({"shard": pdf["shard"][:1], "n_probes": [int(pdf["n_docs"].sum())],
                             "mph": [mph.to_bytes()], "fp": [fp.tobytes()], "n_docs": [n.tobytes()],
                             "last": [last.tobytes()]})

    return counts.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(
        build, "shard int, n_probes bigint, mph binary, fp binary, n_docs binary, last binary")


def _shard(n_shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(n_shards)).cast("int")


def probe(index: DataFrame, hashes: DataFrame, n_shards: int, min_docs: int, probes_per_task: int) -> DataFrame:
    """(id, h1, h2) of the probes whose line stands in at least ``min_docs``
    documents, the probing one not being the last of them."""
    copies = index.select("shard", F.ceil(F.col("n_probes") / probes_per_task).cast("int").alias("copies"))
    blobs = index.join(copies, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.lit(0).alias("kind"),
        "mph", "fp", "n_docs", "last", *[F.lit(0).cast("bigint").alias(c) for c in ("id", "h1", "h2")])
    asks = hashes.withColumn("shard", _shard(n_shards)).join(copies, "shard").select(
        "shard", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int").alias("part"), F.lit(1).alias("kind"),
        *[F.lit(None).cast("binary").alias(c) for c in ("mph", "fp", "n_docs", "last")], "id", "h1", "h2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            heads = np.flatnonzero(b["kind"].to_numpy() == 0)
            cuts = [0, *heads[heads > 0], len(b)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = b.iloc[lo:hi]
                if len(part) and part["kind"].iloc[0] == 0:
                    row, part = part.iloc[0], part.iloc[1:]
                    held = (PerfectHash.from_bytes(row["mph"]), np.frombuffer(row["fp"], np.uint32),
                            np.frombuffer(row["n_docs"], np.uint32), np.frombuffer(row["last"], np.int64))
                if not len(part):
                    continue
                mph, fp, n, last = held
                h1 = part["h1"].to_numpy(np.int64)
                h2 = part["h2"].to_numpy(np.int64)
                ids = part["id"].to_numpy(np.int64)
                slot = mph.slots(h1.view(np.uint64), h2.view(np.uint64))
                found = (slot >= 0) & (fp[slot] == (h2.view(np.uint64) >> np.uint64(32)))
                drop = found & (n[slot] >= min_docs) & (last[slot] != ids)
                yield pd.DataFrame({"id": ids[drop], "h1": h1[drop], "h2": h2[drop]})

    return (blobs.unionByName(asks).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
            .mapInPandas(run, "id bigint, h1 bigint, h2 bigint"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                  keys_per_shard: int = 1 << 17, probes_per_task: int = 1 << 18) -> DataFrame:
    """(id, gone): the hashes of the line keys that each document of (id,
    text) loses; documents that lose none have no row."""
    ship(docs.sparkSession)
    hashes = materialize(line_hashes(docs, min_chars), "line-hashes")
    n_shards = max(1, -(-hashes.count() // keys_per_shard))
    index = materialize(build_index(hashes, n_shards), "line-index")
    found = probe(index, hashes, n_shards, min_docs, probes_per_task)
    return found.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def _stays():
    """Of every line of a document, whether its hash is not among the lost
    ones: one sorted look-up for all lines, so that a document of a million
    lines that loses many costs what its lines cost."""
    def run(h1: pd.Series, h2: pd.Series, gone1: pd.Series, gone2: pd.Series) -> pd.Series:
        out = []
        for a1, a2, g1, g2 in zip(h1, h2, gone1, gone2):
            if a1 is None:
                out.append(None)
                continue
            stay = ~np.isin(a1, g1)
            lost = set(zip(g1.tolist(), g2.tolist()))
            for i in np.flatnonzero(~stay):
                stay[i] = (int(a1[i]), int(a2[i])) not in lost
            out.append(stay)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<boolean>")


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, stats: str | None = "line_dedup", **sizes: int) -> DataFrame:
    """The columns of ``docs`` with their text replaced by the lines that stay,
    and a struct ``stats`` (n_lines, n_dropped) behind them, which replaces a
    column of that name; without it the columns of ``docs`` alone.

    A null or empty text is one empty line.  A key counts once per document
    id, however often a document, or a repeated row of it, holds it; the
    largest id that holds a key keeps its lines.  A row with a null id counts
    for no key and loses no line."""
    gone = dropped_lines(pick(docs, id=id_col, text=text_col), min_chars, min_docs, **sizes)
    gone = gone.select(F.col("id").alias("__line_id"), F.col("gone").alias("__line_gone"))
    joined = docs.join(gone, F.col(f"`{id_col}`").cast("bigint") == F.col("__line_id"), "left")
    lines = _lines(F.col(f"`{text_col}`"))

    keys = F.when(F.col("__line_gone").isNotNull(), F.transform(lines, line_key))
    half = lambda h: F.transform(keys, lambda k: _hash(k)[h])
    stays = _stays()(half("h1"), half("h2"), F.col("__line_gone.h1"), F.col("__line_gone.h2"))
    stays = F.transform(F.arrays_zip(keys.alias("k"), stays.alias("s")),
                        lambda z: (F.length(z["k"]) < min_chars) | z["s"])
    left = F.transform(F.filter(F.arrays_zip(lines.alias("l"), stays.alias("s")), lambda z: z["s"]), lambda z: z["l"])
    out = joined.withColumn("__kept", F.when(F.col("__line_gone").isNull(), lines).otherwise(left))
    counts = F.struct(F.size(lines).cast("bigint").alias("n_lines"),
                      (F.size(lines) - F.size("__kept")).cast("bigint").alias("n_dropped"))
    columns = [F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns
               if c != stats]
    return out.select(*columns, *([counts.alias(stats)] if stats else []))
