"""Ordinals and running sums over an explicit order, without one-task windows.

A window ``PARTITION BY lang ORDER BY ...`` puts a whole language into one
task.  Here the order is cut into *chunks*: a bounded, order-monotone key
(e.g. ``doc_id div 1024`` or a file split).  A window per (group, chunk) gives
the local running value; a small per-chunk total table gives each chunk's
offset.  The total table is an aggregate, so AQE sees its real size and turns
the join back into a broadcast when it is small; the big side is already
partitioned by the join key after the window, so it is not shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_DOCS = 1024


def doc_chunk(col: str = "doc_id", docs_per_chunk: int = DEFAULT_CHUNK_DOCS) -> Column:
    """Order-monotone chunk key for an order that starts with ``doc_id``."""
    return F.expr(f"`{col}` div {docs_per_chunk}")  # in integers: a double is exact to 2^53 only


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that came out narrower than the cluster.

    A large input already has one partition per file split and is left alone;
    a single-row-group file would otherwise run all row-local work in one task.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                 chunk: Sequence[Column], values: dict[str, Column],
                 suffix: str = "_before", levels: int = 2, fanout: int = 1024) -> DataFrame:
    """Add, for every ``name -> value``, the exclusive running sum ``name + suffix``.

    ``chunk`` expressions must be non-decreasing along ``order`` inside a group
    and bounded in size; they become the second level of the prefix.  With
    ``levels=3`` the per-chunk total table is itself prefixed in two levels
    (its last chunk column divided by ``fanout``), so that a single group with
    a very large number of chunks is not one task either.
    """
    tag = f"_l{levels}"          # internal names per level, so recursion cannot clash
    chunk_cols = [f"{tag}_chunk{i}" for i in range(len(chunk))]
    v, loc, tot, off = (f"{tag}_v_", f"{tag}_loc_", f"{tag}_tot_", f"{tag}_off_")
    base = df.select("*", *[c.alias(n) for c, n in zip(chunk, chunk_cols)],
                     *[val.cast("bigint").alias(f"{v}{k}") for k, val in values.items()])
    local_w = (Window.partitionBy(*group, *chunk_cols).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = base.select("*", *[F.coalesce(F.sum(f"{v}{k}").over(local_w), F.lit(0)).alias(f"{loc}{k}")
                              for k in values])
    # Catalyst prunes the unused window from this branch and turns it into a
    # map-side partial aggregate over the input; callers write expensive
    # inputs to a table first so that this re-read is a pruned scan
    totals = local.groupBy(*group, *chunk_cols).agg(*[F.sum(f"{v}{k}").alias(f"{tot}{k}") for k in values])
    if levels > 2:
        coarse = [F.col(c) for c in chunk_cols[:-1]] + [F.floor(F.col(chunk_cols[-1]) / fanout)]
        offsets = running_sums(totals, group, chunk_cols, coarse,
                               {f"{off}{k}": F.col(f"{tot}{k}") for k in values},
                               suffix="", levels=levels - 1, fanout=fanout)
        offsets = offsets.select(*group, *chunk_cols, *[f"{off}{k}" for k in values])
    else:
        chunk_w = (Window.partitionBy(*group).orderBy(*chunk_cols)
                   .rowsBetween(Window.unboundedPreceding, -1))
        offsets = totals.select(*group, *chunk_cols,
                                *[F.coalesce(F.sum(f"{tot}{k}").over(chunk_w), F.lit(0)).alias(f"{off}{k}")
                                  for k in values])
    joined = local.join(offsets, on=[*group, *chunk_cols], how="inner")
    out = joined.select("*", *[(F.col(f"{off}{k}") + F.col(f"{loc}{k}")).alias(f"{k}{suffix}")
                              for k in values])
    drop = chunk_cols + [f"{v}{k}" for k in values] + [f"{loc}{k}" for k in values] \
        + [f"{off}{k}" for k in values]
    return out.drop(*drop)


def ordinal(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
            chunk: Sequence[Column], name: str = "ord", levels: int = 2) -> DataFrame:
    """0-based position of each row inside its group, in ``order``."""
    out = running_sums(df, group, order, chunk, {"_one": F.lit(1)}, levels=levels)
    return out.withColumnRenamed("_one_before", name)
