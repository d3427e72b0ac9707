"""Connected components of a distributed edge table.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every
round hangs each node's larger, then its smaller neighbours on the least node
around it, until the edge table no longer changes.  Nodes, links and labels
stay in tables; each round is written to the shared folder, which cuts the
lineage.  Minima are partial aggregates, so the hub of a large star is
combined before the shuffle; the join that hands a hub's minimum to its edges
reads two plain tables, which lets AQE split the hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (a, b) rows with a > b."""
    if large:
        pairs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select("a", "b")
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("n"), F.least("m", "a").alias("m"))
    joined = pairs.join(least, pairs.a == least.n)
    if large:  # the larger neighbours of a hang on its least neighbour
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:      # a and its smaller neighbours hang on the least of them
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is the least
    node reachable.  ``edges`` has two bigint columns ``a`` and ``b``; loops,
    repeated links and null ends are ignored.  Raises when the rounds do not
    settle (they need about log2 of the longest path)."""
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "cc-edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        edges = materialize(_star(materialize(_star(edges, True), "cc-large"), False), "cc-small")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
