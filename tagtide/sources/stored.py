"""Rows kept apart and paired again by position.

Two tables that hold different columns of the same sentences are stored in
buckets of the position key, so that pairing them reads bucket beside bucket:
the one shuffle is paid when a table is stored, not by every query after it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tagtide.session import scratch_path


def store(df: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None, path: str | None = None) -> str:
    """Store ``df`` in buckets of ``keys``, sorted within each, and return the table's name.

    Tables that are to be paired need the same keys and number of buckets (by
    default the session's shuffle partitions).  Use the whole position as key:
    a language or a file alone may hold a third of the rows.  A bucket is one
    file.  ``path`` defaults to a fresh folder of the shared checkpoint folder.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
     .option("path", path or scratch_path(spark, name)).saveAsTable(table))
    return table


def pair(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """The rows of two stored tables with equal keys; neither side is shuffled.
    A row with a null in its key pairs with nothing."""
    return left.hint("merge").join(right, list(keys), how)
