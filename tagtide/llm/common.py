"""Helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.session import checkpoint_dir, materialize, read_table, scratch_path

__all__ = ["checkpoint_dir", "held_out", "ids_as_text", "materialize", "pick", "read_table", "scratch_path", "ship"]

#: fixed value: the fold that the contracts hold out
HELD_OUT_FOLD = 2

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their
    Python workers can import it from any working directory."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tagtide-py-"), "tagtide_py.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def ids_as_text(name: str) -> Column:
    """A bigint column as text, for the way through pandas, which would turn
    a column with nulls into doubles."""
    return F.col(name).cast("string").alias(name)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names: other
    columns, whatever they are called, cannot clash with what it computes."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def held_out(id_col: str | Column) -> Column:
    """crc32 of the id as text, mod 4, is the held-out fold (null id: false)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == HELD_OUT_FOLD, F.lit(False))
