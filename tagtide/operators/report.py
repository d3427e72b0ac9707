"""Entity density and set-size reports over aligned sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.operators.align import entity_count


def density(aligned: DataFrame, group: Sequence[str], labels: str = "labels") -> DataFrame:
    """Per group: sentences, tokens (padding included), entity tokens, density,
    and sentences with / without entities."""
    ents = entity_count(labels)
    return (aligned.select(*group, F.size(labels).alias("_tok"), ents.alias("_ent"))
            .groupBy(*group)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_sent"),
                 F.sum("_tok").cast("bigint").alias("n_tokens"),
                 F.sum("_ent").cast("bigint").alias("n_entities"),
                 F.sum(F.when(F.col("_ent") > 0, 1).otherwise(0)).cast("bigint").alias("with_entities"),
                 F.sum(F.when(F.col("_ent") == 0, 1).otherwise(0)).cast("bigint").alias("without_entities"))
            .withColumn("density", F.when(F.col("n_tokens") > 0,
                                          F.col("n_entities") / F.col("n_tokens")).otherwise(F.lit(0.0))))


def density_rollup(aligned: DataFrame, labels: str = "labels") -> DataFrame:
    """Density per (lang, split), per language and overall, in one aggregation.

    ``lang``/``split`` are null on the total rows, as ROLLUP gives them.
    """
    ents = entity_count(labels)
    return (aligned.select("lang", "split", F.size(labels).alias("_tok"), ents.alias("_ent"))
            .rollup("lang", "split")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_sent"),
                 F.sum("_tok").cast("bigint").alias("n_tokens"),
                 F.sum("_ent").cast("bigint").alias("n_entities"))
            .withColumn("density", F.when(F.col("n_tokens") > 0,
                                          F.col("n_entities") / F.col("n_tokens")).otherwise(F.lit(0.0))))


def density_from_counts(rows: DataFrame, group: Sequence[str], ents: str = "ents",
                        width: int = 64) -> DataFrame:
    """Same figures as ``density`` from per-sentence entity counts (``width`` tokens each)."""
    return (rows.groupBy(*group)
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_sent"),
                 F.sum(ents).cast("bigint").alias("n_entities"))
            .withColumn("n_tokens", (F.col("n_sent") * width).cast("bigint"))
            .withColumn("density", F.when(F.col("n_tokens") > 0,
                                          F.col("n_entities") / F.col("n_tokens")).otherwise(F.lit(0.0))))
