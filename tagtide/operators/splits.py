"""Train/test assembly per language, set sizes and quotas.

Rules by the number of files found for a language (files ordered full,
train, dev, test):

* 1 file: the first ``floor(r * n)`` sentences train, the rest test, with
  r = 0.8 for a target language and 0.5 otherwise (double arithmetic);
* 2 files: the first is train, the second test;
* 3 files: the first two, in that order, are train; the third is test.

Everything per (language, part) is a small table (a handful of rows per
language), broadcast to the sentences, which themselves only need the two-level
ordinal inside their file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.operators.order import DEFAULT_CHUNK_DOCS, doc_chunk, ordinal

TARGET_RATIO = 0.8
OTHER_RATIO = 0.5


def file_table(sentences: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row per (lang, part): sentence count, split, offset inside the split.

    Columns: lang, part, part_rank, n_part, n_files, split (null for a
    ratio-split file), split_offset, train_n (ratio files only).
    """
    parts = sentences.groupBy("lang", "part", "part_rank").agg(F.count(F.lit(1)).alias("n_part"))
    per_lang = Window.partitionBy("lang")
    ranked = parts.select(
        "*",
        F.count(F.lit(1)).over(per_lang).alias("n_files"),
        F.row_number().over(per_lang.orderBy("part_rank")).alias("file_rank"))
    split = (F.when(F.col("n_files") == 1, F.lit(None).cast("string"))
             .when((F.col("n_files") == 2) & (F.col("file_rank") == 1), "train")
             .when(F.col("n_files") == 2, "test")
             .when((F.col("n_files") == 3) & (F.col("file_rank") <= 2), "train")
             .when(F.col("n_files") == 3, "test")
             .otherwise(F.raise_error(F.concat(F.lit("unsupported number of files for "), F.col("lang")))
                        .cast("string")))
    ratio = F.when(F.col("lang").isin(list(targets)), F.lit(TARGET_RATIO)).otherwise(F.lit(OTHER_RATIO))
    ranked = ranked.select("*", split.alias("split"),
                           F.floor(ratio * F.col("n_part").cast("double")).cast("bigint").alias("train_n"))
    in_split = (Window.partitionBy("lang", "split").orderBy("part_rank")
                .rowsBetween(Window.unboundedPreceding, -1))
    return ranked.select(
        "lang", "part", "part_rank", "n_part", "n_files", "split",
        F.coalesce(F.sum("n_part").over(in_split), F.lit(0)).cast("bigint").alias("split_offset"),
        F.when(F.col("n_files") == 1, F.col("train_n")).alias("train_n"))


def assign_splits(sentences: DataFrame, targets: Sequence[str],
                  chunk_docs: int = DEFAULT_CHUNK_DOCS) -> DataFrame:
    """Add part_ord, split and split_ord (order: part_rank, doc_id, line_no)."""
    files = file_table(sentences, targets)
    ordered = ordinal(sentences, ["lang", "part"], ["doc_id", "line_no"],
                      [doc_chunk("doc_id", chunk_docs)], name="part_ord")
    # one row per (lang, part); left to AQE, the sentences would be shuffled by language before it is found small
    j = ordered.join(F.broadcast(files.drop("part_rank")), on=["lang", "part"])
    ratio = F.col("n_files") == 1
    split = F.when(ratio, F.when(F.col("part_ord") < F.col("train_n"), "train").otherwise("test")) \
        .otherwise(F.col("split"))
    split_ord = F.when(ratio, F.when(F.col("part_ord") < F.col("train_n"), F.col("part_ord"))
                       .otherwise(F.col("part_ord") - F.col("train_n"))) \
        .otherwise(F.col("split_offset") + F.col("part_ord"))
    out = j.withColumn("split_ord", split_ord).withColumn("split", split)
    return out.drop("n_part", "n_files", "split_offset", "train_n")


def split_sizes(sentences: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(lang, split, n) computed from the per-file table only."""
    files = file_table(sentences, targets)
    ratio_rows = files.where(F.col("n_files") == 1).select(
        "lang", F.explode(F.array(
            F.struct(F.lit("train").alias("split"), F.col("train_n").alias("n")),
            F.struct(F.lit("test").alias("split"), (F.col("n_part") - F.col("train_n")).alias("n")))).alias("s"))
    ratio_rows = ratio_rows.select("lang", "s.split", "s.n")
    file_rows = files.where(F.col("n_files") > 1).groupBy("lang", "split").agg(F.sum("n_part").alias("n"))
    return ratio_rows.unionByName(file_rows).select("lang", "split", F.col("n").cast("bigint").alias("n"))


def smallest_sets(sizes: DataFrame, registry: DataFrame, langs: Sequence[str] | None = None) -> DataFrame:
    """Per split: (split, lang, n) of the smallest set; earlier registry order wins ties."""
    df = sizes.join(F.broadcast(registry.select("lang", "ord")), "lang")
    if langs is not None:
        df = df.where(F.col("lang").isin(list(langs)))
    return df.groupBy("split").agg(
        F.min_by("lang", F.struct("n", "ord")).alias("lang"),
        F.min("n").alias("n"))


def quotas(sizes: DataFrame, targets: Sequence[str], target: str = "all", k: int = 10) -> DataFrame:
    """(lang, train_quota, test_quota) following the balanced-split rules.

    target='all': every language gets the smallest train size;
    the target language gets the smallest *target* train size, the others k.
    Every language's test set is cut to the smallest test size.
    """
    if target != "all" and target not in targets:
        raise ValueError(f"target {target!r} is not one of the target languages {list(targets)}")
    if k < 0:
        raise ValueError("k must be >= 0")
    # one row per language (train and test sizes), minima over all rows by a
    # window without partition keys: the table has one row per language
    per_lang = sizes.groupBy("lang").agg(
        F.max(F.when(F.col("split") == "train", F.col("n"))).alias("train_n"),
        F.max(F.when(F.col("split") == "test", F.col("n"))).alias("test_n"))
    every = Window.partitionBy()
    q = per_lang.select(
        "lang",
        F.min("train_n").over(every).alias("min_train"),
        F.min("test_n").over(every).alias("min_test"),
        F.min(F.when(F.col("lang").isin(list(targets)), F.col("train_n"))).over(every).alias("min_target_train"))
    checked_k = F.when(F.lit(k) <= F.col("min_test"), F.lit(k)).otherwise(
        F.raise_error(F.concat(F.lit(f"k={k} is greater than the smallest test set ("),
                               F.col("min_test").cast("string"), F.lit(")"))).cast("bigint"))
    if target == "all":
        train_q = F.col("min_train")
    else:
        train_q = F.when(F.col("lang") == target, F.col("min_target_train")).otherwise(checked_k)
    return q.select("lang", train_q.cast("bigint").alias("train_quota"),
                    F.when(checked_k.isNotNull(), F.col("min_test")).cast("bigint").alias("test_quota"))
