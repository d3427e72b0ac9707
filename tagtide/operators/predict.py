"""Turning class scores and label ids into tag sequences and prediction lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.functions.tags import IGNORE_ID, id_tag_sql


def argmax(scores: str | Column) -> Column:
    """0-based index of the largest score; the first one wins ties."""
    c = F.col(scores) if isinstance(scores, str) else scores
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def masked_pairs_sql(pred_ids: str, gold_ids: str, mode: str = "reference") -> tuple[str, str]:
    """SQL text of (pred tags, gold tags) over positions whose gold id is not ignored."""
    keep = f"filter(arrays_zip(`{pred_ids}`, `{gold_ids}`), z -> z.`{gold_ids}` <> {IGNORE_ID})"
    return (f"transform({keep}, z -> {id_tag_sql(f'z.`{pred_ids}`', mode)})",
            f"transform({keep}, z -> {id_tag_sql(f'z.`{gold_ids}`', mode)})")


def masked_pairs(df: DataFrame, pred_ids: str, gold_ids: str, mode: str = "reference") -> DataFrame:
    p, g = masked_pairs_sql(pred_ids, gold_ids, mode)
    return df.withColumn("pred_tags", F.expr(p)).withColumn("gold_tags", F.expr(g))


def compat_lines(sent: DataFrame, key: Sequence[str], order: Sequence[str], chunk: Sequence[Column],
                 words: str = "out_words", pred: str = "pred_tags", gold: str = "gold_tags") -> DataFrame:
    """Prediction lines paired by global position, as the original writer did.

    The line list holds every sentence's words followed by one blank entry;
    the label lists hold no blanks.  Line k takes label k, so each sentence
    shifts the pairing by one more place and the output stops at the shorter
    list.  Returns (k, value): ``1<TAB>word<TAB>pred<TAB>gold`` or '' for a blank.
    """
    from tagtide.operators.order import running_sums
    g = [F.lit(0).alias("_all")]
    base = sent.select(*key, *order, words, pred, gold, *[c for c in g])
    # one global order: a three-level prefix keeps the chunk table off a single task
    pre = running_sums(base, ["_all"], list(order), list(chunk),
                       {"_lines": F.size(words) + 1, "_labels": F.size(pred)}, levels=3)
    line_rows = pre.select(
        F.posexplode(F.concat(F.col(words), F.array(F.lit(None).cast("string")))).alias("_j", "line"),
        "_lines_before").select((F.col("_lines_before") + F.col("_j")).alias("k"), "line")
    label_rows = pre.select(
        F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(gold).alias("g"))).alias("_j", "z"),
        "_labels_before").select((F.col("_labels_before") + F.col("_j")).alias("k"),
                                 F.col("z.p").alias("p"), F.col("z.g").alias("g"))
    paired = line_rows.join(label_rows, "k")
    value = F.when(F.col("line").isNull() | (F.col("line") == ""), F.lit("")).otherwise(
        F.concat_ws("\t", F.lit("1"), F.col("line"), F.col("p"), F.col("g")))
    return paired.select("k", value.alias("value"))
