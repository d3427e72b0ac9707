"""A corpus pipeline over the operators of ``tagtide.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's documents.  All but the last
return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.llm import decontam, langid, line_dedup, packing, simhash
from tagtide.llm.common import materialize, read_table
from tagtide.llm.queries import tokenizer_path

#: a document is rejected if it has no language, or the calibrated score of the best one is below this
MIN_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell; those with a null or
    letterless text, or a score below MIN_LANGUAGE_SCORE, go.  Every row is
    judged by its own text (null and repeated ids too)."""
    rows = docs.select("doc_id", "text", "lang").withColumnRenamed("doc_id", "id")
    model = langid.fit(rows.where(~langid.held_out("id")))
    return langid.keep_identified(docs, model, "text", MIN_LANGUAGE_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that op6 drops; n_chars is counted anew.  A
    document that loses every line stays, with an empty text."""
    kept = line_dedup.keep_lines(docs, stats=None)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the least id.
    Rows without an id stay; repeated rows of a kept id all stay."""
    found = simhash.near_duplicates(docs).where("id = component_id").select(F.col("id").alias("__keep")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__keep"), "left_semi").unionByName(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of ``benchmark`` of seven tokens or more."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), min_tokens=7)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of op7."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_documents),
]

#: trained models, components and a tokeniser are beyond SQL: tests/llm holds each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared
    folder and reread, which cuts the lineage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
