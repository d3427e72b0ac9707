"""License scan by canonical digest lookup.

A text is brought to a canonical form (lower case, copyright lines out,
equivalent spellings made one, punctuation and white space folded) and its
SHA-256 is joined to the digests of known licence texts.  Whole texts are
looked up, and each line as a text of its own, which finds notices inside a
document.  Only entire texts match: a licence with one other word does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.llm.common import pick
from tagtide.llm.license_texts import DIGESTS, NOTICES, TEXTS

#: a line that states a copyright (not one that speaks of a copyright notice)
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}©\n]*(portions )?(copyright|©|\(c\))[ \t:]*(\(c\)|©|by |[0-9<\[{])[^\n]*$"
#: spellings that count as one
EQUIVALENT = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
              ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("authorise", "authorize"),
              ("whilst", "while"), ("favour", "favor"), ("and/or", "and or"), ("https://", "http://"),
              ("per cent", "percent"), ("copyright owner", "copyright holder"), ("all rights reserved", " "),
              ("&", " and "))
PUNCTUATION = r"[^\p{L}\p{N}]+"
MAX_KNOWN = 10_000  # known texts that may be broadcast


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the texts and notices that come with the library."""
    rows = [(k, t) for k, t in TEXTS.items()] + [(k, t) for k, v in NOTICES.items() for t in v]
    return spark.createDataFrame(rows, "license_id string, text string")


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the longer texts, of which the library has the digests alone."""
    return spark.createDataFrame([(k, d) for k, v in DIGESTS.items() for d in v], "license_id string, digest string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, notices) for every row of ``docs``.

    ``digest`` is of the whole text's canonical form; ``license_id`` the known
    licence it equals (the least of several), null where none; ``notices`` the
    sorted, distinct licences that single lines equal, comma-joined, empty
    where none.  A null text counts as empty; an empty canonical form matches
    nothing.  Repeated rows and null ids get a row each; other columns are
    not read.  ``known`` has columns license_id and text; beyond
    MAX_KNOWN texts they are joined without a broadcast."""
    spark = docs.sparkSession
    texts = known_texts(spark) if known is None else known
    rows = texts.where(F.length(canonical(F.col("text"))) > 0).select("license_id", digest(F.col("text")).alias("digest"))
    rows = rows.unionByName(known_digests(spark)) if known is None else rows
    known = rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if known.count() <= MAX_KNOWN:
        known = F.broadcast(known)
    rows = pick(docs, id=id_col, text=text_col).select(
        F.col("id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(5), "text").alias("k2")]  # notices hang on the text alone
    whole = rows.select("doc_id", *key, digest(F.col("text")).alias("digest")).join(known, "digest", "left")
    line = rows.select(*key, F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
    notices = (line.select("k1", "k2", digest(F.col("line")).alias("digest")).join(known, "digest")
               .groupBy("k1", "k2").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices")))
    return whole.join(notices, ["k1", "k2"], "left").select(
        "doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))
