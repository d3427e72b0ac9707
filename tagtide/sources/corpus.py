"""A tagged corpus derived from the ``documents`` table, and the language registry.

Sentence = one line of ``documents.text``; words = the line split on single
spaces with empty strings removed.  Two deterministic taggers give a gold and
a predicted tag sequence.  Every tag is computed inside the sentence row, so
building the corpus is narrow (no shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagtide.session import path_exists, read_table
from tagtide.sources.iob import read_sentences

# ---- fixed values -------------------------------------------------------
# Language registry of the derived corpus: code, registry order, storage
# prefix of its files, and the three-letter code used by typology tables.
REGISTRY = [
    ("en", 0, "en/en_docs-ud", "eng"),
    ("fr", 1, "fr/fr_docs-ud", "fra"),
    ("de", 2, "de/de_docs-ud", "deu"),
    ("es", 3, "es/es_docs-ud", "spa"),
]
DEFAULT_TARGETS = ["en", "es"]
# File suffixes in load order: whole file, train, dev, test.
PART_SUFFIXES = [("full", 0, ""), ("train", 1, "-train.iob2"),
                 ("dev", 2, "-dev.iob2"), ("test", 3, "-test.iob2")]
# Which file a document belongs to, by doc_id % 10 (inclusive ranges).
PART_LAYOUT = {
    "en": [(0, 6, "train"), (7, 7, "dev"), (8, 9, "test")],
    "fr": [(0, 6, "train"), (7, 7, "dev"), (8, 9, "test")],
    "de": [(0, 7, "train"), (8, 9, "test")],
    "es": [(0, 9, "full")],
}
# Word-type rules of the two taggers, first match wins.
GOLD_RULE = {"digit": "[0-9]", "upper": r"^\p{Lu}", "long": 12}
PRED_RULE = {"digit": "[0-9]", "upper": "^[A-Z]", "long": 11}
# -------------------------------------------------------------------------


def registry(spark: SparkSession) -> DataFrame:
    """dim_language(lang, ord, path_prefix, iso); a handful of rows, broadcast."""
    return spark.createDataFrame(REGISTRY, "lang string, ord int, path_prefix string, iso string").coalesce(1)


def _part_of(lang: Column, doc_id: Column) -> Column:
    m = doc_id % 10
    expr = None
    for code, ranges in PART_LAYOUT.items():
        inner = None
        for lo, hi, part in ranges:
            cond = m.between(lo, hi)
            inner = F.when(cond, F.lit(part)) if inner is None else inner.when(cond, F.lit(part))
        expr = F.when(lang == code, inner) if expr is None else expr.when(lang == code, inner)
    return expr


def _part_rank(part: Column) -> Column:
    out = None
    for name, rank, _ in PART_SUFFIXES:
        out = F.when(part == name, F.lit(rank)) if out is None else out.when(part == name, F.lit(rank))
    return out


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _typer(words: str, line: str, rule: dict) -> str:
    # a line without a digit has no word with one; no word that starts with a-z starts with a capital
    return (f"CASE WHEN {line} rlike {_sql_str(rule['digit'])} THEN {_typed(words, rule, True)} "
            f"ELSE {_typed(words, rule, False)} END")


def _typed(words: str, rule: dict, digits: bool) -> str:
    digit = f"WHEN w rlike {_sql_str(rule['digit'])} THEN 'LOC' " if digits else ""
    return (f"transform({words}, (w, i) -> CASE {digit}"
            f"WHEN i > 0 AND NOT (w >= 'a' AND w < '{{') AND w rlike {_sql_str(rule['upper'])} THEN 'PER' "
            f"WHEN char_length(w) >= {rule['long']} THEN 'ORG' ELSE 'O' END)")


def _tagger(types: str) -> str:
    return (f"transform({types}, (t, i) -> CASE WHEN t = 'O' THEN 'O' "
            f"WHEN i > 0 AND {types}[i - 1] = t THEN concat('I-', t) "
            f"ELSE concat('B-', t) END)")


def _registered() -> Column:
    return F.coalesce(F.col("lang").isin([code for code, *_ in REGISTRY]), F.lit(False))


def language_counts(documents: DataFrame) -> DataFrame:
    """(lang, registered, n_docs) of every language of ``documents``, null too."""
    return (documents.groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"))
            .select("lang", _registered().alias("registered"), "n_docs"))


def tagged_sentences(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """sentence(lang, part, part_rank, doc_id, line_no, words, gold, pred).

    One row per line of every document; ``(doc_id, line_no)`` is the file order.
    A document whose language (or null) is not registered has no file layout:
    it raises, and ``language_counts`` lists all there are.
    """
    docs = documents if documents is not None else read_table(spark, sf_dir, "documents")
    # in a filter, which column pruning cannot take out of the plan
    docs = docs.where(F.when(_registered(), True).otherwise(F.raise_error(F.concat(
        F.lit("language not in the registry: "), F.coalesce("lang", F.lit("null")), F.lit(", doc_id "),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("boolean")))
    lines = docs.select(
        "lang", "doc_id",
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select(
        "lang", "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line",
        F.filter(F.split("line", " "), lambda w: w != "").alias("words"))
    typed = words.select(
        "*",
        F.expr(_typer("words", "line", GOLD_RULE)).alias("_gt"),
        F.expr(_typer("words", "line", PRED_RULE)).alias("_pt"))
    return typed.select(
        "lang",
        _part_of(F.col("lang"), F.col("doc_id")).alias("part"),
        _part_rank(_part_of(F.col("lang"), F.col("doc_id"))).alias("part_rank"),
        "doc_id", "line_no", "words",
        F.expr(_tagger("_gt")).alias("gold"),
        F.expr(_tagger("_pt")).alias("pred"))


def tagged_tokens(sentences: DataFrame) -> DataFrame:
    """token(lang, part, doc_id, line_no, pos, word, gold, pred): one row per word."""
    z = F.arrays_zip("words", "gold", "pred")
    return sentences.select(
        "lang", "part", "doc_id", "line_no",
        F.posexplode(z).alias("pos", "z")).select(
        "lang", "part", "doc_id", "line_no", "pos",
        F.col("z.words").alias("word"), F.col("z.gold").alias("gold"), F.col("z.pred").alias("pred"))


def _line_texts(comment: Column, tag_col: str) -> Column:
    """The lines of a sentence as one array: its comment, one line per word, a blank."""
    word_lines = F.transform(
        F.arrays_zip("words", tag_col),
        lambda z, i: F.concat_ws("\t", (i + 1).cast("string"), z["words"], z[tag_col], F.lit("-"), F.lit("-")))
    return F.concat(F.array(comment), word_lines, F.array(F.lit("")))


def iob_lines(sentences: DataFrame, tag_col: str = "gold", keep: Sequence[str] = ()) -> DataFrame:
    """Serialise sentences as IOB2 line rows: a comment, one line per word, a blank.

    iob_line(file, line_no, idx, value) and the columns of ``keep``; the order
    of a file is (line_no, idx).
    """
    comment = F.concat(F.lit("# sent_id = "), F.col("line_no").cast("string"))
    return sentences.select(
        *keep, F.col("doc_id").alias("file"), "line_no",
        F.posexplode(_line_texts(comment, tag_col)).alias("idx", "value"))


def corpus_files(root: str) -> list[tuple[str, str, str]]:
    """(lang, part, path) of every file that the registry may have under ``root``."""
    return [(lang, part, f"{root}/file_no={len(PART_SUFFIXES) * no + rank}")
            for lang, no, *_ in REGISTRY for part, rank, _ in PART_SUFFIXES]


def write_corpus_files(sentences: DataFrame, root: str) -> None:
    """The corpus as IOB2 text, one folder per (lang, part) of ``corpus_files``.

    Whole documents go to a file, in line order; every sentence carries
    ``# sent_id = doc-line``.  A sentence is shuffled and sorted as one text of
    its lines.  The folder key is an integer: Spark sorts again on text keys,
    which would undo the order of the lines.
    """
    code = F.create_map(*chain.from_iterable((F.lit(lang), F.lit(no)) for lang, no, *_ in REGISTRY))
    file_no = code[F.col("lang")] * len(PART_SUFFIXES) + F.col("part_rank")
    head = F.concat(F.lit("# sent_id = "), F.col("doc_id").cast("string"), F.lit("-"), F.col("line_no").cast("string"))
    # a line without a text (its sentence has no number) is a blank
    block = F.array_join(_line_texts(head, "gold"), "\n", "")
    order = ["file_no", "file", "line_no"]
    w = Window.partitionBy(*order).orderBy(F.lit(1))
    # sentences of one place stand line beside line, as sorting their lines has them
    lists = F.transform("_same", lambda b: F.split(b, "\n"))
    longest = F.array_max(F.transform(lists, lambda b: F.size(b)))
    merged = F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.filter(
        F.transform(lists, lambda b: F.get(b, i)), lambda x: x.isNotNull())))
    (sentences.where("words is not null and gold is not null")
     .select(file_no.alias("file_no"), F.col("doc_id").alias("file"), "line_no", block.alias("value"))
     .repartition("file")
     .select(*order, F.row_number().over(w).alias("_nth"),
             F.collect_list("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_same"))
     .where("_nth = 1").sortWithinPartitions(*order)
     .select("file_no", F.when(F.size("_same") == 1, F.get("_same", 0)).otherwise(F.array_join(merged, "\n")).alias("value"))
     .write.partitionBy("file_no").text(root))


def load_corpus(spark: SparkSession, files: Sequence[tuple[str, str, str]],
                targets: str | Sequence[str] = "all") -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """(sentences, failed) of a manifest of (lang, part, path).

    ``sentences`` are those of the paths that exist (files or folders), with
    ``lang`` and ``part`` taken from the path; ``failed`` lists the others.
    ``targets`` is a language code, several, or ``"all"``, in any case; a code
    that the manifest does not have raises.
    """
    wanted = {t.lower() for t in ([targets] if isinstance(targets, str) else targets)}
    if unknown := wanted - {"all"} - {lang for lang, *_ in files}:
        raise ValueError(f"languages without files: {sorted(unknown)}")
    files = [f for f in files if "all" in wanted or f[0] in wanted]
    there = [f for f in files if path_exists(spark, f[2])]
    failed = [f for f in files if f not in there]
    if not there:
        raise FileNotFoundError(f"none of {len(files)} corpus files exists")
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    known = F.create_map(*chain.from_iterable(
        (bare(F.lit(path)), F.struct(F.lit(lang).alias("lang"), F.lit(part).alias("part"))) for lang, part, path in there))
    path = bare(F.col("file"))
    sents = read_sentences(spark, [p for *_, p in there], empty_files=False)
    sents = sents.withColumn("_at", F.coalesce(F.try_element_at(known, path),
                                               F.try_element_at(known, F.regexp_replace(path, "/[^/]*$", ""))))
    return sents.select("_at.lang", "_at.part", *[c for c in sents.columns if c != "_at"]), failed


def of_languages(sentences: DataFrame, targets: str | Sequence[str] = "all") -> DataFrame:
    """The rows of one language, of several, or (``"all"``) of every one; the codes in any case."""
    wanted = {t.lower() for t in ([targets] if isinstance(targets, str) else targets)}
    return sentences if "all" in wanted else sentences.where(F.col("lang").isin(sorted(wanted)))
