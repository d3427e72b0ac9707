"""IOB2 text files: line reader, sentence reader, flat reader, prediction sink.

File order is (file path, split start, row id inside the split).  Spark reads
one split per task in file order, so ``monotonically_increasing_id`` taken
directly after the scan orders the rows of a split; the split start orders the
splits.  A split is bounded (``spark.sql.files.maxPartitionBytes``) and folded
into sentences where it is read, so one large file never becomes one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.operators.flat import DEFAULT_SEQ_LEN, flat_rows
from tagtide.operators.islands import classify_lines, fold_scan


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """iob_line(file, block_start, line_id, value), in file order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.text(paths)
    return df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        "value")


def read_sentences(spark: SparkSession, paths: str | Sequence[str], comment: str = "start",
                   word_field: int = 1, tag_field: int = 2,
                   extra: dict[str, int] | None = None, empty_files: bool = True) -> DataFrame:
    """sentence(file, sent_ord, words, tags, raw) from IOB2 files or folders.

    With ``empty_files`` a file with no lines at all yields one empty
    sentence; the file list comes from the scan's own file index.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = read_lines(spark, paths)
    sents = fold_scan(lines, comment, word_field, tag_field, extra)
    if not empty_files:
        return sents
    bare = lambda c: F.regexp_replace(c, "^file:(//)?", "")
    listed = spark.createDataFrame([(p,) for p in spark.read.text(paths).inputFiles()], "path string")
    listed = listed.select("path", bare(F.col("path")).alias("_bare"))
    seen = sents.select(bare(F.col("file")).alias("_bare")).distinct()
    empty = (listed.join(seen, "_bare", "left_anti")
             .select(F.col("path").alias("file"), F.lit(0).cast("bigint").alias("sent_ord"),
                     F.array().cast("array<string>").alias("words"),
                     F.array().cast("array<string>").alias("tags"),
                     F.array().cast("array<string>").alias("raw"),
                     *[F.array().cast("array<string>").alias(n) for n in (extra or {})]))
    return sents.unionByName(empty)


def read_predictions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """sentence(file, sent_ord, words, pred, gold) from ``1<TAB>word<TAB>pred<TAB>gold`` files."""
    s = read_sentences(spark, paths, word_field=1, tag_field=2, extra={"gold": 3})
    return s.withColumnRenamed("tags", "pred").drop("raw")


def read_flat(spark: SparkSession, paths: str | Sequence[str], comment: str = "start",
              strict_fields: int | None = 5) -> DataFrame:
    """token(file, block_start, line_id, word, tag): the file as one flat sequence.

    Comments and blank lines are skipped; with ``strict_fields`` every word
    line must have exactly that many tab-separated fields.
    """
    lines = read_lines(spark, paths)
    rows = classify_lines(lines, comment=comment, strict_fields=strict_fields)
    return rows.where(F.col("kind") == "w").select("file", "block_start", "line_id", "word", "tag")


def read_flat_rows(spark: SparkSession, paths: str | Sequence[str], seq_len: int = DEFAULT_SEQ_LEN, **options) -> DataFrame:
    """(file, seq, n_pieces, labels): every file as one sequence of pieces cut
    into ``seq_len``-wide rows; ``options`` as for ``operators.flat.fold_words``."""
    return flat_rows(read_lines(spark, paths), seq_len, **options)


def sentence_block(words: str = "words", pred: str = "pred", gold: str = "gold"):
    """The prediction lines of one sentence row, built inside the row."""
    return F.array_join(F.transform(
        F.arrays_zip(F.col(words).alias("w"), F.col(pred).alias("p"), F.col(gold).alias("g")),
        lambda z: F.concat_ws("\t", F.lit("1"), z["w"], z["p"], z["g"])), "\n")


def prediction_blocks(tokens: DataFrame, key: Sequence[str], pos: str = "pos",
                      word: str = "word", pred: str = "pred", gold: str = "gold") -> DataFrame:
    """One text block per sentence: ``1<TAB>word<TAB>pred<TAB>gold`` lines."""
    line = F.concat_ws("\t", F.lit("1"), F.col(word), F.col(pred), F.col(gold))
    return (tokens.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), line.alias("l")))).alias("_ls"))
            .select(*key, F.array_join(F.transform("_ls", lambda x: x["l"]), "\n").alias("block")))


def write_predictions(blocks: DataFrame, path: str, order: Sequence[str],
                      num_files: int | None = None) -> None:
    """Write sentence blocks as IOB2 text, a blank line after every sentence.

    Range partitioning on the sentence order keeps each output file sorted and
    the files ordered by name, with no single-task global sort.
    """
    n = num_files or max(1, blocks.sparkSession.sparkContext.defaultParallelism)
    (blocks.repartitionByRange(n, *order)
     .sortWithinPartitions(*order)
     # an empty sentence is its one blank line; a block ends with its own line break before it
     .select(F.when(F.col("block") == "", "").otherwise(F.concat(F.col("block"), F.lit("\n"))).alias("value"))
     .write.mode("overwrite").text(path))
