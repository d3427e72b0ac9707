"""Line feeds and running scores as streams over folders of files.

The file source's offsets are files, so a producer appends by adding files
(rolling a log); ``trigger(availableNow=True)`` drains everything present,
which is the final drain of a tail loop.  Results equal the batch queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.operators.metrics import ratios, with_span_counts
from tagtide.streaming.status import file_stream, publish_to

LINE_SCHEMA = "conv_id bigint, turn bigint, line_no bigint, line string"


def conversation_lines(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, line_no, line): the text of every turn cut into lines."""
    return conversations.select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
        "conv_id", "turn", F.col("line_no").cast("bigint").alias("line_no"), "line")


def stream_lines(spark: SparkSession, source: str, table: str, checkpoint: str,
                 files_per_trigger: int | None = None) -> None:
    """Append every line record of the source folder to ``table`` (exactly once)."""
    lines = file_stream(spark, LINE_SCHEMA, files_per_trigger).json(source)
    q = (lines.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table))
    q.awaitTermination()


SENTENCE_SCHEMA = "lang string, doc_id bigint, line_no bigint, gold array<string>, pred array<string>"
COUNT_COLS = ["n_pred", "n_gold", "tp", "n_tok", "n_eq"]


SENTENCE_KEY = ["lang", "doc_id", "line_no"]


def stream_score(spark: SparkSession, source: str, table: str, checkpoint: str,
                 files_per_trigger: int | None = None, once_within: str | None = None) -> None:
    """Running span score over sentence files: per-sentence counts, summed in state.

    With ``once_within`` (an interval) a sentence counts once, whichever file
    brings it again within that time of its first file, by the files' times:
    a key's state goes when the interval is over.  The files are taken in the
    order of their times, so only a file put in with an old time is late; its
    sentences are left out."""
    sents = file_stream(spark, SENTENCE_SCHEMA, files_per_trigger).parquet(source)
    if once_within:
        timed = sents.select("*", F.col("_metadata.file_modification_time").alias("_file_time"))
        sents = timed.withWatermark("_file_time", once_within).dropDuplicatesWithinWatermark(SENTENCE_KEY)
    counts = with_span_counts(sents, "gold", "pred")
    totals = counts.agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNT_COLS])

    q = (totals.writeStream.outputMode("complete").foreachBatch(publish_to(table, ratios))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
