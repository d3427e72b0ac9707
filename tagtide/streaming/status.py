"""Job state from an event log: latest state, first state, all terminal.

A job's state lines are events (job = ``user_id``, state = ``event_type``,
order = (ts, event_id)).  The batch forms are plain aggregates; the streaming
form keeps one row of state per job in the state store (complete mode keeps
every job, so state grows with the number of jobs, not with events).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# States after which a job no longer runs, matched against the
# first word ("CANCELLED by 123" is terminal, "COMPLETING" is not).
TERMINAL_STATES = ["COMPLETED", "FAILED", "CANCELLED", "TIMEOUT",
                   "NODE_FAIL", "DEADLINE", "BOOT_FAIL", "OUT_OF_MEMORY"]
# Terminal event types of the driver's ``events`` table (our choice).
EVENT_TERMINAL_STATES = ["purchase", "error"]
UNKNOWN = "UNKNOWN"


def is_terminal(state: Column, terminal: Sequence[str] = TERMINAL_STATES) -> Column:
    return F.split(state, " ")[0].isin(list(terminal))


def job_events(events: DataFrame, zoned: bool = False) -> DataFrame:
    """(job, ts, event_id, state) from the events table.

    Batch queries order by the stored ``ts`` as is; a stream needs a zoned
    timestamp for its watermark (``zoned=True``).
    """
    ts = F.col("ts").cast("timestamp") if zoned else F.col("ts")
    return events.select(F.col("user_id").alias("job"), ts.alias("ts"),
                         "event_id", F.col("event_type").alias("state"))


def file_stream(spark: SparkSession, schema: str | StructType, files_per_trigger: int | None = None):
    """A file stream reader; a micro-batch takes all new files unless the caller bounds it."""
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader


def latest_state(ev: DataFrame) -> DataFrame:
    """(job, state, n_events): the state of the last event of every job."""
    return ev.groupBy("job").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("state"),
        F.count(F.lit(1)).cast("bigint").alias("n_events"))


def first_state(ev: DataFrame) -> DataFrame:
    """(job, state): the first non-blank state line of every job, else UNKNOWN."""
    state = F.trim("state")
    at = F.when(state != "", F.struct("ts", "event_id"))  # min_by passes over null orders
    return ev.groupBy("job").agg(F.coalesce(F.min_by(state, at), F.lit(UNKNOWN)).alias("state"))


def all_terminal(latest: DataFrame, terminal: Sequence[str] = TERMINAL_STATES) -> DataFrame:
    """One row: jobs, jobs in a terminal state, and whether all of them are."""
    t = is_terminal(F.col("state"), terminal)
    return latest.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_jobs"),
        F.sum(F.when(t, 1).otherwise(0)).cast("bigint").alias("n_terminal"),
        F.coalesce(F.bool_and(t), F.lit(True)).cast("int").alias("all_done"))


def publish_to(table: str, shape: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: each batch is a folder of its own, so a reader
    (``read_published``) finds the last whole one while the next is written,
    and a batch that runs again replaces only itself.  Older folders go."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        spark = batch.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch_id={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return publish


def read_published(spark: SparkSession, table: str) -> DataFrame:
    """The last batch that was written whole."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch_id=*/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    batches = [int(f.getPath().getParent().getName().split("=")[1]) for f in found or []]
    if not batches:
        raise FileNotFoundError(f"no batch is published in {table}")
    return spark.read.parquet(f"{table}/batch_id={max(batches)}")


def _latest(ev: DataFrame, watermark: str) -> DataFrame:
    return latest_state(ev.withWatermark("ts", watermark))


def _watched(ev: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """(job, state, ended): the first terminal state of a job, where its watch
    stops, else its latest state."""
    at = F.struct("ts", "event_id")
    end = is_terminal(F.col("state"), terminal)
    first_end = F.min_by("state", F.when(end, at))
    return ev.groupBy("job").agg(F.coalesce(first_end, F.max_by("state", at)).alias("state"),
                                 F.max(end.cast("int")).alias("ended"))


def _drain(df: DataFrame, table: str, checkpoint: str) -> None:
    (df.writeStream.outputMode("complete").foreachBatch(publish_to(table))
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def stream_latest_state(spark: SparkSession, source: str, schema: str | StructType, table: str,
                        checkpoint: str, watermark: str = "1 day", files_per_trigger: int | None = None) -> None:
    """Run the latest-state aggregation over a folder of event files to completion.

    The checkpoint holds the file offsets and the state store; read the result
    with ``read_published``.
    """
    ev = job_events(file_stream(spark, schema, files_per_trigger).parquet(source), zoned=True)
    _drain(_latest(ev, watermark), table, checkpoint)


def stream_watch(spark: SparkSession, source: str, schema: str | StructType, table: str, checkpoint: str,
                 terminal: Sequence[str] = TERMINAL_STATES, files_per_trigger: int | None = None) -> None:
    """Watch every job to its first terminal state over a folder of event files."""
    ev = job_events(file_stream(spark, schema, files_per_trigger).parquet(source), zoned=True)
    _drain(_watched(ev, terminal), table, checkpoint)


def watch_until_terminal(spark: SparkSession, source: str, schema: str | StructType, table: str, checkpoint: str,
                         terminal: Sequence[str] = TERMINAL_STATES, poll: str = "2 seconds",
                         timeout_s: float = 600.0, watermark: str = "1 day") -> None:
    """Keep the latest state per job up to date until every job is terminal.

    Each micro-batch publishes the per-job table and checks, on that table,
    whether all jobs have reached a terminal state; the driver stops the query
    once a batch says so.  Raises TimeoutError if none has after ``timeout_s``;
    a stream that failed raises its error.
    """
    import threading

    done = threading.Event()
    ev = job_events(spark.readStream.schema(schema).parquet(source), zoned=True)
    put = publish_to(table)

    def publish(batch: DataFrame, batch_id: int) -> None:
        put(batch, batch_id)
        flag = all_terminal(spark.read.parquet(f"{table}/batch_id={batch_id}"), terminal).first()
        if flag.n_jobs > 0 and flag.all_done == 1:
            done.set()

    q = (_latest(ev, watermark).writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint).trigger(processingTime=poll).start())
    try:
        done.wait(timeout_s)
    finally:
        failure = q.exception()
        q.stop()
    if failure is not None:
        raise failure
    if not done.is_set():
        raise TimeoutError(f"not all jobs are terminal after {timeout_s} s")
