"""Runs of jobs as keyed state that ends.

The events of a job form *runs*: a run ends with a terminal event, or when its
job stays silent for longer than ``silence``; the next event after that starts
the job's next run.  The stream keeps one row of state per job with a run:
a micro-batch touches and emits only the jobs that it has events of, a timer
ends silent runs, and state goes when its run has ended.

Late events.  One older than the watermark is dropped by the engine.  One that
is older than its job's open run counts in that run, and ends it if it is
terminal, but does not change its latest state.  One older than the end of its
job's last run changes nothing: until the watermark has passed that end, the
state keeps the end's place; after that the engine drops such events itself.

``job_runs`` is the batch form; for events that arrive in order of time both
give the same runs.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tagtide.operators.order import running_sums
from tagtide.streaming.status import TERMINAL_STATES, file_stream, is_terminal, job_events

SILENCE_HOURS = 24
DELAY_HOURS = 1
RUN = ("job bigint, first_event bigint, started timestamp, last_ts timestamp, state string, n_events bigint, "
       "status string")
STATE = "first_event bigint, started bigint, last_us bigint, last_event bigint, state string, n bigint, ended boolean"
#: events of a job are grouped by so many hours where their order is worked out
BUCKET_HOURS = 24


def job_runs(ev: DataFrame, terminal: Sequence[str] = TERMINAL_STATES, silence_hours: int = SILENCE_HOURS,
             delay_hours: int = DELAY_HOURS) -> DataFrame:
    """Every run of (job, ts, event_id, state): job, first_event, started,
    last_ts, state, n_events, status.

    ``status`` is ``ended``, ``silent`` or ``open``, as of the latest event of
    all less ``delay_hours``.  Events without a job or a time are left out.
    Windows span a job's hours of one bucket; a table with a row per bucket
    carries what crosses its edges, so a busy job is many tasks."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = ev.where("job is not null and ts is not null").select(
        "job", us.alias("us"), "event_id", "state", F.coalesce(is_terminal(F.col("state"), terminal), F.lit(False)).alias("term"))
    ev = ev.withColumn("bucket", F.expr(f"us div {BUCKET_HOURS * 3_600_000_000}"))
    here = Window.partitionBy("job", "bucket").orderBy("us", "event_id")
    last = ev.groupBy("job", "bucket").agg(F.max_by(F.struct("us", "term"), F.struct("us", "event_id")).alias("last"))
    before = last.select("job", "bucket", F.lag("last").over(Window.partitionBy("job").orderBy("bucket")).alias("earlier"))
    rows = ev.withColumn("prev", F.lag(F.struct("us", "term")).over(here)).join(before, ["job", "bucket"])
    prev = F.coalesce("prev", "earlier")
    starts = prev.isNull() | prev["term"] | (F.col("us") - prev["us"] > silence_hours * 3_600_000_000)
    rows = rows.select("job", "us", "event_id", "state", "term", "bucket", starts.cast("bigint").alias("starts"))
    rows = running_sums(rows, ["job"], ["us", "event_id"], [F.col("bucket")], {"starts": F.col("starts")})
    at = F.struct("us", "event_id")
    runs = rows.groupBy("job", (F.col("starts") + F.col("starts_before")).alias("run")).agg(
        F.min_by("event_id", at).alias("first_event"), F.min("us").alias("started"), F.max("us").alias("last_us"),
        F.max_by(F.struct("state", "term"), at).alias("latest"), F.count(F.lit(1)).alias("n_events"))
    totals = rows.groupBy("job").agg(F.sum("starts").alias("runs"))
    now = ev.agg(F.max("us")).first()[0]
    runs = runs.join(totals, "job").withColumn("now", F.lit(now).cast("bigint"))
    ms = lambda c: F.expr(f"{c} div 1000")  # noqa: E731  the engine keeps times in milliseconds
    silent = (F.col("run") < F.col("runs")) | (
        ms("last_us") + silence_hours * 3_600_000 < ms("now") - delay_hours * 3_600_000)
    status = F.when(F.col("latest.term"), "ended").when(silent, "silent").otherwise("open")
    return runs.select("job", "first_event", F.timestamp_micros("started").alias("started"),
                       F.timestamp_micros("last_us").alias("last_ts"), F.col("latest.state").alias("state"),
                       "n_events", status.alias("status"))


def run_changes(ev: DataFrame, terminal: Sequence[str] = TERMINAL_STATES, silence_hours: int = SILENCE_HOURS,
                delay_hours: int = DELAY_HOURS) -> DataFrame:
    """Changed runs of a stream of (job, ts, event_id, state), as RUN columns.

    A micro-batch gives a row for every run that ended in it and one for the
    open run of every job with events.  The events of a job in one micro-batch
    are held together, as numbers: bound the batch where one job can be large."""
    ends, silence = frozenset(terminal), silence_hours * 3_600_000_000

    def row(job: int, run: list, status: str) -> tuple:
        first, started, last_us, _, state, n, _ = run
        return job, first, pd.Timestamp(started, unit="us", tz="UTC"), pd.Timestamp(last_us, unit="us", tz="UTC"), state, n, status

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RUN.split(", ")])

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        job = key[0]
        run = list(kept.get) if kept.exists else None
        if kept.hasTimedOut:
            kept.remove()
            if run and not run[6]:
                yield frame([row(job, run, "silent")])
            return
        parts = [(b["us"].to_numpy(np.int64), b["event_id"].to_numpy(np.int64), b["state"].to_numpy(object)) for b in batches]
        us, event, state = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((event, us))
        out = []
        for t, e, s in zip(us[order].tolist(), event[order].tolist(), state[order].tolist()):
            end = s is not None and s.split(" ")[0] in ends
            if run and run[6]:
                if (t, e) <= (run[2], run[3]):
                    continue  # older than the end of its job's last run
                run = None
            if run and t > run[2] + silence:
                out.append(row(job, run, "silent"))
                run = None
            if run is None:
                run = [e, t, t, e, s, 0, False]
            run[5] += 1
            if (t, e) >= (run[2], run[3]):
                run[2:5] = t, e, s
            elif end:
                run[4] = s
            if end:
                run[6] = True
                out.append(row(job, run, "ended"))
        mark = kept.getCurrentWatermarkMs()
        due = run[2] // 1000 + (0 if run[6] else silence // 1000)
        if due > mark:  # a run that has ended keeps its place until the watermark has passed it
            kept.update(tuple(run))
            kept.setTimeoutTimestamp(due)
        elif kept.exists:
            kept.remove()
        if not run[6]:
            out.append(row(job, run, "open" if due > mark else "silent"))
        if out:
            yield frame(out)

    rows = ev.where("job is not null").withWatermark("ts", f"{delay_hours} hours").select(
        F.col("job").cast("bigint").alias("job"), "ts", F.unix_micros("ts").alias("us"),
        F.col("event_id").cast("bigint").alias("event_id"), "state")
    return rows.groupBy("job").applyInPandasWithState(step, RUN, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def _batches(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches that were written whole."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batch_id=*/_SUCCESS")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def read_runs(spark: SparkSession, table: str) -> DataFrame:
    """The runs that a stream has found so far, each as last emitted."""
    whole = [f"{table}/changes/batch_id={k}" for k in _batches(spark, f"{table}/changes")]
    if not whole:
        raise FileNotFoundError(f"no batch is published in {table}")
    rows = spark.read.option("basePath", f"{table}/changes").parquet(*whole)
    columns = [c for c in rows.columns if c not in ("batch_id", "job", "first_event")]
    return rows.groupBy("job", "first_event").agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select(
        "job", "first_event", "r.*")


def open_runs(spark: SparkSession, table: str) -> DataFrame:
    """The open runs after the last batch: one row for each job that has one."""
    return spark.read.parquet(f"{table}/open/batch_id={_batches(spark, f'{table}/open')[-1]}")


def _publish(table: str):
    """``foreachBatch``: the changes of a batch as a folder of their own, then
    the open runs: those before it whose job it does not touch, and its own.
    A batch that runs again replaces its folders."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/changes/batch_id={batch_id}")
        changed = spark.read.parquet(f"{table}/changes/batch_id={batch_id}")
        now = changed.where("status = 'open'")
        before = [k for k in _batches(spark, f"{table}/open") if k < batch_id]
        if before:
            rest = spark.read.parquet(f"{table}/open/batch_id={before[-1]}")
            now = now.unionByName(rest.join(changed.select("job").distinct(), "job", "left_anti"))
        now.write.mode("overwrite").parquet(f"{table}/open/batch_id={batch_id}")
        for k in before[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/open/batch_id={k}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return publish


def _start(spark: SparkSession, source: str, schema: str | StructType, table: str, checkpoint: str,
           terminal: Sequence[str], silence_hours: int, delay_hours: int, files_per_trigger: int | None, **trigger):
    ev = job_events(file_stream(spark, schema, files_per_trigger).parquet(source), zoned=True)
    return (run_changes(ev, terminal, silence_hours, delay_hours).writeStream.outputMode("update")
            .foreachBatch(_publish(table)).option("checkpointLocation", checkpoint).trigger(**trigger).start())


def stream_runs(spark: SparkSession, source: str, schema: str | StructType, table: str, checkpoint: str,
                terminal: Sequence[str] = TERMINAL_STATES, silence_hours: int = SILENCE_HOURS,
                delay_hours: int = DELAY_HOURS, files_per_trigger: int | None = None) -> list[dict]:
    """Drain a folder of event files into ``table``; returns the progress of
    the batches (their rows of state among it).  A later call goes on where
    the checkpoint ends."""
    q = _start(spark, source, schema, table, checkpoint, terminal, silence_hours, delay_hours, files_per_trigger,
               availableNow=True)
    q.awaitTermination()
    return [p if isinstance(p, dict) else p.jsonValue for p in q.recentProgress]


def watch_runs(spark: SparkSession, source: str, schema: str | StructType, table: str, checkpoint: str,
               terminal: Sequence[str] = TERMINAL_STATES, silence_hours: int = SILENCE_HOURS,
               delay_hours: int = DELAY_HOURS, poll: str = "2 seconds", timeout_s: float = 600.0) -> None:
    """Follow a folder of event files until no run is open.

    The check reads the open runs alone, whose number falls as jobs end.
    Raises TimeoutError if runs are still open after ``timeout_s``; a stream
    that failed raises its error."""
    q = _start(spark, source, schema, table, checkpoint, terminal, silence_hours, delay_hours, None, processingTime=poll)
    clock = threading.Event()
    waited = 0.0
    try:
        while q.isActive and waited < timeout_s:
            clock.wait(0.5)
            waited += 0.5
            if _batches(spark, f"{table}/open") and open_runs(spark, table).isEmpty():
                return
    finally:
        failure = q.exception()
        q.stop()
    if failure is not None:
        raise failure
    raise TimeoutError(f"runs are still open after {timeout_s} s")
