"""Runs of jobs as a stream: state that ends, late events, and equality with the batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagtide.streaming.jobs import job_runs, open_runs, read_runs, stream_runs, watch_runs
from tagtide.streaming.status import job_events

from conftest import SMALL

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string"
T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def put(spark, folder, rows):
    """One more file, later than those before it."""
    spark.createDataFrame([(e, at(h), j, s) for e, h, j, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, tmp, **options):
    return stream_runs(spark, f"{tmp}/in", SCHEMA, f"{tmp}/out", f"{tmp}/ckpt", ["DONE"], files_per_trigger=1, **options)


def state_rows(progress):
    return progress[-1]["stateOperators"][0]["numRowsTotal"]


def found(spark, tmp):
    return {(r.job, r.first_event): (r.state, r.n_events, r.status) for r in read_runs(spark, f"{tmp}/out").collect()}


def test_state_goes_when_a_run_ends(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0, 7, "RUN"), (2, 0, 8, "RUN"), (3, 0.1, 9, "RUN")])
    assert state_rows(drain(spark, tmp_path)) == 3
    assert {r.job for r in open_runs(spark, f"{tmp_path}/out").collect()} == {7, 8, 9}
    put(spark, f"{tmp_path}/in", [(4, 1, 7, "DONE by 3"), (5, 3, 8, "RUN")])
    assert state_rows(drain(spark, tmp_path)) == 2  # the end of 7 lies behind the watermark
    assert found(spark, tmp_path) == {(7, 1): ("DONE by 3", 2, "ended"), (8, 2): ("RUN", 2, "open"), (9, 3): ("RUN", 1, "open")}
    put(spark, f"{tmp_path}/in", [(6, 27, 8, "RUN")])
    assert state_rows(drain(spark, tmp_path)) == 1  # 9 was silent for a day
    assert found(spark, tmp_path)[9, 3] == ("RUN", 1, "silent")
    assert {r.job for r in open_runs(spark, f"{tmp_path}/out").collect()} == {8}


def test_a_batch_emits_only_its_jobs(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(k, 0, k, "RUN") for k in range(50)])
    drain(spark, tmp_path)
    put(spark, f"{tmp_path}/in", [(60, 0.5, 7, "RUN")])
    drain(spark, tmp_path)
    changes = spark.read.parquet(f"{tmp_path}/out/changes").groupBy("batch_id").count().orderBy("batch_id").collect()
    sizes = [r["count"] for r in changes if r["count"]]
    assert sizes == [50, 1] and open_runs(spark, f"{tmp_path}/out").count() == 50


def test_late_events(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 10, 7, "RUN"), (2, 10.2, 7, "DONE"), (3, 10, 8, "A"), (4, 10.3, 8, "B")])
    drain(spark, tmp_path)
    # older than the run's end: nothing; in an open run: counted, its state stays; newer than the end: the next run
    put(spark, f"{tmp_path}/in", [(5, 10.1, 7, "RUN"), (6, 10.1, 8, "C"), (7, 10.4, 7, "RUN")])
    drain(spark, tmp_path)
    assert found(spark, tmp_path) == {(7, 1): ("DONE", 2, "ended"), (7, 7): ("RUN", 1, "open"), (8, 3): ("B", 3, "open")}
    put(spark, f"{tmp_path}/in", [(8, 10.2, 8, "DONE"), (9, 20, 1, "RUN")])
    drain(spark, tmp_path)
    assert found(spark, tmp_path)[8, 3] == ("DONE", 4, "ended")  # a late end ends the open run
    put(spark, f"{tmp_path}/in", [(10, 11, 8, "RUN")])  # behind the watermark: the engine drops it
    drain(spark, tmp_path)
    assert set(found(spark, tmp_path)) == {(7, 1), (7, 7), (8, 3), (1, 9)}


@pytest.mark.parametrize("files", [1, 6])
def test_stream_equals_batch_over_events(spark, tmp_path, files):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    step = -(-events.count() // files)
    order = events.select("event_id").orderBy("ts", "event_id").toPandas()["event_id"].tolist()
    for k in range(files):
        events.where(F.col("event_id").isin(order[k * step:(k + 1) * step])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream_runs(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["purchase", "error"], files_per_trigger=1)
    got = read_runs(spark, f"{tmp_path}/out")
    want = job_runs(job_events(events, zoned=True), ["purchase", "error"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r.status for r in want.select("status").distinct().collect()} == {"ended", "silent", "open"}


def test_batch_runs_do_not_depend_on_the_bucket(spark, monkeypatch):
    from tagtide.streaming import jobs
    ev = job_events(spark.read.parquet(f"{SMALL}/events.parquet"), zoned=True)
    want = sorted(map(tuple, job_runs(ev, ["purchase"]).collect()))
    monkeypatch.setattr(jobs, "BUCKET_HOURS", 1)
    assert sorted(map(tuple, job_runs(ev, ["purchase"]).collect())) == want
    assert job_runs(ev.limit(0)).count() == 0


def test_watch_returns_when_no_run_is_open_and_raises_after_its_time(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0, 7, "RUN"), (2, 0.1, 7, "DONE")])
    watch_runs(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["DONE"], poll="1 second", timeout_s=120)
    put(spark, f"{tmp_path}/in", [(3, 1, 8, "RUN")])
    with pytest.raises(TimeoutError, match="still open"):
        watch_runs(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out2", f"{tmp_path}/ckpt2", ["DONE"], poll="1 second", timeout_s=25)
