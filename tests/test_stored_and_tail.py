"""Tables stored apart, files followed by byte, scores of files that come twice."""

import os

import pytest
from pyspark.sql import functions as F

from tagtide.operators.metrics import score
from tagtide.session import scratch_path
from tagtide.sources.stored import pair, store
from tagtide.streaming.feeds import stream_score
from tagtide.streaming.status import read_published
from tagtide.streaming.tail import stream_tail


def test_tables_stored_apart_are_paired_without_an_exchange(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("part"), F.col("id").alias("pos"),
                                 (F.col("id") * 2).alias("a"), (F.col("id") * 5).alias("b"))
    key = ["part", "pos"]
    left = spark.table(store(df.select(*key, "a"), "left", key, buckets=7))
    right = spark.table(store(df.select(*key, "b").where("pos % 10 > 0"), "right", key, buckets=7))
    both = pair(left, right, key)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {tuple(r) for r in both.collect()} == {(i % 3, i, 2 * i, 5 * i) for i in range(500) if i % 10}


def test_appended_lines_are_read_once_and_a_half_line_waits(spark, tmp_path):
    src, table, ckpt = str(tmp_path / "src"), scratch_path(spark, "tail"), scratch_path(spark, "tail-ckpt")
    os.mkdir(src)
    long = "x" * 300
    steps = [{"a": "one\ntwo\nhal", "b": ""}, {"a": "f\n\nfour\r\n", "b": f"{long}\nb\u00e9"},
             {"b": " end\n", "_skip": "no\n", "c": "never ended"}]
    whole = [{"one", "two"}, {"one", "two", "half", "", "four\r", long},
             {"one", "two", "half", "", "four\r", long, "b\u00e9 end"}]
    for step, want in zip(steps, whole):
        for name, text in step.items():
            with open(f"{src}/{name}", "ab") as f:
                f.write(text.encode())
        for _ in range(2):  # nothing new: nothing again
            stream_tail(spark, src, table, ckpt, range_bytes=5)
        rows = spark.read.parquet(table).collect()
        assert len(rows) == len(want) and {r["line"] for r in rows} == want
    for r in rows:
        with open(r["file"], "rb") as f:
            f.seek(r["at"])
            assert f.readline() == r["line"].encode() + b"\n"


def test_a_file_shorter_than_what_was_read_raises(spark, tmp_path):
    src, table, ckpt = str(tmp_path / "src"), scratch_path(spark, "tail"), scratch_path(spark, "tail-ckpt")
    os.mkdir(src)
    for text in ("one\ntwo\n", "one\n"):
        with open(f"{src}/a", "w") as f:
            f.write(text)
        if text == "one\n":
            with pytest.raises(Exception, match="shorter than what was read"):
                stream_tail(spark, src, table, ckpt)
        else:
            stream_tail(spark, src, table, ckpt)


def test_sentences_delivered_again_count_once(spark):
    rows = [("en", d, n, ["B-PER", "O"], ["B-PER", "O" if n else "B-LOC"]) for d in range(4) for n in range(3)]
    schema = "lang string, doc_id bigint, line_no bigint, gold array<string>, pred array<string>"
    df = spark.createDataFrame(rows, schema)
    src, table, ckpt = (scratch_path(spark, n) for n in ("once-src", "once", "once-ckpt"))
    for part in (df.where("doc_id < 2"), df, df.where("doc_id >= 2")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream_score(spark, src, table, ckpt, files_per_trigger=1, once_within="1 day")
    assert [tuple(r) for r in read_published(spark, table).collect()] == [tuple(r) for r in score(df).collect()]
