"""Longest-match splitting by joins against the plain loop."""

import random

import pytest

from tagtide.functions.vocab import greedy_pieces, split_distinct


@pytest.mark.parametrize("seed", [0, 1])
def test_split_distinct_equals_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    letters = "abé#"
    vocab = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(25)}
    vocab |= {"##" + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(40)}
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(300)] + ["", "a" * 300, "日本", None]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = split_distinct(frame, spark.createDataFrame([(p,) for p in vocab], "piece string")).collect()
    kept = [w for w in words if w is not None]
    assert {r.word: (r.n, r.pieces) for r in got} == {w: (kept.count(w), greedy_pieces(w, frozenset(vocab))) for w in kept}
    assert any(r.pieces == ["[UNK]"] for r in got) and any(len(r.pieces) > 2 for r in got)


def test_split_runs_in_the_jvm_alone(spark):
    words = spark.createDataFrame([("abc",)], "word string")
    out = split_distinct(words, spark.createDataFrame([("a",), ("##bc",)], "piece string"), max_chars=3)
    assert out.first().pieces == ["a", "##bc"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert split_distinct(words, spark.createDataFrame([("a",), ("##bc",)], "piece string"), max_chars=2).first().pieces == ["[UNK]"]
    assert split_distinct(words.limit(0), words.selectExpr("word AS piece")).count() == 0
