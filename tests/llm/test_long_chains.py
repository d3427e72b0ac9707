"""Marginals of long chains: worked through in parts, equal to the chain in one."""

import time

import numpy as np
import pytest

from tagtide.llm import toxicity


@pytest.mark.parametrize("segment", [1, 3, 7, 128])
def test_marginals_do_not_depend_on_the_parts(monkeypatch, segment):
    rng = np.random.default_rng(segment)
    sizes = [1, 2, 400, 130, 128, 129, 5, 1000, 3]
    start = np.r_[0, np.cumsum(sizes)]
    score, trans = rng.normal(0, 2, start[-1]), np.array([[1.0, -1.5], [-0.5, 2.0]])
    monkeypatch.setattr(toxicity, "SEGMENT", 10_000)
    want, pairs = toxicity.marginals(score, start, trans)
    monkeypatch.setattr(toxicity, "SEGMENT", segment)
    got, got_pairs = toxicity.marginals(score, start, trans)
    assert np.allclose(got, want, atol=1e-10) and np.allclose(got_pairs, pairs, atol=1e-8)
    assert pairs.sum() == pytest.approx(sum(s - 1 for s in sizes))


def test_a_line_of_ten_thousand_tokens_is_one_chain():
    words, offsets, starts = toxicity.chains("word " * 10_000 + "\nnext line")
    assert len(words) == len(offsets) == 10_002 and starts == [0, 10_000]
    t = time.thread_time()
    p, _ = toxicity.marginals(np.zeros(10_000), np.array([0, 10_000]), np.array([[2.0, 0.0], [0.0, 2.0]]))
    assert time.thread_time() - t < 1 and np.allclose(p, 0.5)
