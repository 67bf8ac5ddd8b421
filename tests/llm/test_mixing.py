"""Cube sampling: inclusion probabilities over many draws, the balance it keeps, the landing against all outcomes, targets against plain sharing, queries with many sources."""

from itertools import product

import numpy as np
import pytest

from limnos.llm import mixing


def plain_targets(sizes, share=1.5, cap=2.0):
    """Shares the total by weight; what is over a cap is fixed there and the rest shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
    left, fixed = share * sum(n for _, n in order), {}
    while True:
        open_ = [(s, n) for s, n in order if s not in fixed]
        part = {s: left * weight[s] / sum(weight[t] for t, _ in open_) for s, _ in open_}
        over = [(s, n) for s, n in open_ if part[s] > cap * n]
        if not over:
            return {**fixed, **part}
        for s, n in over:
            fixed[s] = cap * n
            left -= fixed[s]


@pytest.mark.parametrize("seed", range(6))
def test_targets(seed):
    rng = np.random.default_rng(seed)
    sizes = [(f"s{i}", int(n)) for i, n in enumerate(rng.integers(0, 1000, rng.integers(1, 9)))] + [(None, 50)] * (seed % 2)
    got = {s: t for s, _, t in mixing.source_targets(sizes)}
    assert got == pytest.approx(plain_targets(sizes))


def test_flight_keeps_balance_and_probabilities():
    rng = np.random.default_rng(0)
    p, size = rng.uniform(0.05, 0.95, 40), rng.integers(1, 500, 40).astype(float)
    balance = np.column_stack([size, np.ones(40)])
    draws = []
    for k in range(3000):
        out = mixing.flight(p, balance, np.random.default_rng(k))
        still = (out > 0) & (out < 1)
        assert still.sum() <= 2 and out @ size == pytest.approx(p @ size) and out.sum() == pytest.approx(p.sum())
        draws.append(mixing.landing(out, size, np.random.default_rng(k)))
    draws = np.array(draws)
    assert set(np.unique(draws)) <= {0.0, 1.0}
    assert np.abs(draws.mean(0) - p).max() < 0.06  # 3,000 draws: five standard deviations are 0.046, the landing adds a little
    assert np.abs(draws @ size - p @ size).max() <= size.max()


def test_landing_is_the_nearest_outcome():
    rng = np.random.default_rng(1)
    for k in range(30):
        n = int(rng.integers(1, 8))
        p, size = rng.uniform(0.01, 0.99, n), rng.integers(0, 60, n).astype(float)
        got = mixing.landing(p, size, np.random.default_rng(k))
        best = min((abs(np.dot(w, size) - p @ size), abs(sum(w) - p.sum())) for w in product((0, 1), repeat=n))
        assert (abs(got @ size - p @ size), abs(got.sum() - p.sum())) == pytest.approx(best)


@pytest.mark.parametrize("most", [200_000, 1])
def test_report_over_sources(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "_MOST_BROADCAST", most)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("w" for _ in range(rng.integers(0, 40))), f"s{rng.integers(0, 7)}" if i % 11 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block=50).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = plain_targets(list(sizes.items()))
    by = {i: (t, s) for i, t, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        n = len(by[r["doc_id"]][0].split())
        assert r["size"] == n and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        rate = targets[r["source"]] / sizes[r["source"]]
        assert r["copies"] in (int(rate), int(rate) + 1) and r["taken"] == r["copies"] * n <= 2 * n
        taken[r["source"]] += r["taken"]
    assert len(got) == 700 and all(abs(taken[s] - targets[s]) <= 40 for s in sizes)
    again = mixing.mix_sources(docs.repartition(5), block=50).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
