"""The quality model against the same regression solved in one place, and its calibration against plain pooling."""

import zlib

import numpy as np
import pytest

from limnos.llm import quality
from limnos.llm.common import isotonic, labelled_sample


def plain_isotonic(hits, rows):
    """The non-decreasing rates with the least squared error, by the min-max formula over bins that hold rows."""
    at = [i for i, n in enumerate(rows) if n]
    best = {}
    for i in at:
        best[i] = max(min(sum(hits[x] for x in at if a <= x <= b) / sum(rows[x] for x in at if a <= x <= b) for b in at if b >= i) for a in at if a <= i)
    return best


def test_isotonic():
    rng = np.random.default_rng(0)
    for _ in range(50):
        rows = rng.integers(0, 6, 12)
        hits = np.array([rng.integers(0, n + 1) for n in rows])
        got = isotonic(hits, rows)
        assert (np.diff(got) >= -1e-12).all()
        for i, x in plain_isotonic(hits, rows).items():
            assert got[i] == pytest.approx(x)


def test_the_fit_is_one_ridge_regression(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ("Clean prose, with words. " * int(rng.integers(1, 30))) if i % 3 else "$$ CLICK!! " * int(rng.integers(1, 60))) for i in range(240)]
    docs = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if i % 10 else 1 - int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels, features=20)
    train = [(quality.document_statistics(t), int(i % 3 > 0) if i % 10 else 1 - int(i % 3 > 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([t[0] for t in train]), np.array([t[1] for t in train], float)
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0) + 1e-6, abs=1e-5)
    f = model.features(x)
    penalty = np.full(f.shape[1], 1e-3 * len(x))
    penalty[-1] = 1e-6
    assert f @ model.weights == pytest.approx(f @ np.linalg.solve(f.T @ f + np.diag(penalty), f.T @ y), abs=1e-4)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    want = model.rates[model.bins(np.array([quality.document_statistics(t) for _, t in rows]))]
    assert [got[i] for i, _ in rows] == pytest.approx(want.tolist()) and 0 <= got[900] <= 1


def test_labelled_rows_under_a_share_of_hashes(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20_000)], "doc_id long, quality int")
    n = labelled_sample(labels, "quality", "doc_id", 5_000).count()
    assert 4_500 < n <= 5_000
    assert labelled_sample(labels, "quality", "doc_id", 100_000).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(20_000))
