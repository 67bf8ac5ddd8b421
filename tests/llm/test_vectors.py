"""Vector codes against plain integer loops; boxes, curves and decoding on their own."""

import hashlib
import math
from itertools import product

import numpy as np
import pytest

from limnos.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id string"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    w = width // parts
    whole = [[math.floor(float(np.float32(x)) * scale) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(x)) for x in kept[k][1]]))
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(whole[k], p) for k in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for v in whole:
                own[near(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(o) for x in zip(*o)] if o else e for o, e in zip(own, book)]
    found = [[near(cut(v, p), book) for p, book in enumerate(books)] for v in whole]
    error = [sum(d for d, _ in f) for f in found]
    label = {}
    for (_, _, y), e in zip(kept, error):
        label[y] = label.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, label[y], digest) for (i, _, y), f, e in zip(kept, found, error))


def report(spark, rows):
    df = spark.createDataFrame([(i, v, y, None, None) for i, v, y in rows], SCHEMA).repartition(3)
    return sorted((str(r[0]), *r[1:]) for r in vectors.code_report(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def some(seed, n, width, spread=1.0):
    rng = np.random.default_rng(seed)
    center = rng.normal(0, spread, (5, width))
    return [(int(i), [float(x) for x in center[rng.integers(5)] + rng.normal(0, 0.1, width)], None if rng.random() < 0.2 else int(rng.integers(3))) for i in rng.permutation(n)]


@pytest.mark.parametrize(("seed", "n", "width", "spread"), [(1, 300, 64, 0.2), (2, 120, 16, 5.0), (3, 9, 8, 1.0), (4, 200, 24, 3e4)])
def test_codes(spark, seed, n, width, spread):
    rows = some(seed, n, width, spread)
    assert report(spark, rows) == brute(rows)


def test_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 37)
    rows = some(5, 260, 16)
    assert report(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Null vectors, null, infinite and missing components, short and empty vectors, repeated ids and rows, a null id, ties."""
    nan, inf = float("nan"), float("inf")
    rows = some(6, 40, 11) + [(3, None, 1), (41, [1.0, None], 2), (42, [nan] * 11, 0), (43, [1.0, -inf], 0), (44, [], 1), (45, [0.5], None), (1, [0.25] * 11, 2), (1, [0.25] * 11, 2), (None, [-0.25] * 11, None)]
    assert report(spark, rows) == brute(rows)
    same = [(k, [0.5] * 8, 0) for k in range(50)]
    assert report(spark, same) == brute(same)
    assert report(spark, [(1, None, None), (2, [nan], 0)]) == []
    assert report(spark, [(1, [], 0)]) == brute([(1, [], 0)])
    assert vectors.code_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_too_large(spark):
    with pytest.raises(Exception, match="64 bits"):
        report(spark, [(1, [1e30] * 8, 0), (2, [-1e30] * 8, 0)])


def test_shortlists_hold_the_nearest():
    rng = np.random.default_rng(7)
    entries = rng.integers(-900, 900, (12, 4))
    points = (entries[rng.integers(0, 12, 20_000)] + rng.integers(-90, 90, (20_000, 4))).T.copy()
    blocks = vectors.Blocks.of(points)
    listed = blocks.shortlists(entries)
    code, error = blocks.nearest(entries)
    d = ((points[None] - entries[:, :, None]) ** 2).sum(axis=1)
    assert (code == d.argmin(axis=0)).all() and (error == d.min(axis=0)).all()
    assert listed[code[blocks.place], np.arange(20_000) // vectors.BLOCK].all() and listed.mean() < 0.5
    count, sums = blocks.sums_by_entry(entries)
    assert (count == np.bincount(code, minlength=12)).all() and all((sums[k] == points[:, code == k].sum(axis=1)).all() for k in range(12))


def test_a_curve_without_jumps():
    cells = np.array(list(product(range(8), repeat=3))).T
    whole = np.array(list(product(range(64), repeat=2))).T
    order = whole[:, np.argsort(vectors.hilbert_keys(whole), kind="stable")]
    assert (np.abs(np.diff(order, axis=1)).sum(axis=0) == 1).all()
    assert len(set(vectors.hilbert_keys(cells).tolist())) == 512


def test_decoding(spark):
    rows = some(8, 60, 16, 0.1)
    df = spark.createDataFrame([(i, v, y, None, None) for i, v, y in rows], SCHEMA)
    coded, books = vectors.compress_vectors(df)
    got = {r["vec_id"]: r for r in vectors.decode_vectors(coded, books).collect()}
    for i, v, _ in rows:
        off = sum((math.floor(np.float32(x) * 4096) - round(y * 4096)) ** 2 for x, y in zip(v, got[i]["decoded"]))
        assert off == got[i]["error"]
