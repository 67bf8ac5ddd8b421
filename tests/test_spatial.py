"""Covers of several sizes: large and small polygons and lines against plain loops, with a bound on rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from limnos.operators import kdtree, spatial


def ring(cx, cy, r, n, rng):
    a = np.sort(rng.uniform(0, 2 * math.pi, n))
    return [(float(cx + r * s * math.cos(t)), float(cy + r * s * math.sin(t))) for t, s in zip(a, rng.uniform(0.5, 1, n))]


def inside(x, y, points):
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_large_and_small_polygons(spark):
    rng = np.random.default_rng(1)
    polygons = {0: ring(0, 0, 1e6, 60, rng), 1: ring(2e5, 1e5, 4e5, 9, rng)}
    for k in range(2, 60):
        polygons[k] = ring(float(rng.uniform(-3000, 3000)), float(rng.uniform(-3000, 3000)), float(rng.uniform(5, 400)), 7, rng)
    edges = [(k, x1, y1, x2, y2) for k, p in polygons.items() for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1])] + [(99, None, 1.0, 2.0, 3.0)]
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate([*rng.uniform(-3000, 3000, (150, 2)), *rng.uniform(-1.2e6, 1.2e6, (80, 2))])] + [(900, None, 1.0)]
    e = spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(points, "pt int, x double, y double")
    got = {tuple(r) for r in spatial.points_in_polygons(p, e, "pt", "poly", 100.0).select("pt", "poly").collect()}
    assert got == {(i, k) for i, x, y in points if x is not None for k, ring_ in polygons.items() if inside(x, y, ring_)} and len(got) > 100
    box = e.groupBy("poly").agg(*[f(c).alias(n) for n, f, c in (("a", F.min, "x1"), ("b", F.max, "x1"), ("c", F.min, "y1"), ("d", F.max, "y1"))])
    cover = spatial._cover(box, F.col("a"), F.col("b"), F.col("c"), F.col("d"), 100.0)
    assert cover.groupBy("poly").count().agg(F.max("count")).first()[0] <= 25


def test_long_and_short_lines(spark):
    rng = np.random.default_rng(2)
    segments = [(0, -1e6, -1e6, 1e6, 1e6), (1, 0.0, 0.0, 0.0, 0.0)]
    for k in range(2, 80):
        x, y, dx, dy = (float(v) for v in (*rng.uniform(-2000, 2000, 2), *rng.uniform(-300, 300, 2)))
        segments.append((k, x, y, x + dx, y + dy))
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-2200, 2200, (200, 2)))] + [(900, None, 1.0)]
    got = {r["pt"]: (r["line"], round(r["dist"], 6)) for r in spatial.nearest_line(spark.createDataFrame(points, "pt int, x double, y double"), spark.createDataFrame(segments, "line int, x1 double, y1 double, x2 double, y2 double"), "pt", "line", 150.0, 50.0).collect()}

    def far(x, y, x1, y1, x2, y2):
        d = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = min(1, max(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / d)) if d else 0
        return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

    want = {}
    for i, x, y in points:
        if x is not None:
            dist, line = min((far(x, y, *s[1:]), s[0]) for s in segments)
            if dist <= 150:
                want[i] = (line, round(dist, 6))
    assert got == want and len(want) > 50


def test_nearest_of_clustered_points_and_remote_keys(spark, monkeypatch):
    """Two dense towns, a few far points, keys among them and on the other side of the globe: as all pairs give it, with a bound on the pairs that meet."""
    monkeypatch.setattr(kdtree, "LEAF", 16)
    monkeypatch.setattr(kdtree, "KEYS", 100)
    rng = np.random.default_rng(4)
    town = lambda lat, lon, n: [(float(lat + a), float(lon + b)) for a, b in rng.normal(0, 1e-3, (n, 2))]
    places = town(59, 18, 500) + town(-33, 151, 300) + [(float(a), float(b)) for a, b in rng.uniform(-80, 80, (40, 2))] + [(10.0, 10.0)] * 6
    points = [(k, a, b) for k, (a, b) in enumerate(places)] + [(5000, None, 1.0)]
    keys = [(k, a, b) for k, (a, b) in enumerate(town(59, 18, 150) + town(-33.01, 151, 60) + town(0, -179.999, 10) + [(89.9, 5.0), (-90.0, 0.0), (10.0, 10.0)])] + [(900, None, None)]
    left, right = spark.createDataFrame(keys, "id int, lat double, lon double"), spark.createDataFrame(points, "p int, rlat double, rlon double")

    def far(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    for k in (1, 4):
        got = {}
        for r in spatial.nearest_on_sphere(left, right, "id", "p", k).collect():
            got.setdefault(r["id"], {})[r["rank"]] = r["p"]
        for i, a, b in keys:
            if a is not None:
                want = sorted((round(far(a, b, c, d), 3), p) for p, c, d in points if c is not None)[:k]
                assert [got[i][r] for r in range(1, k + 1)] == [p for _, p in want]
        assert 900 not in got
    assert spatial.nearest_on_sphere(left, right.limit(0), "id", "p", 3).count() == 0
    few = spatial.nearest_on_sphere(left, right.where("p < 2"), "id", "p", 5)
    assert few.count() == 2 * (len(keys) - 1)


def test_leaves_are_even_and_visits_few():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1e-4, (6000, 3)), rng.uniform(-1, 1, (2000, 3))])
    tree = kdtree.Tree.of(x, 64)
    leaf = tree.leaf_of(x)
    size = np.bincount(leaf, minlength=64)
    assert size.min() > 60 and size.max() < 200
    tree.leaf = np.arange(64)
    tree.low, tree.high = (np.stack([f(x[leaf == k], axis=0) for k in range(64)]) for f in (np.min, np.max))
    tree.count = size
    keys = np.concatenate([x[::40], rng.uniform(-3, 3, (50, 3))])
    d = np.sort(((keys[:, None] - x[None]) ** 2).sum(axis=2), axis=1)
    assert (tree.bound(keys, 5) >= d[:, 4]).all()
    assert (tree.near(keys) <= d[:, 4][:, None]).sum(axis=1).mean() < 12
