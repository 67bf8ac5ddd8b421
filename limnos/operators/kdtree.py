"""Nearest neighbours over the leaves of a k-d tree: leaves hold about as many points each however these cluster, and a key visits only leaves that can hold one of its nearest."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.sinks import scratch

#: Points of a leaf, and leaves at most; the tree's splits come from a sample of so many points at most.
LEAF, MOST_LEAVES, SAMPLE = 256, 1 << 16, 200_000
#: Keys of a leaf that are one task's work.
KEYS = 100_000


@dataclass
class Tree:
    """Splits of a complete binary tree, by node in the order of levels; and, of its leaves with points, boxes and counts."""

    axis: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    count: np.ndarray | None = None

    @classmethod
    def of(cls, sample: np.ndarray, leaves: int) -> "Tree":
        """Splits at the median of the widest axis until there are as many leaves (a power of two) as asked for, or more."""
        nodes = (1 << max(0, leaves - 1).bit_length()) - 1
        axis, cut, parts = np.zeros(nodes, np.int64), np.zeros(nodes), [sample]
        for i in range(nodes):
            own = parts[i]
            if len(own):
                a = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                axis[i], cut[i] = a, np.median(own[:, a])
            right = own[:, axis[i]] > cut[i]
            parts += [own[~right], own[right]]
        return cls(axis, cut)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.axis[at]] > self.cut[at])
        return at - len(self.axis)

    def near(self, x: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Squared distances (points, leaves) to the boxes."""
        gap = np.maximum(np.maximum(self.low[some][None] - x[:, None], x[:, None] - self.high[some][None]), 0)
        return (gap * gap).sum(axis=2)

    def bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each of x a squared distance within which k points lie, from boxes and counts alone."""
        out = np.empty(len(x))
        for s in range(0, len(x), 256):
            p = x[s : s + 256, None]
            far = np.maximum(np.abs(p - self.low[None]), np.abs(p - self.high[None]))
            far = (far * far).sum(axis=2)
            order = np.argsort(far, axis=1)
            enough = (np.cumsum(self.count[order], axis=1) >= k).argmax(axis=1)
            out[s : s + 256] = far[np.arange(len(far)), order[np.arange(len(far)), enough]]
        return out


def _axes(t: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in names], axis=1)


def _with_leaf(df: DataFrame, axes: list[str], tree: Tree) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf_of(_axes(b, axes)))], names=[*b.schema.names, "leaf_"])

    return df.mapInArrow(run, df.select("*", F.lit(0).cast("long").alias("leaf_")).schema)


def _dealt(keys: DataFrame, points: DataFrame, key: str, schema, step) -> DataFrame:
    """step(keys of a leaf, its points) over all leaves; the keys of a leaf that very many visit are dealt out, each part with the leaf's points."""
    spark = keys.sparkSession
    crowded = keys.groupBy("leaf_").count().where(F.col("count") > KEYS).select("leaf_", F.ceil(F.col("count") / KEYS).cast("int").alias("parts_")).collect()  # at most one for each KEYS keys
    sides = []
    for name, df in (("kparts_", keys), ("pparts_", points)):
        if crowded:
            held = spark.createDataFrame(crowded, "leaf_ long, parts_ int").withColumnRenamed("parts_", name)
            df = df.join(F.broadcast(held), "leaf_", "left")
        sides.append(df.withColumn(name, F.coalesce(name, F.lit(1)) if crowded else F.lit(1)))
    keys = sides[0].withColumn("part_", F.pmod(F.xxhash64(key), F.col("kparts_")).cast("int")).drop("kparts_")
    points = sides[1].withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("pparts_") - 1))).drop("pparts_")
    return keys.groupBy("leaf_", "part_").cogroup(points.groupBy("leaf_", "part_")).applyInArrow(step, schema)


def nearest_pairs(keys: DataFrame, points: DataFrame, key: str, other: str, k: int, axes: int, slack: float, far: float = float("inf")) -> DataFrame:
    """All columns of keys and points for pairs among which are, for every key, its k nearest points: those whose distance exceeds the k-th least by `slack` at most, and that lie within `far` (and `slack`). keys have coordinates l0_, l1_.., points r0_, r1_.., no two columns one name; fewer than k points: all pairs.

    Two rounds: each key meets the leaf that it lies in, which bounds the distance of its k-th neighbour, and then the other leaves whose boxes lie within that bound."""
    spark = keys.sparkSession
    ls, rs = [f"l{i}_" for i in range(axes)], [f"r{i}_" for i in range(axes)]
    schema = keys.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema]).schema
    n = points.count()
    if not n:
        return spark.createDataFrame([], schema)
    k = min(k, n)
    some = points.select(*rs) if n <= SAMPLE else points.where(F.xxhash64(other, F.lit("tree")) < int(-(2**63) + 0.9 * SAMPLE / n * 2**64)).select(*rs)
    tree = Tree.of(_axes(some.toArrow(), rs), min(MOST_LEAVES, max(1, n // max(LEAF, 2 * k))))  # some SAMPLE rows
    where = []
    for name, df, cs in (("points", points, rs), ("keys", keys, ls)):
        path = scratch(spark, f"leaf-{name}")
        _with_leaf(df, cs, tree).write.parquet(path)
        where.append(spark.read.parquet(path))
    points, keys = where
    boxes = points.groupBy("leaf_").agg(F.count("*").alias("n"), *[f(c).alias(f"{a}{c}") for c in rs for a, f in (("a", F.min), ("b", F.max))]).orderBy("leaf_").toArrow()  # a row for each leaf
    tree.leaf, tree.count = boxes.column("leaf_").to_numpy(), boxes.column("n").to_numpy()
    tree.low, tree.high = (np.stack([boxes.column(f"{a}{c}").to_numpy() for c in rs], axis=1) for a in "ab")

    def closest(own: pa.Table, there: pa.Table, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of keys, rows of points, bounds): pairs within the lesser of the bound and the k-th distance here."""
        x, y, out = _axes(own, ls), _axes(there, rs), [[], []]
        step = max(1, 2_000_000 // max(1, len(y)))
        for s in range(0, len(x), step):
            d = sum((x[s : s + step, None, i] - y[None, :, i]) ** 2 for i in range(axes))
            if len(y) >= k:
                bound[s : s + step] = np.minimum(bound[s : s + step], np.partition(d, k - 1, axis=1)[:, k - 1])
            a, b = np.nonzero(d <= (np.sqrt(bound[s : s + step]) + slack)[:, None] ** 2)
            out[0].append(a + s)
            out[1].append(b)
        return *(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out), bound

    target = to_arrow_schema(schema)

    def pairs(own: pa.Table, there: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.Table:
        return pa.Table.from_arrays([own.column(c).take(pa.array(a)) if c in own.column_names else there.column(c).take(pa.array(b)) for c in target.names], schema=target)

    asked = keys.select("*", F.lit(0.0).alias("bound_")).schema
    asks = to_arrow_schema(asked)

    def first(own: pa.Table, there: pa.Table) -> pa.Table:
        """The leaves that each key has to visit, its own one too, and the bound it goes with."""
        x = _axes(own, ls)
        bound = closest(own, there, np.full(len(x), np.inf))[2] if there.num_rows else np.full(len(x), np.inf)
        open_ = ~np.isfinite(bound)
        if open_.any():
            bound[open_] = tree.bound(x[open_], k)
        bound = np.minimum(bound, far * far)
        reach = np.sqrt(bound) + slack
        # all keys of a leaf lie close together: what none of them reaches is left out at once
        gap = np.maximum(np.maximum(tree.low - x.max(axis=0), x.min(axis=0) - tree.high), 0)
        some = np.flatnonzero((gap * gap).sum(axis=1) <= reach.max() ** 2)
        out = [[], []]
        for s in range(0, len(x), max(1, 1_000_000 // max(1, len(some)))):
            part = slice(s, s + max(1, 1_000_000 // max(1, len(some))))
            a, b = np.nonzero(tree.near(x[part], some) <= reach[part, None] ** 2)
            out[0].append(a + s)
            out[1].append(some[b])
        a, b = (np.concatenate(o) for o in out)
        rows = own.take(pa.array(a))
        return pa.Table.from_arrays([pa.array(tree.leaf[b]) if c == "leaf_" else pa.array(bound[a]) if c == "bound_" else rows.column(c) for c in asks.names], schema=asks)

    def second(own: pa.Table, there: pa.Table) -> pa.Table:
        if not own.num_rows or not there.num_rows:
            return target.empty_table()
        a, b, _ = closest(own, there, own.column("bound_").to_numpy().copy())
        return pairs(own, there, a, b)

    def visits(own: pa.Table, there: pa.Table) -> pa.Table:
        return first(own, there) if own.num_rows else asks.empty_table()

    asked_ = _dealt(keys, points, key, asked, visits)
    path = scratch(spark, "leaf-visits")
    asked_.write.parquet(path)
    return _dealt(spark.read.parquet(path), points, key, schema, second)
