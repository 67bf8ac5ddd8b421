"""Mixing sources to target weights by cube-method balanced sampling.

A document's expected copies are its source's target over its source's size. The whole part is taken; the fractional parts are inclusion
probabilities. They move through the null space of the balancing constraints (words and documents), each move settling a document, in
blocks of a source and then, block by block, over what the blocks left open, until fewer documents than a block are open in each source: the landing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, arrow_schema, free_names, materialize

#: Weights of sources by code point, null last, repeating (fixed by the contract).
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a table of sources that is broadcast.
_MOST_BROADCAST = 200_000


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> list[tuple[str | None, int, float]]:
    """(source, size, target): `share` of all sizes split by weight, none above `cap` times its source's size, excess shared again by weight."""
    sizes = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))])
    n = np.array([x[1] for x in sizes], float)
    target, full, left = np.zeros(len(n)), np.zeros(len(n), bool), share * n.sum()
    while len(n) and not full.all():
        part = left * w / w[~full].sum()
        over = ~full & (part > cap * n)
        if not over.any():
            target[~full] = part[~full]
            break
        target[over] = cap * n[over]
        left -= target[over].sum()
        full |= over
    return [(s, int(m), float(t)) for (s, m), t in zip(sizes, target)]


def flight(prob: np.ndarray, balance: np.ndarray, rng: np.random.Generator, spare: int = 0) -> np.ndarray:
    """Moves probabilities until at most as many as there are constraints are open, besides the last `spare` (fast flight: one more document than constraints moves at a time)."""
    eps = 1e-9
    out = prob.copy()
    out[out < eps], out[out > 1 - eps] = 0, 1
    open_ = [int(i) for i in np.flatnonzero((out > 0) & (out < 1))]
    open_ = open_[: max(0, len(open_) - spare)]
    k = balance.shape[1]
    a = balance / np.where(np.abs(balance).max(0) > 0, np.abs(balance).max(0), 1)
    hand, at = open_[: k + 1], k + 1
    while len(hand) > k:
        u = np.linalg.svd(a[hand].T)[2][-1]
        u[np.abs(u) < 1e-12] = 0
        p = out[hand]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        p = p + u * (up if rng.random() * (up + down) < down else -down)
        p[p < eps], p[p > 1 - eps] = 0, 1
        out[hand] = p
        hand = [i for i in hand if 0 < out[i] < 1]
        need = k + 1 - len(hand)
        hand, at = hand + open_[at : at + need], at + need
    return out


def landing(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settles the last few: of all outcomes for at most twelve open documents the one whose words, then count, are nearest to what was expected; more open ones fly on words alone first."""
    out = prob.copy()
    open_ = np.flatnonzero((out > 0) & (out < 1))
    if len(open_) > 12:
        out[open_] = flight(out[open_], size[open_, None].astype(float), rng)
        open_ = np.flatnonzero((out > 0) & (out < 1))
    if len(open_):
        ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        off = np.abs(ways @ size[open_] - (out[open_] * size[open_]).sum())
        count = np.abs(ways.sum(1) - out[open_].sum())
        out[open_] = ways[np.lexsort((count, off))[0]]
    return out


def _fly(rows: DataFrame, last: bool, seed: int) -> DataFrame:
    """One round: rows (key, block, size, p, whole) grouped by block; open probabilities fly, at the last round they land."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("id", "ascending")])
        p, size = table.column("p").to_numpy().copy(), table.column("size").to_numpy()
        rng = np.random.default_rng([seed, len(p), int(abs(table.column("order")[0].as_py()))])
        p = flight(p, np.column_stack([size, np.ones(len(p))]), rng, 10 if last else 0)
        if last:
            p = landing(p, size, rng)
        return table.set_column(table.schema.get_field_index("p"), table.schema.field("p"), pa.array(p))

    return rows.groupBy("block").applyInArrow(run, rows.schema)


def _table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows of the driver as a DataFrame, by Arrow: from a list Spark would start Python workers on the executors."""
    schema = arrow_schema(ddl)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema), ddl)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = 2_000, seed: int = 11) -> DataFrame:
    """id, source, size, source_size, target, copies, taken for every document.

    Blocks hold about `block` documents of one source; what they leave open (two at most each) is blocked again until a source has one
    block. The table of sources, a row each, is the only thing on the driver. Null sources are one source, null texts have size 0 and are
    taken 0 words. Repeated ids are documents of their own. Same input, same result."""
    # what follows needs no text
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"))
    base = materialize(base.withColumn("order", F.xxhash64("id", "size", F.lit(seed))), "mix-sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()  # a row for each source
    spark = docs.sparkSession
    count = {r["source"]: r["docs"] for r in totals}
    plan = [(i, s, n, t, count[s]) for i, (s, n, t) in enumerate(source_targets([(r["source"], r["n"]) for r in totals], share, cap, weights))]
    table = _table(spark, plan, f"source_no int, source {base.schema['source'].dataType.simpleString()}, source_size long, target double, docs long")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    narrow = F.broadcast if len(plan) <= _MOST_BROADCAST else lambda df: df  # beyond it the tables of sources are joined by a shuffle
    rows = base.withColumnRenamed("source", "own").join(narrow(table), F.col("own").eqNullSafe(F.col("source"))).drop("own")
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")).drop("rate")

    def blocked(df: DataFrame, n: Column) -> DataFrame:
        return df.withColumn("block", F.concat_ws(":", "source_no", F.pmod(F.xxhash64("order", "id"), F.greatest(F.lit(1), F.ceil(n / block)))))

    most = max(count.values(), default=0)
    rows = blocked(rows, F.col("docs"))
    done = []
    while True:
        last = most <= block
        rows = materialize(_fly(rows, last, seed), "mix-round")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        if last:
            done.append(rows)
            break
        done.append(rows.where(~is_open))
        left = rows.where(is_open)
        open_count = {r["source_no"]: r["n"] for r in left.groupBy("source_no").agg(F.count("*").alias("n")).collect()}
        most = max(open_count.values(), default=0)
        counts = _table(spark, list(open_count.items()), "source_no int, open long")
        rows = blocked(left.join(narrow(counts), "source_no"), F.col("open")).drop("open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + (F.col("p") > 0.5).cast("long")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, in the cases of `mix_sources`."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents as the mix takes them, all columns and no others: none, one or two rows of each. Columns of any name may be there.

    Documents with equal id, source and size are told apart by nothing that matters to the mix: their copies are dealt out in the order of a hash of their texts."""
    size, copies, rows, n, i, s, z = free_names(docs, "size", "copies", "rows", "n", "mix_id", "mix_source", "mix_size")
    got = mix_sources(docs, id_col, text_col, source_col, **options)
    per = got.groupBy(F.col(id_col).alias(i), F.col(source_col).alias(s), F.col("size").alias(z)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    met = docs.withColumn(size, text_size(F.col(text_col))).join(per, (F.col(size) == F.col(z)) & F.col(id_col).eqNullSafe(F.col(i)) & F.col(source_col).eqNullSafe(F.col(s)))
    each, over = F.floor(F.col(copies) / F.col(rows)), F.col(copies) % F.col(rows)
    same = met.where(over == 0).withColumn(n, each)
    w = Window.partitionBy(id_col, source_col, size).orderBy(F.xxhash64(text_col))
    odd = met.where(over != 0).withColumn(n, each + (F.row_number().over(w) <= over).cast("long"))
    out = same.unionByName(odd).where(F.col(n) > 0)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
