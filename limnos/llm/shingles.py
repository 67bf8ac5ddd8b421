"""Near-dedup by the exact Jaccard similarity of word shingles, every pair found (prefix filter).

In any order of all shingles, two sets of similarity t share one among the first n - ceil(t n) + 1 of each. Shingles frequent in a sample of texts
come last in that order: what the sample misses costs time, never a pair. Sets that are equal are one class before the search. Prefixes travel once, packed
(`met_prefixes`): most of their shingles meet no other class, and only those that do become rows. First each class is
compared with one class for each shingle of its prefix, that where the shingle comes first; then only pairs that are not yet connected are.
A pair whose bitmaps of odd counts differ in more bits than similar sets can differ in shingles goes before texts are fetched and their sets compared."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, materialize, pieces, words_of
from .simhash import _LOWER, components, keep_firsts
from .substrings import _bits_for, as_bitmap

#: One text of so many is read for frequent shingles, and at most so many shingles are held.
_SAMPLE, _FREQUENT = 16, 200_000
#: Shingles of prefixes that meet in a task.
_MET = 1_000_000


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `shingle` words. Lower case is for A to Z only; fewer words than a shingle are one; no word: none."""
    words = words_of(text.translate(_LOWER)) if text else []
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    return n - ceil(similarity * n - 1e-9) + 1


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * (1 + similarity) >= similarity * (len(x) + len(y)) - 1e-9


def odd_bits(s: np.ndarray) -> bytes:
    """A bitmap of at least len(s) bits, a power of two: a bit is set if an odd number of shingles fall on it."""
    m = max(8, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & (m - 1)).astype(np.int64), minlength=m) & 1).astype(bool), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound on the shingles that are in one set only: the larger bitmap is folded to the smaller, and the bits that differ are counted."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    m = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _frequent(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts hold, sorted, with their counts; a bounded table."""

    def run(batches):
        for b in pieces(batches):
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle))], names=["t"])

    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(_SAMPLE)) == 0)
    some = some.mapInArrow(run, "t long").groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    rows = some.orderBy(F.desc("n"), "t").limit(_FREQUENT).toArrow().sort_by("t")
    return rows.column("t").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)


def _held(x: np.ndarray, often: np.ndarray) -> np.ndarray:
    return often[np.minimum(np.searchsorted(often, x), len(often) - 1)] == x if len(often) else np.zeros(len(x), bool)


def met_prefixes(classes: DataFrame, often: np.ndarray) -> DataFrame:
    """(t, c, n, at): the shingles of all prefixes that another class's prefix holds too, with their places. classes: c (unique), n, p (the prefix).

    A batch of classes is dealt out by shingle as a few rows of packed arrays. Frequent shingles (often) are rows at once and stay out of that: a shingle of many classes burdens no task."""
    total = classes.agg(F.sum(F.size("p")).alias("n")).first()["n"] or 0
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // _MET))

    def entries(b: pa.RecordBatch, frequent: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, at, t) of those that are frequent, or of the others."""
        k, t = b.column("p").value_lengths().to_numpy(), b.column("p").flatten().to_numpy()
        row, at = np.repeat(np.arange(len(k)), k), np.arange(len(t)) - np.repeat(np.cumsum(k) - k, k)
        some = _held(t, often) == frequent
        return row[some], at[some], t[some]

    def frequent(batches):
        for b in batches:
            row, at, t = entries(b, True)
            yield pa.RecordBatch.from_arrays([pa.array(t), b.column("c").take(pa.array(row)), b.column("n").take(pa.array(row)), pa.array(at.astype(np.int32))], names=["t", "c", "n", "at"])

    def packed(batches):
        for b in batches:
            row, at, t = entries(b, False)
            if not len(t):
                continue
            part = ((t.view(np.uint64) >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            row, at, t, part = row[order], at[order], t[order], part[order]
            own = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])]))  # where a class begins
            names, first = np.unique(part, return_index=True)
            outer, inner = (np.concatenate([x, [n]]).astype(np.int32) for x, n in ((np.searchsorted(own, first), len(own)), (first, len(t))))
            k = np.diff(np.concatenate([own, [len(t)]])).astype(np.int32)
            held = [b.column("c").take(pa.array(row[own])), b.column("n").take(pa.array(row[own])), pa.array(k)]
            lists = [pa.ListArray.from_arrays(pa.array(outer), x) for x in held] + [pa.ListArray.from_arrays(pa.array(inner), x) for x in (pa.array(t), pa.array(at.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(names), *lists], names=["part", "c", "n", "k", "t", "at"])

    def meet(batches):
        got = []
        for b in batches:
            flat = {c: b.column(c).flatten().to_numpy() for c in ("c", "n", "k", "t", "at")}
            got.append((flat["t"], np.repeat(flat["c"], flat["k"]), np.repeat(flat["n"], flat["k"]), flat["at"]))
        if not got:
            return
        t, c, n, at = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(t, kind="stable")
        same = np.diff(t[order]) == 0
        met = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        for s in range(0, len(met), 100_000):
            i = met[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[i]) for x in (t, c, n, at)], names=["t", "c", "n", "at"])

    rows, schema = classes.select("c", "n", "p"), "t long, c long, n int, at int"
    dealt = rows.mapInArrow(packed, "part int, c array<long>, n array<int>, k array<int>, t array<long>, at array<int>").repartitionById(parts, F.col("part"))
    return rows.mapInArrow(frequent, schema).unionByName(dealt.mapInArrow(meet, schema))


def _prefix(x: np.ndarray, often: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    rank = np.zeros(len(x), np.int64)
    if len(often):
        i = np.minimum(np.searchsorted(often, x), len(often) - 1)
        rank = np.where(often[i] == x, counts[i], 0)
    return x[np.lexsort((x, rank))[: prefix_length(len(x), similarity)]] if len(x) else x


def _may(similarity: float, n: Column, at: Column, m: Column, bt: Column) -> Column:
    """Whether sets of n and m shingles can be similar if the shingle at these places is the first they share."""
    return F.least(n - at, m - bt) * (1 + similarity) >= similarity * (n + m) - 1e-9


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar, as a table. classes: c, first, odd; texts: id, own, text. Texts that no pair asks for are left out before the rest are dealt out."""
    with Scratch(pairs.sparkSession, "shingle-verify") as tables:
        return materialize(_checked(pairs, classes, texts, shingle, similarity, tables), "shingle-verified")


def _checked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float, tables: Scratch) -> DataFrame:
    odd = lambda c, k: classes.select(F.col("c").alias(c), F.col("odd").alias(k))
    met = pairs.join(odd("a", "x"), "a").join(odd("b", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def likely(batches):
        for b in pieces(batches):
            most = (b.column("n").to_numpy().astype(float) + b.column("m").to_numpy()) * (1 - similarity) / (1 + similarity) + 1e-6
            least = np.array([least_difference(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())], float)
            yield b.select(["a", "b"]).filter(pa.array(least <= most))

    left = tables.write(met.mapInArrow(likely, "a long, b long"), "likely")
    asked = left.select(F.col("a").alias("c")).unionByName(left.select(F.col("b").alias("c"))).distinct().join(classes, "c").select("c", F.col("first.id").alias("i"), F.col("first.own").alias("o"))
    asked = tables.write(asked, "asked")
    wanted = as_bitmap(asked.select(F.xxhash64("i", "o").alias("name")), _bits_for(asked.count()))

    def present(batches):
        for b in pieces(batches):
            b = b.filter(pa.array(wanted.holds(b.column("name").to_numpy().view(np.uint64))))
            found = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("own"), pa.array(found, pa.list_(pa.int64()))], names=["id", "own", "s"])
            del b

    # sets are made where texts are left out: in a task of its own each would take a second Python worker, as the join between may be a broadcast
    held = texts.withColumn("name", F.xxhash64("id", "own")).mapInArrow(present, f"id {texts.schema['id'].dataType.simpleString()}, own long, s array<long>")
    sets = tables.write(held.join(asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("own") == F.col("o"))).select("c", "s").dropDuplicates(["c"]), "sets")
    met = left.join(sets.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for b in pieces(batches):
            hit = np.array([_similar(x.values.to_numpy(), y.values.to_numpy(), similarity) for x, y in zip(b.column("x"), b.column("y"))], bool)
            yield b.select(["a", "b"]).filter(pa.array(hit))

    return met.mapInArrow(run, "a long, b long")


def set_roots(classes: DataFrame, often: np.ndarray, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of every class that is connected with another over pairs of at least the similarity. classes: c, first, n, p (the prefix), odd."""
    rows = materialize(met_prefixes(classes, often), "shingle-met")
    hubs = rows.groupBy("t").agg(F.min(F.struct("at", "n", "c")).alias("hub"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").drop("low", "high")
    shared = materialize(rows.join(hubs.hint("merge"), "t"), "shingle-shared")
    may = _may(similarity, F.col("n"), F.col("at"), F.col("hub.n"), F.col("hub.at"))
    stars = shared.where((F.col("c") != F.col("hub.c")) & may).select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b"), F.when(F.col("c") < F.col("hub.c"), F.col("n")).otherwise(F.col("hub.n")).alias("n"), F.when(F.col("c") < F.col("hub.c"), F.col("hub.n")).otherwise(F.col("n")).alias("m")).distinct()
    links = _verified(stars, classes, texts, shingle, similarity)
    roots = materialize(components(links), "shingle-roots")
    named = shared.join(roots, F.col("c") == F.col("node"), "left").select("t", "c", "n", "at", F.coalesce("root", "c").alias("root"))
    # a shingle whose classes are all connected has nothing left to compare
    open_ = named.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("t")
    named = materialize(named.join(open_, "t", "left_semi"), "shingle-open")
    other = named.select("t", F.col("c").alias("d"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("root").alias("other"))
    may = _may(similarity, F.col("n"), F.col("at"), F.col("m"), F.col("bt"))
    rest = named.join(other.hint("merge"), (named["t"] == other["t"]) & (F.col("c") < F.col("d")) & (F.col("root") != F.col("other")) & may).select(F.col("c").alias("a"), F.col("d").alias("b"), "n", "m").distinct()
    return components(links.unionByName(_verified(rest, classes, texts, shingle, similarity)))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, among: DataFrame | None = None) -> DataFrame:
    """One document of each group connected by pairs whose sets of `shingle`-word shingles have at least this Jaccard similarity, all columns: the one that simhash.drop_near keeps.

    Texts without a word are one group. among (simhash.near_firsts): only these documents take part, as if the others were not in docs; texts need not be written again to leave them out."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own"))
    often, counts = _frequent(docs, text_col, shingle)

    def step(b: dict) -> dict:
        sets = [shingle_set(t, shingle) for t in b["text"]]
        out = {"id": b["id"], "own": b["own"], "n": [len(s) for s in sets], "c": [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]}
        return out | {"p": [_prefix(s, often, counts, similarity) for s in sets], "odd": [odd_bits(s) for s in sets]}

    first = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "own"))
    with Scratch(docs.sparkSession, "shingles") as tables:
        marks = tables.write(map_batches(rows, step, f"id {kind}, own long, c long, n int, p array<long>, odd binary"), "marks")
        some = marks.select("id", "own", "c")
        if among is not None:
            some = some.join(among.select(F.col("first.id").alias("i"), F.col("first.own").alias("o")), F.col("id").eqNullSafe(F.col("i")) & (F.col("own") == F.col("o")), "left_semi")
        sets = marks.groupBy("c").agg(*[F.first(x).alias(x) for x in ("n", "p", "odd")])
        classes = materialize(some.groupBy("c").agg(first.alias("first")).join(sets, "c"), "shingle-classes")
    roots = set_roots(classes, often, rows, shingle, similarity)
    named = classes.join(roots, F.col("c") == F.col("node"), "left").select(F.coalesce("root", "c").alias("root"), "first")
    return keep_firsts(docs, named, id_col, text_col)
