"""SimHash near-dedup with a generalised pigeonhole search.

The 64 bits are grouped into parts, correlated bits together. If the parts' thresholds t_i sum to (threshold - parts + 1), two fingerprints
within the threshold differ by at most t_i in some part i. Each fingerprint gets its own thresholds, by dynamic programming on candidate
counts estimated from all fingerprints; it probes each part with all values within t_i, and what meets is verified."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, map_batches, materialize, words_of

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Bits of a part that its frequency table is kept for: a table has 2^16 cells whatever the corpus.
_SEEN_BITS = 16
#: Pairs that a task gathers before it joins them to its stars, and fingerprints in stars that it keeps before it hands them on (some 100 MB together).
_MOST_PAIRS, _MOST_HELD = 500_000, 1_000_000


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, each set if over half of the shingles' XXH64 values have it. Lower case is for A to Z only; fewer words than a shingle are one; no word: 0."""
    words = words_of(text.translate(_LOWER)) if text else []
    if not words:
        return 0
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([len(w) + 1 for w in raw])
    data = b" ".join(raw)
    k = min(shingle, len(raw))
    starts = [0, *ends[: len(raw) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        votes += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id, fp (the fingerprint as a signed long) of every whole text. Null, empty and blank texts: 0. Null and repeated ids stay; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def step(b: dict) -> dict:
        return {"id": b["id"], "fp": np.array([simhash(t, shingle) for t in b["text"]], np.uint64).view(np.int64)}

    return map_batches(rows, step, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(gram: np.ndarray, n: float, parts: int) -> list[list[int]]:
    """Splits 64 bits into `parts` groups of near-equal size: each grows by the bit most correlated with those it has."""
    mean = np.diag(gram) / n
    cov = gram / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    like = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(like, 0)
    free, out = set(range(64)), []
    for i in range(parts):
        size = (64 + i) // parts
        seed = max(free, key=lambda b: (like[b, list(free)].sum(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(free, key=lambda b: (like[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def take_bits(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of some bits, packed."""
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def masks_within(width: int, t: int) -> np.ndarray:
    """All patterns of at most t of `width` bits."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.uint64)


class Plan:
    """Parts of the bits, what they hold, and the allocation of thresholds."""

    def __init__(self, groups: list[list[int]], threshold: int, seen: list[np.ndarray]) -> None:
        self.groups, self.threshold = groups, threshold
        self.total = threshold - len(groups) + 1
        self.masks = [[masks_within(len(g), t) for t in range(self.total + 1)] for g in groups]
        # expected candidates of one part and value for t = 0, 1, ...: counts of values within t on the seen bits, spread over the unseen
        self.near = []
        for g, table in zip(groups, seen):
            k, rest = min(len(g), _SEEN_BITS), max(0, len(g) - _SEEN_BITS)
            rings = [table.astype(float)]
            for t in range(1, self.total + 1):
                ring = sum(rings[-1][np.arange(1 << k) ^ (1 << b)] for b in range(k))
                rings.append((ring - (k - t + 2) * (rings[-2] if t > 1 else 0)) / t if t > 1 else ring)
            balls = []
            for t in range(self.total + 1):
                ways = [float(np.prod([(rest - i) / (i + 1) for i in range(u)])) if u <= rest else 0.0 for u in range(t + 1)]
                balls.append(sum(np.maximum(rings[t - u], 0) * ways[u] for u in range(t + 1)) / 2.0**rest)
            self.near.append(np.cumsum(balls, axis=0))

    def cost(self, i: int, t: int, fp: np.ndarray, probe: float = 20.0) -> np.ndarray:
        """In candidates: a probe is a row that is shuffled and sorted, a candidate a comparison within the join."""
        if t < 0:
            return np.zeros(len(fp))
        low = take_bits(fp, self.groups[i][:_SEEN_BITS]).astype(np.int64)
        return self.near[i][t][low] + probe * len(self.masks[i][t])

    def allocate(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds (documents, parts), -1 for a part that is not probed, with the right sum and the least cost; and that cost."""
        m, choices = len(self.groups), range(-1, self.total + 1)
        low, high = -m, self.total + m
        best = np.full((high - low + 1, len(fp)), np.inf)
        best[-low] = 0
        picks = []
        for i in range(m):
            costs = [self.cost(i, t, fp) for t in choices]
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for s in range(low, high + 1):
                for t, c in zip(choices, costs):
                    if low <= s - t <= high:
                        got = best[s - t - low] + c
                        better = got < new[s - low]
                        new[s - low][better] = got[better]
                        pick[s - low][better] = t
            best = new
            picks.append(pick)
        out, s = np.zeros((len(fp), m), np.int8), np.full(len(fp), self.total)
        for i in range(m - 1, -1, -1):
            out[:, i] = picks[i][s - low, np.arange(len(fp))]
            s = s - out[:, i]
        return out, best[self.total - low]


def fit_plan(prints: DataFrame, threshold: int = 4) -> Plan:
    """Groups and tables from all distinct fingerprints (column fp); the number of parts is the one with the least expected probes and candidates.

    What reaches the driver: 64 x 64 sums, and 2^16 counts for each part."""

    def grams(batches):
        total = np.zeros((64, 64))
        n = 0
        for b in batches:
            x = bits_of(b.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "gram"])

    sums = prints.mapInArrow(grams, "n long, gram array<double>").select("n", F.posexplode("gram").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    gram, n = np.zeros(64 * 64), 1.0
    for r in sums.collect():
        gram[r["at"]], n = r["v"], max(1.0, r["n"])
    gram = gram.reshape(64, 64)
    options = {m: group_bits(gram, n, m) for m in range(2, threshold + 1)}

    def tables(batches):
        at = {m: [np.zeros(1 << _SEEN_BITS, np.int64) for _ in g] for m, g in options.items()}
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for m, groups in options.items():
                for t, g in zip(at[m], groups):
                    t += np.bincount(take_bits(fp, g[:_SEEN_BITS]).astype(np.int64), minlength=1 << _SEEN_BITS)
        for m, ts in at.items():
            for i, t in enumerate(ts):
                hit = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array([m * 64 + i] * len(hit), pa.int32()), pa.array(hit, pa.int32()), pa.array(t[hit])], names=["part", "v", "n"])

    seen = {m: [np.zeros(1 << _SEEN_BITS, np.int64) for _ in g] for m, g in options.items()}
    for r in prints.mapInArrow(tables, "part int, v int, n long").groupBy("part", "v").agg(F.sum("n").alias("n")).toLocalIterator():
        seen[r["part"] // 64][r["part"] % 64][r["v"]] = r["n"]
    plans = {m: Plan(g, threshold, seen[m]) for m, g in options.items()}

    def costs(batches):
        total = {m: 0.0 for m in plans}
        for b in batches:
            for m, p in plans.items():
                total[m] += float(p.allocate(b.column("fp").to_numpy().view(np.uint64))[1].sum())
        yield pa.RecordBatch.from_pydict({"m": pa.array(list(total), pa.int32()), "cost": pa.array(list(total.values()))})

    found = {r["m"]: r["c"] for r in prints.mapInArrow(costs, "m int, cost double").groupBy("m").agg(F.sum("cost").alias("c")).collect()}
    return plans[min(plans, key=lambda m: (found.get(m, 0.0), m))]


def _met(prints: DataFrame, threshold: int, plan: Plan | None) -> DataFrame:
    """(a, b), a > b: every two distinct fingerprints that differ by at most `threshold` bits, once for each part in which they meet. Every fingerprint's probes find all
    that are near to it, so those of the larger one of two do. A hot (part, key) is a skewed join to Spark, which splits it."""
    plan = plan or fit_plan(prints, threshold)

    def stored(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for i, g in enumerate(plan.groups):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(take_bits(fp, g).view(np.int64)), b.column("fp")], names=["part", "key", "b"])

    def probes(batches):
        for b in batches:
            every = b.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(every), 20_000):
                fp = every[at : at + 20_000]
                t = plan.allocate(fp)[0]
                for i, g in enumerate(plan.groups):
                    for k in range(plan.total + 1):
                        own = fp[t[:, i] == k]
                        masks = plan.masks[i][k]
                        for s in range(0, len(own), max(1, 400_000 // len(masks))):
                            part = own[s : s + max(1, 400_000 // len(masks))]
                            keys = (take_bits(part, g)[:, None] ^ masks[None, :]).ravel()
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["part", "key", "a"])

    left = prints.select("fp").mapInArrow(probes, "part int, key long, a long")
    right = prints.select("fp").mapInArrow(stored, "part int, key long, b long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    met = left.join(right.hint("merge"), (left["part"] == right["part"]) & (left["key"] == right["key"]) & (left["a"] > right["b"]) & near)
    return met.select("a", "b")


def links(prints: DataFrame, threshold: int = 4, plan: Plan | None = None) -> DataFrame:
    """(a, b), a < b: every two distinct fingerprints (column fp) that differ by at most `threshold` bits, each pair once."""
    return _met(prints, threshold, plan).select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the edges (a, b) that are not the smallest of their component: its root. Least labels pass over edges and along themselves until nothing changes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (root[x], root[y], x, y):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def spanning_links(prints: DataFrame, threshold: int = 4, plan: Plan | None = None) -> DataFrame:
    """(a, b): links that connect the same fingerprints as `links` does, but a task gives at most one row for every fingerprint that it met (and once more for every _MOST_HELD of them),
    so that a dense cluster of k fingerprints leaves no k^2 pairs. No rows for fingerprints that are alone."""

    def span(batches):
        held, a, b, n = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], [], 0
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            n += batch.num_rows
            if n >= max(_MOST_PAIRS, len(held[0])):
                held, a, b, n = stars_of(np.concatenate([held[0], *a]), np.concatenate([held[1], *b])), [], [], 0
                if len(held[0]) > _MOST_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["a", "b"])
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = stars_of(np.concatenate([held[0], *a]), np.concatenate([held[1], *b]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["a", "b"])

    return _met(prints, threshold, plan).mapInArrow(span, "a long, b long")




def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node (by the order of longs) that can be reached, for every node of an edge (a, b).

    Alternates large-star and small-star steps over written tables until nothing changes, in a number of rounds that grows with the logarithm of the longest path;
    a round's hubs are summed by partial aggregation, never gathered. The result is a table; those of the rounds are deleted."""
    with Scratch(edges.sparkSession, "edges") as tables:
        e = tables.write(edges.select("a", "b").where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "given")
        was = None
        while True:
            # large star: neighbours above a node link to its smallest neighbour
            both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
            e = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
            # small star: a node and those below it link to the smallest of them
            least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
            j = e.join(least, F.col("a") == F.col("k"))
            e = tables.write(j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "round")
            now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
            if now == was:
                break
            was = now
        roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        return materialize(roots, "components")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def class_roots(marks: DataFrame, threshold: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint of marks; equal fingerprints are one class before the search, so copies never meet as pairs."""
    classes = materialize(marks.select("fp").distinct(), "simhash-classes")
    roots = components(spanning_links(classes, threshold))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """id, fp, component_id: the smallest id reachable over links between fingerprints, its own included; one row for each document.

    Documents with null ids take part; a component of null ids only has a null component_id. Blank texts (fingerprint 0) link like any other. Repeated rows stay."""
    marks = materialize(fingerprint_texts(docs, id_col, text_col, shingle), "simhash")
    classes = marks.groupBy("fp").agg(F.min(id_col).alias("least"))
    named = materialize(class_roots(marks, threshold).join(classes, "fp"), "simhash-roots")
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(whole, "root").select(F.col("fp").alias("k"), "component_id")
    return marks.join(named, F.col("fp") == F.col("k")).select(id_col, "fp", "component_id")


def near_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document, in the cases of `near_classes`."""
    return near_classes(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_firsts(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are the least `first` (late, id, own) of their `root` in named; of equal rows, one. Texts are shuffled once: both steps are by the hashes of the text and of the id with it."""
    own, key, kept_own, kept_key = free_names(docs, "own", "key", "kept_own", "kept_key")
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.own").alias(kept_own), F.xxhash64("first.id", "first.own").alias(kept_key))
    rows = docs.withColumn(own, F.xxhash64(text_col)).withColumn(key, F.xxhash64(id_col, own))
    return rows.join(kept, (F.col(own) == F.col(kept_own)) & (F.col(key) == F.col(kept_key)), "left_semi").dropDuplicates([own, key]).drop(own, key)


def near_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """(root, first): for each group of near-duplicates the document that stays, as (late, id, own): that with the smallest id (nulls last), then the least hash of its text. A table."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("own"))

    def step(b: dict) -> dict:
        return {"id": b["id"], "own": b["own"], "fp": np.array([simhash(t, shingle) for t in b["text"]], np.uint64).view(np.int64)}

    marks = materialize(map_batches(rows, step, f"id {kind}, own long, fp long"), "simhash")
    firsts = marks.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "own")).alias("first"))
    return materialize(class_roots(marks, threshold).join(firsts, "fp").groupBy("root").agg(F.min("first").alias("first")), "simhash-firsts")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """One document of each group of near-duplicates, all columns: that of `near_firsts`; of equal rows, one. Documents that are alone stay."""
    return keep_firsts(docs, near_firsts(docs, id_col, text_col, shingle, threshold), id_col, text_col)
