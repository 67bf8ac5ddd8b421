"""Removal of long byte strings that occur anywhere else, by a logarithmic family of sparse suffix arrays.

Of every 200 bytes one suffix is sampled: the one whose first 64 bytes have the least hash among the 137 that fit into them. Equal strings
sample the same suffix at the same place, so a suffix array of sampled suffixes (about one in 69) meets every repeat. Documents come in batches. A
batch's sampled suffixes are sorted into a suffix array (by their first 8 bytes, then by a hash of the first 64), which is merge-scanned against the
levels that are there: what occurs there, or twice in the batch, is a long match to look into. Levels of equal size merge, so there are as many
levels as the number of batches has binary digits, and every suffix is merged so many times. Levels are bucketed and sorted tables: a scan is a
join without a shuffle.

A matched suffix stands for the consecutive 200-byte strings that sample it, its context. Equal contexts repeat as a whole. Different contexts of one
suffix meet in a task, where equal strings are found by names (hashes by doubling, 8 to 200 bytes) and compared byte by byte. A suffix with very
many different contexts is dealt out string by string instead, by 128 bits of BLAKE2b."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, materialize
from .hashing import eights, encode

LENGTH, PREFIX = 200, 64
BATCHES = 4
#: Bytes worked on at once; a longer text is cut into overlapping pieces. The rule of samples keeps so many bits for a place, whatever the chunk.
_CHUNK_MOST = 1 << 19
_CHUNK = _CHUNK_MOST
#: Sampled suffixes of a bucket.
_PER_BUCKET = 2_000_000
#: A suffix with more rows of contexts than this is dealt out string by string.
_MOST_CONTEXTS = 20_000
#: Contexts that a task remembers having sent.
_REMEMBERED = 300_000


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    out = first * np.uint64(0x9E3779B97F4A7C15)
    out += second
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def doubled(data: np.ndarray, length: int) -> np.ndarray:
    """A name of data[p : p + length] for every p where it fits; length is 64 or more."""
    x = eights(data)
    x = joined(x, x ^ np.uint64(0x94D049BB133111EB))
    size = 8
    while size < length:
        step = min(size, length - size)
        x = joined(x[: len(x) - step], x[step:])
        size += step
    return x[: max(0, len(data) - length + 1)]


class Sampled:
    """The sampled suffixes of some pieces of documents: piece, where in the data, the first and the last window that samples it, and its name."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        self.base = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        with np.errstate(over="ignore"):
            name = doubled(self.data, PREFIX)
            bits = np.uint64(2 * _CHUNK_MOST - 1)
            least = (name & ~bits) | np.arange(len(name), dtype=np.uint64)  # ties go to the left
            width, reach = LENGTH - PREFIX + 1, 1
            while reach < width:
                step = min(reach, width - reach)
                least = np.minimum(least[: len(least) - step], least[step:])
                reach += step
        window = np.flatnonzero(owner[: len(least)] == owner[LENGTH - 1 :])
        at = (least[window] & bits).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))[: len(at)]
        self.first, self.last = window[head], window[np.append(head[1:], len(window))[: len(head)] - 1]
        self.at, self.piece = at[head], owner[window[head]]
        self.name = name[self.at].view(np.int64)

    def heads(self) -> np.ndarray:
        """The first 8 bytes of every sampled suffix, as a number in the order of bytes."""
        eight = self.data[self.at[:, None] + np.arange(8)].view(">u8")[:, 0] if len(self.at) else np.zeros(0, ">u8")
        return (eight.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _pieces(keys: list, texts: list[str | None]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """(keys, offsets, bytes) of texts of 200 bytes or more, in chunks; every window of 200 bytes lies in one piece."""
    own, offsets, held, size = [], [], [], 0
    for key, text in zip(keys, texts):
        data = encode(text)
        for a in range(0, len(data) - LENGTH + 1, _CHUNK):
            piece = data[a : a + _CHUNK + LENGTH - 1]
            if held and size + len(piece) > _CHUNK:
                yield own, offsets, held
                own, offsets, held, size = [], [], [], 0
            own.append(key)
            offsets.append(a)
            held.append(piece)
            size += len(piece)
    if held:
        yield own, offsets, held


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (hashes of the id and of the text) and text: equal rows share their keys, and what is removed from them."""
    return docs.select(F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(F.col(text_col)).alias("k2"), F.col(text_col).alias("text"))


def sampled_suffixes(docs: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(batch, head, name, k1, k2, n): the sampled suffixes of every document with their number, and its batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "batch"))))
            for own, _, pieces in _pieces(keys, b.column("text").to_pylist()):
                s = Sampled(pieces)
                order = np.lexsort((s.name, s.piece))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(s.name[order]) != 0) | (np.diff(s.piece[order]) != 0)]))
                one = order[new]
                k1, k2, batch = (np.array(x)[s.piece[one]] for x in zip(*own))
                n = np.diff(np.append(new, len(order))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"batch": batch.astype(np.int32), "head": s.heads()[one], "name": s.name[one], "k1": k1, "k2": k2, "n": n})

    rows = _keyed(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("k1", "k2"), F.lit(batches)).cast("int"))
    return rows.select("k1", "k2", "batch", "text").mapInArrow(run, "batch int, head long, name long, k1 long, k2 long, n int")


class SuffixIndex:
    """The family of suffix arrays: levels of (head, name, n), sorted in buckets; level i has 2^i batches or is empty."""

    def __init__(self, tables: Scratch, buckets: int) -> None:
        self.tables, self.buckets, self.spark = tables, buckets, tables.spark
        self.levels: list[DataFrame | None] = []
        self.names: list[str] = []

    def _sorted(self, rows: DataFrame) -> DataFrame:
        name = f"suffixes_{uuid.uuid4().hex}"
        self.names.append(name)
        rows.repartition(self.buckets, "head", "name").write.bucketBy(self.buckets, "head", "name").sortBy("head", "name").option("path", f"{self.tables.path}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch of sampled suffixes (head, name, n) in. Returns (head, name) of its suffixes that occur twice in it or on a level."""
        new = self._sorted(batch.groupBy("head", "name").agg(F.sum("n").alias("n")))
        met = new.where("n > 1").select("head", "name")
        for level in self.levels:
            if level is not None:
                met = met.unionByName(new.join(level.select("head", "name").hint("merge"), ["head", "name"]).select("head", "name"))
        met = self.tables.write(met.distinct(), "met")
        at = 0
        while at < len(self.levels) and self.levels[at] is not None:
            old = self.levels[at].withColumnRenamed("n", "m").hint("merge")  # bucket by bucket, as both are sorted
            new = self._sorted(new.join(old, ["head", "name"], "full").select("head", "name", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
            self.levels[at] = None
            at += 1
        if at == len(self.levels):
            self.levels.append(None)
        self.levels[at] = new
        return met

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def matched_suffixes(suffixes: DataFrame, batches: int, tables: Scratch) -> DataFrame:
    """(head, name) of the sampled suffixes that occur more than once, from a table of sampled_suffixes, batch by batch."""
    index = SuffixIndex(tables, max(8, -(-suffixes.count() // _PER_BUCKET)))
    try:
        met = [index.add(suffixes.where(F.col("batch") == b)) for b in range(batches)]
    finally:
        index.close()
    out = met[0]
    for m in met[1:]:
        out = out.unionByName(m)
    return out.distinct()


_CONTEXTS = "name long, c1 long, c2 long, k1 long, k2 long, firsts array<long>, context binary"


def contexts(docs: DataFrame, alive: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The contexts of matched suffixes: (name, c1, c2: hash of the context, k1, k2, firsts: where it stands in the document, context).

    A task sends the bytes of a context once and later null, and once an empty context without a document if it has met it again: rows with bytes or an empty context, counted, tell whether a context occurs twice."""

    target = arrow_schema(_CONTEXTS)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for b in rows:
            names = b.column("names").to_pylist()
            keys = list(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), names))
            for own, offsets, pieces in _pieces(keys, b.column("text").to_pylist()):
                s = Sampled(pieces)
                living = np.unique(np.concatenate([np.array(x[2], np.int64) for x in own]))
                found = np.flatnonzero(living[np.minimum(np.searchsorted(living, s.name), len(living) - 1)] == s.name)
                data, held = s.data.tobytes(), {}
                for k in found.tolist():
                    p, a = s.piece[k], s.first[k]
                    context = data[a : s.last[k] + LENGTH]
                    digest = hashlib.blake2b(context, digest_size=16).digest()
                    held.setdefault((own[p][:2], digest, int(s.name[k])), (context, []))[1].append(int(a - s.base[p]) + offsets[p])
                out: list[list] = [[] for _ in target]
                for (doc, digest, name), (context, firsts) in held.items():
                    before = sent.get(digest, 0)
                    now = 2 if before or len(firsts) > 1 else 1
                    c1, c2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    for to, x in zip(out, (name, c1, c2, *doc, firsts, None if before else context)):
                        to.append(x)
                    if now == 2 and before < 2:
                        for to, x in zip(out, (name, c1, c2, None, None, [], b"")):
                            to.append(x)
                    if len(sent) >= _REMEMBERED:
                        sent.clear()
                    sent[digest] = now
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, target)], schema=target)

    met = _keyed(docs, id_col, text_col).join(alive.hint("shuffle_hash"), ["k1", "k2"])
    return met.select("k1", "k2", "names", "text").mapInArrow(run, _CONTEXTS)


def _verified(data: bytes, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, equal): the runs of windows a, one behind another, whose partners b run alike, by index, and whether their bytes are equal."""
    if not len(a):
        return
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1), [True]]))
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
        begin, end, other = int(a[i]), int(a[j - 1]), int(b[i])
        yield i, j, data[begin : end + LENGTH] == data[other : other + end - begin + LENGTH]


def repeated_offsets(context: list[bytes], count: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each of some different contexts, the runs (from, to) of offsets of its windows that occur in another, or anywhere if its own count is over 1."""
    out = [[(0, len(c) - LENGTH)] if n > 1 else [] for c, n in zip(context, count)]
    data = b"".join(context)
    array = np.frombuffer(data, np.uint8)
    sizes = np.array([len(c) for c in context])
    base, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(context), dtype=np.int32), sizes)
    window = np.flatnonzero(owner[: len(owner) - LENGTH + 1] == owner[LENGTH - 1 :])
    with np.errstate(over="ignore"):
        name = doubled(array, LENGTH)[window]
    order = np.argsort(name, kind="stable")
    new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
    head, cls = np.flatnonzero(new), np.cumsum(new) - 1
    weight = np.bincount(cls, count[owner[window[order]]])
    some = np.flatnonzero((weight[cls] > 1) & (count[owner[window[order]]] == 1))
    first = head[cls[some]]
    partner = np.where(first == some, first + 1, first)
    a, b = window[order[some]], window[order[np.minimum(partner, len(order) - 1)]]
    again = np.argsort(a)
    a, b, cls = a[again], b[again], cls[some][again]
    for i, j, same in _verified(data, a, b):
        pieces = [(i, j)]
        if not same:  # names collide: the windows of these classes are compared one by one
            pieces = []
            for k in range(i, j):
                own = data[a[k] : a[k] + LENGTH]
                members = window[order[head[cls[k]] : head[cls[k] + 1] if cls[k] + 1 < len(head) else len(order)]]
                if any(m != a[k] and data[m : m + LENGTH] == own for m in members.tolist()):
                    pieces.append((k, k + 1))
        for x, y in pieces:  # contexts lie 200 bytes apart, so a run stays in one
            c = owner[a[x]]
            out[c].append((int(a[x] - base[c]), int(a[y - 1] - base[c])))
    return out


_RUNS = "c1 long, c2 long, runs array<struct<low: int, high: int>>"


def _met_in_tasks(rows: DataFrame) -> DataFrame:
    """(c1, c2, runs) of contexts with repeated windows, from rows (name, c1, c2, context), a suffix in one task. Rows stream in the order of suffixes."""

    def found(t: pa.Table) -> pa.RecordBatch:
        name, c1, c2 = (t.column(c).to_numpy() for c in ("name", "c1", "c2"))
        texts = t.column("context").to_pylist()
        new = np.flatnonzero(np.concatenate([[True], (np.diff(name) != 0) | (np.diff(c1) != 0) | (np.diff(c2) != 0)]))
        count = np.diff(np.append(new, len(name)))
        end = np.append(new[1:], len(name))
        whole = [next(x for x in texts[i:j] if x) for i, j in zip(new.tolist(), end.tolist())]
        group = np.flatnonzero(np.concatenate([[True], np.diff(name[new]) != 0]))
        several = np.repeat(np.diff(np.append(group, len(new))) > 1, np.diff(np.append(group, len(new))))
        runs: list = [[(0, len(c) - LENGTH)] if n > 1 else [] for c, n in zip(whole, count)]
        at = np.flatnonzero(several)
        if len(at):
            for k, r in zip(at.tolist(), repeated_offsets([whole[k] for k in at], count[at])):
                runs[k] = r
        keep = [k for k, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays([pa.array(c1[new][keep]), pa.array(c2[new][keep]), pa.array([[{"low": x, "high": y} for x, y in runs[k]] for k in keep], target.field("runs").type)], schema=target)

    target = arrow_schema(_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            name = held.column("name").to_numpy()
            cut = int(np.searchsorted(name, name[-1])) if len(name) else 0  # all suffixes but the last are complete
            if cut:
                yield found(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield found(held)

    return rows.repartition("name").sortWithinPartitions("name", "c1", "c2").mapInArrow(run, _RUNS)


def _met_by_string(rows: DataFrame) -> DataFrame:
    """The same for suffixes with very many contexts: every window is a row by itself, known by 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c1, c2, context in zip(*(b.column(c).to_pylist() for c in ("c1", "c2", "context"))):
                n = len(context) - LENGTH + 1
                w = np.frombuffer(b"".join(hashlib.blake2b(context[k : k + LENGTH], digest_size=16).digest() for k in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1])), pa.array([c1] * n, pa.int64()), pa.array([c2] * n, pa.int64()), pa.array(range(n), pa.int32())], names=["w1", "w2", "c1", "c2", "at"])

    whole = rows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max(F.octet_length("context")).alias("size"))
    all_of = whole.where("n > 1").select("c1", "c2", F.array(F.struct(F.lit(0).alias("low"), (F.col("size") - LENGTH).cast("int").alias("high"))).alias("runs"))
    windows = rows.where(F.octet_length("context") > 0).select("c1", "c2", "context").mapInArrow(run, "w1 long, w2 long, c1 long, c2 long, at int")
    classes = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    some = windows.join(classes, ["w1", "w2"], "left_semi").groupBy("c1", "c2").agg(F.collect_set("at").alias("ats"))
    some = some.join(all_of.select("c1", "c2"), ["c1", "c2"], "left_anti")
    return all_of.unionByName(some.select("c1", "c2", F.transform("ats", lambda x: F.struct(x.alias("low"), x.alias("high"))).alias("runs")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(k1, k2, found): by the hashes of id and text of a document with repeated strings, an array of (firsts, runs): windows from first + low to first + high, for each first and run, occur anywhere else."""
    with Scratch(docs.sparkSession, "suffixes") as tables:
        suffixes = tables.write(sampled_suffixes(docs, id_col, text_col, batches), "sampled", "zstd")
        met = matched_suffixes(suffixes, batches, tables)
        alive = suffixes.join(met, ["head", "name"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("name").alias("names"))
        held = tables.write(contexts(docs, alive, id_col, text_col), "contexts", "zstd")
        rows = held.where("context IS NOT NULL").select("name", "c1", "c2", "context")
        crowded = tables.write(rows.groupBy("name").count().where(F.col("count") > _MOST_CONTEXTS).select("name"), "crowded")
        if crowded.isEmpty():
            runs = _met_in_tasks(rows)
        else:  # at most one in _MOST_CONTEXTS rows
            few = rows.join(crowded, "name", "left_anti")
            runs = _met_in_tasks(few).unionByName(_met_by_string(rows.join(crowded, "name", "left_semi")))
        runs = tables.write(runs, "runs")
        spans = held.where("k1 IS NOT NULL").select("c1", "c2", "k1", "k2", "firsts").join(runs, ["c1", "c2"])
        return materialize(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("firsts", "runs")).alias("found")), "suffix-spans")


def _merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint sorted spans of bytes that the windows cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((a + r["low"], a + r["high"] + LENGTH) for f in found or () for a in f["firsts"] for r in f["runs"]):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, keep: bool = True) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, and with `keep` spans (begin, end) and kept (bytes): every document without the bytes that lie in 200 bytes which also start anywhere else,
    in the same document (overlapping or not) or another. All copies go, the first one too. Strings are judged on the input.

    A null text is an empty one; texts under 200 bytes lose nothing. Equal rows lose all they have from 200 bytes on, as each is the other's copy. One row for each row of docs. `batches` changes cost, not results."""
    spans = repeated_spans(docs, id_col, text_col, batches)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"out {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<begin: long, end: long>>, kept binary" * keep
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in target]
            for key, text, found in zip(*(b.column(c).to_pylist() for c in ("out", "text", "found"))):
                data, last, kept = encode(text), 0, []
                cut = _merged(found)
                for low, high in cut:
                    kept.append(data[last:low])
                    last = high
                rest = b"".join([*kept, data[last:]])
                row = [key, len(data), len(data) - len(rest), len(cut), hashlib.sha256(rest).hexdigest()]
                for to, x in zip(out, [*row, [{"begin": x, "end": y} for x, y in cut], rest] if keep else row):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, target)], schema=target)

    rows = docs.select(F.col(id_col).alias("out"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(F.col(text_col)).alias("k2"))
    return rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("out", "text", "found").mapInArrow(run, schema).withColumnRenamed("out", id_col)
