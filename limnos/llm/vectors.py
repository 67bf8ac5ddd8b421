"""Short codes of vectors by product quantisation, in exact integers.

Components become integers floor(scale * x). A vector is cut into equal parts; a part is coded by the nearest entry of its position's codebook,
which a few rounds of reassignment and averaging fit on all vectors.

Vectors lie in chunks, a row each of a table that is written once. In a chunk every part position has an order of its own, along a Hilbert
curve, and is cut into flat blocks with the least and the largest of each component (a box), sums and a count. In a round, box distances tell which
entries can be nearest to anything in a block: an entry is out if its least distance to the box exceeds another's largest. A block with one entry
left gives its sums as they are; for others only the entries on its list are compared. Tasks send sums by entry, so a round moves a few rows a task.
The last assignment finds all parts of a vector in the same chunk: nothing is shuffled but for sums by label."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk, and of a block within it.
CHUNK, BLOCK = 4096, 64
#: Bits of a component on the curve; more dimensions take fewer, so that a key has 64 bits.
_CURVE_BITS = 6
_CHUNKS = "ids {id}, labels {label}, n int, width int, bytes int, places binary, points binary, low binary, high binary, sums binary"


@dataclass
class Codebooks:
    """entries: (parts, entries, components of a part), integers; scale: what components were multiplied by."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places along a Hilbert curve of points (dimensions, n), each dimension cut evenly between its least and largest value.

    From the highest bit down, the orthant's Gray code is read off and the axes below it are exchanged or turned over, so that the curve enters the next cell where it left the last."""
    dims, n = points.shape
    if not dims or not n:
        return np.zeros(n, np.uint64)
    bits = max(1, min(_CURVE_BITS, 64 // dims))
    low = points.min(axis=1, keepdims=True).astype(float)
    span = np.maximum(points.max(axis=1, keepdims=True) - low, 1)
    cell = np.minimum((points - low) / span * (1 << bits), (1 << bits) - 1).astype(np.uint32)
    for bit in range(bits - 1, 0, -1):
        below = np.uint32((1 << bit) - 1)
        for d in range(dims):
            on = (cell[d] >> np.uint32(bit)) & 1 == 1
            swap = np.where(on, 0, (cell[0] ^ cell[d]) & below).astype(np.uint32)
            cell[0] ^= np.where(on, below, swap).astype(np.uint32)
            cell[d] ^= swap
    for d in range(1, dims):
        cell[d] ^= cell[d - 1]
    turn = np.zeros(n, np.uint32)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((cell[-1] >> np.uint32(bit)) & 1 == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    cell ^= turn
    key = np.zeros(n, np.uint64)
    used = min(dims, 64)
    for bit in range(bits - 1, -1, -1):
        for d in range(used):
            key = (key << np.uint64(1)) | ((cell[d] >> np.uint32(bit)) & 1).astype(np.uint64)
    return key


class Blocks:
    """One part position of a chunk: points (components, n) in the order of the curve, the place in the chunk of each, and boxes and sums (components, blocks)."""

    def __init__(self, points: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        self.points, self.place, self.low, self.high, self.sums = points, place, low, high, sums
        n = points.shape[1]
        self.count = np.minimum(BLOCK, n - np.arange(0, n, BLOCK))

    @classmethod
    def of(cls, points: np.ndarray) -> "Blocks":
        place = np.argsort(hilbert_keys(points), kind="stable")
        points = np.ascontiguousarray(points[:, place])
        at = np.arange(0, points.shape[1], BLOCK)
        return cls(points, place, *(f.reduceat(points, at, axis=1) for f in (np.minimum, np.maximum, np.add)))

    def _most(self, entries: np.ndarray) -> int:
        """A bound on squared distances."""
        span = max(int(self.high.max(initial=0)), int(entries.max(initial=0))) - min(int(self.low.min(initial=0)), int(entries.min(initial=0)))
        most = len(self.points) * span * span
        if most >= (1 << 63) - 1:
            raise ValueError(f"components differ by {span}: squared distances do not fit 64 bits")
        return most

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """(entries, blocks): which entries may be the nearest of some point in the block."""
        self._most(entries)
        e, low, high = entries[:, :, None], self.low[None], self.high[None]
        gap = np.maximum(np.maximum(low - e, e - high), 0)
        reach = np.maximum(e - low, high - e)
        return (gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min(axis=0)

    def _kernel(self, entries: np.ndarray, listed: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest listed entry, squared distance) of the points in rows; ties go to the lower index."""
        kind = np.int32 if self._most(entries) < (1 << 31) - 1 else np.int64
        block, points = rows // BLOCK, self.points[:, rows].astype(kind)
        best, code = np.full(len(rows), np.iinfo(kind).max, kind), np.zeros(len(rows), np.int64)
        for k, entry in enumerate(entries.astype(kind)):
            some = np.flatnonzero(listed[k][block])
            if not len(some):
                continue
            d = np.zeros(len(some), kind)
            for x, e in zip(points, entry):
                step = x[some] - e
                d += step * step
            less = d < best[some]
            best[some[less]], code[some[less]] = d[less], k
        return code, best.astype(np.int64)

    def sums_by_entry(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sums of components) of the points nearest to each entry."""
        k, listed = len(entries), self.shortlists(entries)
        alone = listed.sum(axis=0) == 1
        one = listed.argmax(axis=0)[alone]
        count = np.bincount(one, self.count[alone], k).astype(np.int64)
        total = np.stack([np.bincount(one, s[alone], k) for s in self.sums]).astype(np.int64) if len(one) else np.zeros((len(self.sums), k), np.int64)
        rows = np.flatnonzero(np.repeat(~alone, self.count))
        if len(rows):
            code, _ = self._kernel(entries, listed, rows)
            count += np.bincount(code, minlength=k)
            total += np.stack([np.bincount(code, x[rows], k) for x in self.points]).astype(np.int64)
        return count, total.T

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, squared distance) of every vector, in the order of the chunk."""
        found = self._kernel(entries, self.shortlists(entries), np.arange(self.points.shape[1]))
        out = tuple(np.empty_like(x) for x in found)
        for to, x in zip(out, found):
            to[self.place] = x
        return out


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """(vectors, width) floors of scaled components; shorter vectors are filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise ValueError("scaled components do not fit 64 bits")
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.astype(np.int64)
    return out


def _chunk_row(target: pa.Schema, ids: pa.Array, labels: pa.Array, points: np.ndarray, parts: int) -> pa.RecordBatch:
    n, width = points.shape
    blocks = [Blocks.of(np.ascontiguousarray(p.T)) for p in np.split(points, parts, axis=1)]
    most = int(np.abs(points).max()) if points.size else 0
    kind = next(np.dtype(t) for t in ("i2", "i4", "i8") if most <= np.iinfo(t).max)
    whole = lambda a: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a)
    pack = lambda name, kind: pa.array([b"".join(getattr(b, name).astype(kind).tobytes() for b in blocks)])
    return pa.RecordBatch.from_arrays(
        [whole(ids), whole(labels), *(pa.array([x], pa.int32()) for x in (n, width, kind.itemsize)), pack("place", "i4"), pack("points", kind), pack("low", "i8"), pack("high", "i8"), pack("sums", "i8")], schema=target
    )


def _unpacked(row: dict, parts: int) -> list[Blocks]:
    n, w = row["n"], row["width"] // parts
    m = -(-n // BLOCK)
    read = lambda name, kind, *shape: np.frombuffer(row[name], kind).reshape(parts, *shape)
    place, points = read("places", "i4", n), read("points", f"i{row['bytes']}", w, n)
    low, high, sums = (read(x, "i8", w, m) for x in ("low", "high", "sums"))
    return [Blocks(points[p], place[p], low[p], high[p], sums[p]) for p in range(parts)]


def chunked(kept: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """A row for every chunk of the kept rows (id, vector, label), in no order: ids and labels as arrays, and the blocks of every part position."""
    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = _CHUNKS.format(id=f"array<{kind['id']}>", label=f"array<{kind['label']}>")
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            ids, labels, vectors = (t.column(c).combine_chunks() for c in ("id", "label", "vector"))
            return _chunk_row(target, ids, labels, _integers(vectors, width, scale), parts)

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= CHUNK:
                yield out(held.slice(0, CHUNK))
                held = held.slice(CHUNK)
        if held is not None and held.num_rows:
            yield out(held)

    return kept.select("id", "label", "vector").mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.RecordBatch, int, dict]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b, k, {c: b.column(c)[k].as_buffer() if pa.types.is_binary(b.column(c).type) else b.column(c)[k].as_py() for c in columns}


_PACKED = ["n", "width", "bytes", "places", "points", "low", "high", "sums"]


def fit_round(chunks: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The next codebooks: every entry is the floor of the mean of the parts nearest to it; unused ones stay. Tasks sum over their chunks; at most parts x entries rows come back."""
    parts, k, w = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
        for _, _, row in _rows(batches, _PACKED):
            for p, blocks in enumerate(_unpacked(row, parts)):
                n, s = blocks.sums_by_entry(entries[p])
                count[p] += n
                total[p] += s
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "n": count[p, e], "sums": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    sums = chunks.select(*_PACKED).mapInArrow(run, "part int, entry int, n long, sums array<long>")
    out = entries.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(w)]).collect():
        out[r["part"], r["entry"]] = [r[f"s{d}"] // r["n"] for d in range(w)]
    return out


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")).where(_finite(F.col("vector")))


def _fitted(kept: DataFrame, tables: Scratch, parts: int, entries: int, rounds: int, scale: int) -> tuple[Codebooks | None, DataFrame | None]:
    longest = kept.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    if longest is None:
        return None, None
    width = max(1, -(-longest // parts)) * parts
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = _integers(first.column("vector").combine_chunks(), width, scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    chunks = tables.write(chunked(kept, width, parts, scale), "chunks")
    for _ in range(rounds):
        books = fit_round(chunks, books)
    return Codebooks(books, scale), chunks


def encode_chunks(chunks: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of every vector of the chunks."""
    parts = len(books.entries)
    kind = {f.name: f.dataType.elementType.simpleString() for f in chunks.schema if f.name in ("ids", "labels")}
    schema = f"id {kind['ids']}, label {kind['labels']}, code string, error long"
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at, row in _rows(batches, _PACKED):
            found = [blocks.nearest(e) for blocks, e in zip(_unpacked(row, parts), books.entries)]
            digits = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex().encode()
            code = pa.Array.from_buffers(pa.string(), row["n"], [None, pa.py_buffer(np.arange(0, len(digits) + 1, 2 * parts, dtype=np.int32)), pa.py_buffer(digits)])
            ids, labels = (b.column(c)[at].values for c in ("ids", "labels"))
            yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(np.sum([d for _, d in found], axis=0))], schema=target)

    return chunks.mapInArrow(run, schema)


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """((id_col, label_col, code, error), the codebooks): a row for every vector without null or non-finite components; other rows are dropped. Two hex digits a part, so 256 entries at most.

    Codebooks start as the parts of the first vectors by id (nulls last, then by vector), fewer than `entries` if there are fewer; repeated ids and rows count as often as they
    stand. Vectors that are shorter than the longest, or than a multiple of `parts`, are filled up with zeros. No vector left: no row and no codebooks. Components whose squares do not fit 64 bits are an error."""
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256")
    kept = _kept(vectors, id_col, vector_col, label_col)
    with Scratch(vectors.sparkSession, "vectors") as tables:
        books, chunks = _fitted(kept, tables, parts, entries, rounds, scale)
        if books is None:
            coded = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
        else:
            coded = materialize(encode_chunks(chunks, books), "vector-codes")
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def decode_vectors(coded: DataFrame, books: Codebooks, code_col: str = "code", to: str = "decoded") -> DataFrame:
    """coded with one more column: the vector that a code stands for, entries divided by the scale. Null codes: null."""
    parts = len(books.entries)
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / books.scale) for x in e]) for e in book]) for book in books.entries])
    entry = lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn(to, F.when(F.col(code_col).isNotNull(), F.flatten(F.array(*[F.get(F.get(table, F.lit(p)), entry(p)) for p in range(parts)]))))


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over rows with the same label, nulls together) and codebooks_sha256 for every kept vector."""
    coded, books = compress_vectors(vectors)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "label_")
    # a frequent label is split by the adaptive join; few labels are broadcast by their measured size
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("label_")), "left")
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))
