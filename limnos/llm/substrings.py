"""Substring dedup by recompression.

A document is a sequence of words, named by 64 bits of BLAKE2b. A round of recompression first names runs of one symbol (by symbol and length),
then pairs: every symbol has a bit by its name, and a 0-symbol before a 1-symbol is a pair with a name of its own. Names are hashes of what
they stand for, so they are the same in every task: equal passages get equal symbols in their interior. What a symbol looks at to be itself
(its neighbours, to know where a run or a pair ends) are the words that settle it; a passage that holds these words has the symbol.

Rounds are Spark jobs over all documents. Each finds the symbols of its level that two documents share, among those that a window still
alive settles. A window of 13 words dies if it settles a symbol that only one document has. What is left after the last round is dealt
out by a symbol that the window settles, and windows that meet are compared by two 64-bit folds of their 13 words' digests (128 bits a word)."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, materialize, words_of
from .hashing import WordDigests, chunks, folded, mix

WINDOW = 13
#: Levels of recompression. Symbols of a third one reach over more words than a window settles, as a rule.
LEVELS = 2
#: Levels whose shared symbols are looked up, a Spark round each.
ROUNDS = (1, 2)
_LAST = (1 << 63) - 1
_FAR = 1 << 60
#: Largest bitmap, in bits (a power of two). A full cell costs a comparison, never a result: beyond it more windows are compared.
_MOST_BITS = 31
#: An anchor with more than this share of all stretches, or this many of them, is crowded: it is dealt out over groups of about so many, whose first windows meet in a second step.
_CROWD, _MOST_ROWS = 1 / 256, 500_000
#: Names that a task sums before it passes them on.
_FLUSH = 1_000_000


@dataclass
class Symbols:
    """The symbols of a level over some documents: name, number of words, the words [low, high) that settle it, its document."""

    name: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray

    def settled(self) -> "Symbols":
        """Those that some words of their document settle: not the ones at its ends."""
        keep = (self.low >= 0) & (self.high < _FAR)
        return Symbols(*(x[keep] for x in (self.name, self.size, self.low, self.high, self.doc)))


def compress(s: Symbols) -> Symbols:
    """The next level: runs, then pairs."""
    n = len(s.name)
    # runs; a run is settled by the symbols on both sides, which differ from it
    head = np.flatnonzero(np.concatenate([[True], (s.doc[1:] != s.doc[:-1]) | (s.name[1:] != s.name[:-1])]))
    tail = np.append(head[1:], n) - 1
    length = (tail - head + 1).astype(np.uint64)
    name, doc = np.where(length > 1, mix(s.name[head] + mix(length)), s.name[head]), s.doc[head]
    size = np.add.reduceat(s.size, head)
    edge = np.concatenate([[True], doc[1:] != doc[:-1], [True]])
    low = np.where(edge[:-1], -_FAR, s.low[head - 1])
    high = np.where(edge[1:], _FAR, s.high[np.minimum(tail + 1, n - 1)])
    # pairs; a single symbol is settled by the neighbour that it does not pair with
    bit = (mix(name ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(63)).astype(bool)
    pair = np.zeros(len(name), bool)
    pair[:-1] = ~bit[:-1] & bit[1:] & ~edge[1:-1]
    second = np.concatenate([[False], pair[:-1]])
    at = np.flatnonzero(~second)
    after, before = np.minimum(at + 1, len(name) - 1), np.maximum(at - 1, 0)
    two, one = pair[at], bit[at]
    return Symbols(
        np.where(two, mix(name[at] * np.uint64(3) + mix(name[after])), name[at]),
        size[at] + np.where(two, size[after], 0),
        np.where(one, np.minimum(low[at], low[before]), low[at]),
        np.where(one, high[at], np.maximum(high[at], high[after])),
        doc[at],
    )


class Bitmap:
    """A set of names by their first bits; what is not in it was not put in."""

    def __init__(self, bits: int, data: bytes) -> None:
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    def holds(self, name: np.ndarray) -> np.ndarray:
        cell = name >> np.uint64(64 - self.bits)
        return (self.data[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Parsed:
    """Words, symbols and windows of a few documents, in arrays. A window is known by its first word, counted over all of them."""

    def __init__(self, hasher: WordDigests, texts: list[bytes]) -> None:
        self.data, self.doc, self.begin, self.end = hasher.split(texts)
        self.n, self.texts = len(self.doc), len(texts)
        self.names = hasher.names(self.data, self.begin, self.end)
        self.word = np.ascontiguousarray(self.names[:, 0])
        at = np.arange(self.n)
        self.levels = [Symbols(self.word, np.ones(self.n, np.int64), at, at + 1, self.doc)]
        self.start = np.searchsorted(self.doc, np.arange(len(texts)))

    def level(self, k: int) -> Symbols:
        while len(self.levels) <= k:
            self.levels.append(compress(self.levels[-1]))
        return self.levels[k]

    def windows(self) -> np.ndarray:
        return np.flatnonzero(self.doc[: self.n - WINDOW + 1] == self.doc[WINDOW - 1 :]) if self.n >= WINDOW else np.zeros(0, np.int64)

    def ranges(self, s: Symbols, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The settled symbols [from, to) of s that each window settles. Both ends of what settles a symbol ascend with the symbols."""
        below = np.concatenate([[0], np.cumsum(np.bincount(s.low, minlength=self.n + 1))])
        upto = np.cumsum(np.bincount(s.high, minlength=self.n + 1))
        begin = below[window]
        return begin, np.maximum(upto[window + WINDOW], begin)

    def alive(self, shared: dict[int, Bitmap]) -> np.ndarray:
        """The windows that settle shared symbols only, on the levels given."""
        window = self.windows()
        for k, bitmap in shared.items():
            if not len(window):
                break
            s = self.level(k).settled()
            lone = np.concatenate([[0], np.cumsum(~bitmap.holds(s.name))])
            begin, end = self.ranges(s, window)
            window = window[lone[begin] == lone[end]]
        return window

    def anchors(self, window: np.ndarray) -> np.ndarray:
        """The least symbol that a window settles on the highest level where it settles one: neighbouring windows mostly share it."""
        out, open_ = np.zeros(len(window), np.uint64), np.ones(len(window), bool)
        for k in range(LEVELS, -1, -1):
            s = self.level(k).settled()
            begin, end = self.ranges(s, window)
            now = np.flatnonzero(open_ & (end > begin))
            if len(now):
                least = [s.name]
                for step in (1, 2, 4):
                    x = least[-1].copy()
                    if len(x) > step:
                        x[:-step] = np.minimum(x[:-step], x[step:])
                    least.append(x)
                size = end[now] - begin[now]
                # at most 13 symbols lie in a window: two stretches of a power of two cover them
                fold = np.minimum(np.searchsorted([2, 4, 8], size, side="right"), 3)
                table = np.stack(least)
                out[now] = np.minimum(table[fold, begin[now]], table[fold, end[now] - (1 << fold)])
                open_[now] = False
            if not open_.any():
                break
        return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the largest long), own (32-bit hash of the text) and text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.hash(text_col).alias("own"), F.col(text_col).alias("text"))


def _held(docs: DataFrame, found: dict[int, Bitmap]) -> dict:
    """The bitmaps as broadcast variables, by level."""
    return {k: docs.sparkSession.sparkContext.broadcast((b.bits, b.data.tobytes())) for k, b in found.items()}


class _Sums:
    """Names with the least and the largest id that has them and a count, summed within a task."""

    def __init__(self, kind: int) -> None:
        self.kind, self.parts, self.n = kind, [], 0

    def add(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        self.parts.append(self._merged(name, low, high, count))
        self.n += len(self.parts[-1][0])

    @staticmethod
    def _merged(name: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(name)
        name = name[order]
        new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))[: len(name)]
        if not len(name):
            return name, low, high, count
        return name[new], np.minimum.reduceat(low[order], new), np.maximum.reduceat(high[order], new), np.add.reduceat(count[order], new)

    def full(self) -> bool:
        """Whether there is something to pass on: sums what is held first, which may make room."""
        if self.n > _FLUSH:
            self.parts = [self._merged(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.n = len(self.parts[0][0])
        return self.n > _FLUSH // 2

    def batch(self) -> pa.RecordBatch:
        name, low, high, count = self._merged(*(np.concatenate(x) for x in zip(*self.parts)))
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(name), self.kind, np.int8)), pa.array(name.view(np.int64)), pa.array(low), pa.array(high), pa.array(count)], names=["kind", "name", "low", "high", "n"])


def round_counts(docs: DataFrame, level: int, known: dict[int, Bitmap], id_col: str = "doc_id", text_col: str = "text", anchors: bool = False) -> DataFrame:
    """One round over all documents: (kind, name, low, high, n). Kind 0: the symbols of a level that a window alive on the `known` levels settles, with the smallest and the largest id that has them.
    With `anchors` also kind 1: hashes of the anchors of those windows, with the number of their stretches. Tasks sum their documents first."""
    held = _held(docs, known)

    def run(batches):
        hasher, bitmaps = WordDigests(), {k: Bitmap(*v.value) for k, v in held.items()}
        sums = [_Sums(0), _Sums(1)]
        with np.errstate(over="ignore"):
            for b in batches:
                for keys, texts in chunks(b.column("id").to_pylist(), b.column("text").to_pylist()):
                    p = Parsed(hasher, texts)
                    window = p.alive(bitmaps)
                    if not len(window):
                        continue
                    s = p.level(level).settled()
                    living = np.concatenate([[0], np.cumsum(np.bincount(window, minlength=p.n + 1))])
                    some = living[s.low + 1] > living[np.clip(s.high - WINDOW, 0, s.low + 1)]
                    ids = np.array(keys, np.int64)[s.doc[some]]
                    sums[0].add(s.name[some], ids, ids, np.ones(len(ids), np.int64))
                    if anchors:
                        anchor = p.anchors(window)
                        name, n = np.unique(mix(anchor[_stretches(p, window, anchor)]), return_counts=True)
                        sums[1].add(name, np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), n)
                    for x in sums:
                        if x.full():
                            yield x.batch()
        for x in sums:
            if x.n:
                yield x.batch()

    rows = _keyed(docs, id_col, text_col).select("id", "text").mapInArrow(run, "kind byte, name long, low long, high long, n long")
    return rows.groupBy("kind", "name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def _bits_for(n: int) -> int:
    """Sixteen cells or more to a name, up to the largest bitmap."""
    return min(max(16, (16 * n).bit_length()), _MOST_BITS)


def as_bitmap(names: DataFrame, bits: int) -> Bitmap:
    """The names (64-bit, evenly spread) in a bitmap of 2^bits cells. It reaches the driver in rows of at most 64 KB."""
    width = min(1 << 19, 1 << bits)

    def pack(table: pa.Table) -> pa.Table:
        at = table.column("cell").to_numpy()
        found = np.zeros(width, np.uint8)
        found[at % width] = 1
        return pa.table({"row": pa.array([int(at[0]) // width], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(found, bitorder="little").tobytes(), 1)])})

    out, step = np.zeros(1 << bits >> 3, np.uint8), width >> 3
    cells = names.select(F.shiftrightunsigned("name", 64 - bits).alias("cell")).distinct()
    for r in cells.groupBy(F.expr(f"cell div {width}")).applyInArrow(pack, "row int, bits binary").toLocalIterator():
        out[r["row"] * step : (r["row"] + 1) * step] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return Bitmap(bits, out.tobytes())


def recompress(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, Bitmap], Bitmap | None, int]:
    """The rounds: by level a bitmap of the symbols that two documents share, sized by their number; the crowded anchors, by their hashes, and how many groups the most crowded one needs.

    Anchors are counted in the last round, before its own symbols are known. What shares a cell with a crowded anchor is dealt out too: more groups, the same result."""
    known: dict[int, Bitmap] = {}
    crowded, groups = None, 0
    with Scratch(docs.sparkSession, "substrings") as tables:
        for level in ROUNDS:
            last = level == ROUNDS[-1]
            counts = round_counts(docs, level, known, id_col, text_col, last)
            kept = tables.write(counts.where("kind = 1 OR low < high").select("kind", "name", "n"), f"level-{level}")
            names = kept.where("kind = 0").select("name")
            known[level] = as_bitmap(names, _bits_for(names.count()))
            if last:
                sums = kept.where("kind = 1").agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
                group = max(1, min(_MOST_ROWS, int((sums["all"] or 0) * _CROWD)))
                many = kept.where((F.col("kind") == 1) & (F.col("n") > group))
                n = many.count()
                if n:
                    crowded, groups = as_bitmap(many.select("name"), _bits_for(n)), -(-sums["most"] // group)
    return known, crowded, groups


def _stretches(p: Parsed, window: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Where stretches of consecutive windows with one anchor begin."""
    doc = p.doc[window]
    return np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))


def _candidates(docs: DataFrame, id_col: str, text_col: str, known: dict[int, Bitmap], crowded: Bitmap | None, groups: int) -> DataFrame:
    """(anchor, salt, id, own, start, prints): stretches of living windows with one anchor; prints has the 16 bytes of each window's two hashes. salt is the document's group for crowded anchors, -1 for others."""
    held = _held(docs, known | ({-1: crowded} if crowded else {}))

    def run(batches):
        hasher = WordDigests()
        bitmaps = {k: Bitmap(*v.value) for k, v in held.items()}
        crowd = bitmaps.pop(-1, None)
        with np.errstate(over="ignore"):
            for b in batches:
                for keys, texts in chunks(list(zip(b.column("id").to_pylist(), b.column("own").to_pylist())), b.column("text").to_pylist()):
                    p = Parsed(hasher, texts)
                    window = p.alive(bitmaps)
                    if not len(window):
                        continue
                    anchor, doc = p.anchors(window), p.doc[window]
                    prints = np.stack([folded(p.names[:, k], window, WINDOW) for k in (0, 1)], axis=1)
                    new = _stretches(p, window, anchor)
                    ids, own = np.array([k[0] for k in keys], np.int64)[doc[new]], np.array([k[1] for k in keys], np.int32)[doc[new]]
                    salt = np.full(len(new), -1, np.int32)
                    if crowd is not None:
                        own_group = (mix(ids.view(np.uint64) ^ own.astype(np.uint64)) % np.uint64(groups)).astype(np.int32)
                        salt = np.where(crowd.holds(mix(anchor[new])), own_group, salt)
                    packed = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((np.append(new, len(doc)) * 16).astype(np.int32).tobytes()), pa.py_buffer(prints.tobytes())])
                    start = (window - p.start[doc])[new].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(salt), pa.array(ids), pa.array(own), pa.array(start), packed], names=["anchor", "salt", "id", "own", "start", "prints"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "anchor long, salt int, id long, own int, start int, prints binary")


def _compare(rows: DataFrame) -> DataFrame:
    """(id, own, start, mask, anchor, lo, hi, starts) from rows (anchor, salt, id, own, start, prints): mask has the windows, from start on, whose words start in a smaller id of
    the same group. Of salted anchors the windows first in their group come back by themselves, once for a document, with their starts (mask 0).

    Rows stream in the order of anchor, salt and id: the first id of each window of the group at hand is held, and groups are bounded by the salt."""

    both = np.dtype([("l", np.int64), ("h", np.int64)])

    def pairs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), both)
        out["l"], out["h"] = lo, hi
        return out

    def run(batches):
        last, held, first = None, np.empty(0, both), np.zeros(0, np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            anchor, salt, ids, own, start = (b.column(c).to_numpy() for c in ("anchor", "salt", "id", "own", "start"))
            buffers = b.column("prints").buffers()
            ends = np.frombuffer(buffers[1], np.int32)[b.column("prints").offset :][: n + 1].astype(np.int64)
            lo, hi = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]].view(np.int64).reshape(-1, 2).T
            sizes = np.diff(ends) // 16
            row = np.repeat(np.arange(n), sizes)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            group = np.cumsum(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]))
            order = np.lexsort((hi, lo, group[row]))  # stable: ids ascend within a group
            g, r, l, h = group[row][order], row[order], lo[order], hi[order]
            head = np.concatenate([[True], (g[1:] != g[:-1]) | (l[1:] != l[:-1]) | (h[1:] != h[:-1])])
            heads = np.flatnonzero(head)
            least = ids[r][heads]
            begin = np.flatnonzero(g[heads] == 1) if last == (anchor[0], salt[0]) else heads[:0]
            if len(begin) and len(held):
                key = pairs(l[heads[begin]], h[heads[begin]])
                at = np.minimum(np.searchsorted(held, key), len(held) - 1)
                met = held[at] == key
                least[begin[met]] = np.minimum(least[begin[met]], first[at[met]])
            # what the next batch may meet: the windows of the last group, with those held if it is still the same
            end = np.flatnonzero(g[heads] == group[-1])
            key, low = pairs(l[heads[end]], h[heads[end]]), least[end]
            if last == (anchor[0], salt[0]) and group[-1] == 1:
                key, low = np.concatenate([held, key]), np.concatenate([first, low])
            order_ = np.lexsort((low, key["h"], key["l"]))
            key, low = key[order_], low[order_]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            held, first = key[new], low[new]
            last = (anchor[-1], salt[-1])
            late = ids[r] > least[np.cumsum(head) - 1]
            gone = np.empty(len(order), bool)
            gone[order] = late  # in the order of rows
            # a stretch of one anchor has at most 13 windows, but where words repeat: cut it into masks of 32
            part = np.cumsum(np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] % 32 == 0)])) - 1
            mask = np.bincount(part, gone * 2.0 ** (offset % 32)).astype(np.int64)
            lead = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            keep = np.flatnonzero(mask)
            none = np.zeros(len(keep), np.int64)
            out = [ids[row[lead]][keep], own[row[lead]][keep], (start[row[lead]] + offset[lead])[keep].astype(np.int32), mask[keep], none, none, none]
            starts = [None] * len(keep)
            still = np.flatnonzero(~late & (salt[r] >= 0))
            if len(still):
                i, d, w, at = ids[r][still], own[r][still], (l[still], h[still]), (start[r] + offset[order])[still].astype(np.int32)
                new = np.flatnonzero(np.concatenate([[True], (g[still][1:] != g[still][:-1]) | (w[0][1:] != w[0][:-1]) | (w[1][1:] != w[1][:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])]))
                none = np.zeros(len(new), np.int64)
                more = [i[new], d[new], none.astype(np.int32), none, anchor[r][still][new], w[0][new], w[1][new]]
                out = [np.concatenate(x) for x in zip(out, more)]
                starts += np.split(at, new[1:])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), pa.array(starts, pa.list_(pa.int32()))], names=["id", "own", "start", "mask", "anchor", "lo", "hi", "starts"])

    dealt = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "id")
    return dealt.mapInArrow(run, "id long, own int, start int, mask long, anchor long, lo long, hi long, starts array<int>")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, windows): for each document (id, and a hash of its text) with such windows, an array of (start, mask): bit i of mask says that the 13 words from start + i on also start in a document with a smaller id.

    Null ids count as the largest; repeated ids are one document in comparisons. Null and short texts have no window."""
    known, crowded, groups = recompress(docs, id_col, text_col)
    found = _compare(_candidates(docs, id_col, text_col, known, crowded, groups))
    if crowded:
        found = materialize(found, "substring-found")
        still = found.where("mask = 0")
        least = still.groupBy("anchor", "lo", "hi").agg(F.min("id").alias("least"))
        late = still.join(least, ["anchor", "lo", "hi"]).where(F.col("id") > F.col("least")).select("id", "own", F.explode("starts").alias("start"), F.lit(1).cast("long").alias("mask"))
        found = found.where("mask <> 0").select("id", "own", "start", "mask").unionByName(late)
    return found.groupBy("id", "own").agg(F.collect_list(F.struct("start", "mask")).alias("windows"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and with keep_text kept: every document without the words covered by a window of 13 words that also starts in a document with a smaller id. One row for each row of docs; a null text has no words."""
    gone = repeated_windows(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("out"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k"), F.hash(text_col).alias("h"), F.col(text_col).alias("text"))
    met = rows.join(gone.hint("shuffle_hash"), (F.col("k") == F.col("id")) & (F.col("h") == F.col("own")), "left").select("out", "text", F.col("windows.start").alias("starts"), F.col("windows.mask").alias("masks"))
    names = ["out", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"out {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    target = arrow_schema(schema)

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for key, text, starts, masks in zip(*(b.column(c).to_pylist() for c in ("out", "text", "starts", "masks"))):
                words = words_of(text)
                n = len(words)
                if starts:
                    change = np.zeros(n + WINDOW + 64, np.int64)
                    bits = (np.array(masks, np.int64)[:, None] >> np.arange(32)) & 1
                    at = (np.array(starts)[:, None] + np.arange(32))[bits == 1]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + WINDOW, -1)
                    stay = np.cumsum(change)[:n] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                kept = " ".join(words)
                for k, v in zip(names, (key, n, n - len(words), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({x.name: pa.array(out[x.name], x.type) for x in target}, schema=target)

    return met.mapInArrow(run, schema).withColumnRenamed("out", id_col)
