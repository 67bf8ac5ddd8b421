"""Document fingerprints by I-Match: keep terms within an inverse-document-frequency band, sort distinct terms, hash several randomised lexicon subsets.

Terms are lower-cased words, known by a 64-bit hash; Spark counts the documents of every term. The band is a lower and an upper share of all
documents, so it cannot hold more terms than the mean number of distinct terms in a document divided by the lower share: that bounds the
lexicon, whatever the corpus. A seeded hash of a term is its place in the lexicon; subsets are intervals of places: all, the quarters, the
sixteenths, and 32 intervals each of a share of 1/64, 1/256 and 1/1024. A text's distinct terms are sorted by place and each subset's are hashed in that order."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches, materialize
from .hashing import CHUNK, PER_ROW, Powers, WordHasher, chunks, encode, mix

#: Subsets by share of the lexicon (a power of 1/4): how many intervals of that share are used.
SUBSETS = (1, 4, 16, 32, 32, 32)
_STARTS = np.concatenate([[0], np.cumsum(SUBSETS)])
#: A share is compared if so many of its subsets hold a term of either text.
_ENOUGH = 8
_BREAK = re.compile(r"[\x20\x09-\x0D]")


def _distinct(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each owner, sorted; owners ascend."""
    order = np.argsort(term)
    small = owner.astype(np.uint16) if len(owner) and owner.max() < 1 << 16 else owner  # a stable sort of short integers is linear
    order = order[np.argsort(small[order], kind="stable")]
    owner, term = owner[order], term[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])])[: len(term)]
    return owner[new], term[new]


def _summed(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    term, at = np.unique(np.concatenate(terms), return_inverse=True)
    return term, np.bincount(at, np.concatenate(counts), len(term)).astype(np.int64)


def document_frequency(docs: DataFrame, text_col: str = "text", flush: int = 1_000_000) -> DataFrame:
    """term (64-bit hash of a lower-cased word, as a signed long), df: number of documents that hold it, over all documents.

    Tasks sum their documents before the shuffle, at most `flush` terms at a time. Null and empty texts hold no term."""

    def run(batches):
        hasher, terms, counts, held = WordHasher(), [], [], 0

        def out(t: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["term", "df"])

        for b in batches:
            texts = [t and t.lower() for t in b.column("text").to_pylist()]
            for _, own in chunks(texts, texts):
                term, n = np.unique(_distinct(*hasher.words(own))[1], return_counts=True)
                terms.append(term)
                counts.append(n)
                held += len(term)
                if held > flush:
                    term, n = _summed(terms, counts)
                    terms, counts, held = [term], [n], len(term)
                    if held > flush // 2:
                        yield out(term, n)
                        terms, counts, held = [], [], 0
        if held:
            yield out(*_summed(terms, counts))

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Marker:
    """Fingerprints of texts, many at a time, as rows of 32-bit numbers: one for each subset, 0 where it holds no term of the text."""

    def __init__(self, lexicon: "Lexicon") -> None:
        self.terms, self.hasher, self.powers = lexicon.terms, WordHasher(), Powers(0xD1342543DE82EF95)
        self.seed = mix(np.array([lexicon.seed + 1], np.uint64))

    def places(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of its piece, place in the lexicon) of every word in the band."""
        piece, word = self.hasher.words(pieces)
        if not len(self.terms):
            return piece[:0], word[:0]
        at = np.minimum(np.searchsorted(self.terms, word), len(self.terms) - 1)
        hit = self.terms[at] == word
        return piece[hit], mix(word[hit] ^ self.seed)

    def marks(self, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """n rows of marks from the places of all words; a row is an owner's."""
        out = np.zeros((n, _STARTS[-1]), np.uint32)
        owner, place = _distinct(owner, place)
        if not len(place):
            return out
        for k, used in enumerate(SUBSETS):
            cell = (place >> np.uint64(64 - 2 * k)).astype(np.int64) if k else np.zeros(len(place), np.int64)
            begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])]))
            end = np.append(begin[1:], len(place))
            low = cell[begin] < used
            begin, end = begin[low], end[low]
            mark = (self.powers.ranges(place, begin, end) >> np.uint64(32)).astype(np.uint32)
            out[owner[begin], _STARTS[k] + cell[begin]] = np.maximum(mark, 1)
        return out

    def of(self, texts: list[str | None]) -> np.ndarray:
        return np.concatenate([self.marks(*self.places(held), len(own)) for own, held in chunks(texts, [t and t.lower() for t in texts])] or [np.zeros((0, _STARTS[-1]), np.uint32)])


def as_text(marks: np.ndarray) -> list[str]:
    """Rows of marks as strings: eight hex digits for each subset."""
    whole, width = marks.astype(">u4").tobytes().hex(), 8 * marks.shape[1]
    return [whole[i * width : (i + 1) * width] for i in range(len(marks))]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: of the smallest share with at least eight subsets that hold a term of either text (else the share with most of them, the smaller of two), the part whose marks are equal. 1 for equal fingerprints."""
    met, some = (a == b) & (a != 0), (a != 0) | (b != 0)
    same, all_ = (np.add.reduceat(x, _STARTS[:-1], axis=1, dtype=np.int64)[:, ::-1] for x in (met, some))
    pick = np.argmax(np.minimum(all_, _ENOUGH), axis=1)
    row = np.arange(len(a))
    return np.where((a == b).all(1), 1.0, same[row, pick] / np.maximum(all_[row, pick], 1))


def likeness(a: str, b: str) -> float:
    """`alike` of two fingerprints in their string form."""
    return float(alike(*(np.frombuffer(bytes.fromhex(x), ">u4")[None, :].astype(np.uint32) for x in (a, b)))[0])


@dataclass
class Lexicon:
    """The terms of the band: sorted 64-bit hashes. `seed` deals them out over the subsets."""

    terms: np.ndarray
    seed: int


def fit_lexicon(docs: DataFrame, text_col: str = "text", low: float = 1e-4, high: float = 0.2, seed: int = 3) -> Lexicon:
    """The terms that at least the share `low` of all documents (and two) and at most the share `high` (or two) hold: idf from -ln(high) to -ln(low). Counts cover all documents.

    At most (mean number of distinct terms in a document) / low terms are in the band; these, 8 bytes each, reach the driver and the tasks."""
    df = materialize(document_frequency(docs, text_col), "imatch-df")
    n = docs.count()
    band = df.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term")
    return Lexicon(np.sort(band.toArrow().column("term").to_numpy().view(np.uint64)), seed)


def fingerprint_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every whole text. Null and empty texts, and those without a term in the band, have the fingerprint of zeros. Null and repeated ids stay; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, lambda b, m: {"id": b["id"], "fingerprint": as_text(m.of(b["text"]))}, f"id {kind}, fingerprint string", lambda: Marker(lexicon)).withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _word_start(text: str, end: int) -> int:
    """Where the word that reaches up to `end` begins (`end` itself if a break stands before it)."""
    step = 64
    while True:
        low = max(0, end - step)
        found = [m.end() for m in _BREAK.finditer(text, low, end)]
        if found:
            return found[-1]
        if not low:
            return 0
        step *= 4


def _range_of(id_: Column, cuts: list[int]) -> Column:
    """The number of cuts (ascending) that are not above the id; nulls lie behind all. Two steps of about sqrt(cuts) comparisons each."""
    if not cuts:
        return F.lit(0)
    w = max(1, int(len(cuts) ** 0.5))
    groups = F.from_json(F.lit(json.dumps([cuts[i : i + w] for i in range(0, len(cuts), w)])), "array<array<bigint>>")
    ahead = F.size(F.filter(groups, lambda g: F.get(g, F.lit(0)) <= id_))
    inside = F.size(F.filter(F.get(groups, ahead - 1), lambda c: c <= id_))
    return F.when(id_.isNull(), len(cuts)).when(ahead == 0, 0).otherwise((ahead - 1) * w + inside)


def in_order(docs: DataFrame, id_col: str, per_range: int | None = None) -> tuple[DataFrame, int]:
    """(range, own, id, text) in ranges of `per_range` ids, each with a copy (own = false) of the row that follows it in the order of ids.

    Without `per_range` a range has 64,000 ids, fewer where that would leave the cluster's cores idle (four ranges to a core, of 2,000 ids at least).
    Ranges are bounded by quantiles of the ids; a range streams through its task in order, whatever its size. Only the ranges' first ids reach the driver. Null ids are in one order with the others, last; texts break ties."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    parts = -(-n // per_range) if per_range else max(-(-n // 64_000), min(-(-n // 2_000), 4 * spark.sparkContext.defaultParallelism))
    parts = max(1, parts)
    cuts = sorted(set(rows.stat.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    rows = rows.withColumn("range", _range_of(F.col("id").cast("long"), [int(c) for c in cuts]).cast("int"))
    order = F.struct(F.col("id").isNull().alias("late"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("tie"))
    firsts = sorted((r["range"], r["f"]) for r in rows.groupBy("range").agg(F.min(order).alias("f")).collect())  # a row for each range
    previous = spark.createDataFrame([(r, firsts[i - 1][0], f["late"], f["id"], f["tie"]) for i, (r, f) in enumerate(firsts)] or [], "range int, before int, late boolean, first long, tie long")
    border = rows.join(F.broadcast(previous), "range").where((F.col("id").isNull() == F.col("late")) & (F.coalesce(F.col("id").cast("long"), F.lit(0)) == F.col("first")) & (F.xxhash64("text") == F.col("tie")))
    border = border.select(F.col("before").alias("range"), F.lit(False).alias("own"), "id", "text").dropDuplicates(["range", "id"])
    return rows.select("range", F.lit(True).alias("own"), "id", "text").unionByName(border), parts


def _compared(marker: Marker, rows: list[tuple]) -> dict[str, list]:
    """The report of consecutive rows (own, id, text): each own row but the last is compared with its edited text and with the row that follows.

    A text's words before its last quarter are hashed once, for the text and for its edited text."""
    n, pieces, owner, other = len(rows), [], [], []
    out: dict[str, list] = {k: [] for k in ("id", "n_chars", "edited_sha256")}
    at = []
    for i, (own, key, text) in enumerate(rows):
        if not own or i + 1 == n:
            pieces.append(encode(text.lower()))
            owner.append(i)
            other.append(-1)
            continue
        new = edited(text, rows[i + 1][2])
        cut = _word_start(text, len(text) - len(text) // 4)
        # before the cut: both; behind it: one each
        for piece, a, b in ((text[:cut], i, n + i), (text[cut:], i, -1), (new[cut:], -1, n + i)):
            pieces.append(encode(piece.lower()))
            owner.append(a)
            other.append(b)
        at.append(i)
        for name, v in zip(out, (key, len(text), hashlib.sha256(encode(new)).hexdigest())):
            out[name].append(v)
    piece, place = marker.places(pieces)
    a, b = np.array(owner)[piece], np.array(other)[piece]
    marks = marker.marks(np.concatenate([a[a >= 0], b[b >= 0]]), np.concatenate([place[a >= 0], place[b >= 0]]), 2 * n)
    at = np.array(at, np.int64)
    out["fingerprint"], out["edited_fingerprint"] = as_text(marks[at]), as_text(marks[n + at])
    out["near_edited"], out["near_next"] = alike(marks[at], marks[n + at]), alike(marks[at], marks[at + 1])
    return out


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon: Lexicon | None = None, per_range: int | None = None) -> DataFrame:
    """Fingerprints every whole text, its edited text (the last quarter replaced by the start of the next document's, after the last comes
    the first) and compares both with its own: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty ones. Of repeated ids the order is that of a hash of their texts; null ids come last. An only document follows itself."""
    lexicon = lexicon or fit_lexicon(docs, text_col)
    rows, parts = in_order(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", per_range)
    rows = rows.repartitionById(parts, F.col("range")).sortWithinPartitions("range", F.desc("own"), F.col("id").asc_nulls_last(), F.xxhash64("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    target = arrow_schema(schema)

    def run(batches):
        marker, held, size = Marker(lexicon), [], 0

        def out() -> pa.RecordBatch:
            got = _compared(marker, held)
            return pa.RecordBatch.from_pydict({x.name: pa.array(got[x.name], x.type) for x in target}, schema=target)

        for b in batches:
            for row in zip(b.column("own").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist()):
                held.append(row)
                size += len(row[2]) + PER_ROW
                if size > CHUNK:
                    yield out()
                    held, size = held[-1:], len(row[2])
        if len(held) > 1:
            yield out()

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
