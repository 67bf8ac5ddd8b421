"""Quality classifier: random Fourier features approximate a Gaussian kernel over document statistics; normal equations are summed
over partitions, a ridge solution gives scores, isotonic regression calibrates them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, isotonic, labelled_sample, map_batches, map_texts, materialize

#: Bytes whose shares are statistics of their own.
_MARKS = (b".,;:", b"!?", b"*#%&$@^~", b"|<>{}[]/\\=_", b"\"'()-", b"0123456789", b"\n", b" \t\r")
_BINS = 1000


def document_statistics(text: str | None) -> list[float]:
    """Shape statistics of a whole text; null and empty texts give those of no words."""
    t = text or ""
    raw = np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256).astype(float)
    n = max(raw.sum(), 1.0)
    words = t.split()
    nw = max(len(words), 1)
    counts = Counter(words)
    lines = t.split("\n")
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    share = raw[raw > 0] / n
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    return [
        np.log1p(len(t)), np.log1p(len(words)), sizes.mean(), min(sizes.std(), 20.0), min(np.log1p(sizes.max()), 8.0), float((sizes <= 3).mean()),
        raw[65:91].sum() / n, raw[97:123].sum() / n, raw[128:].sum() / n, *[raw[list(m)].sum() / n for m in _MARKS],
        len(counts) / nw, pairs, max(counts.values(), default=0) / nw, sum(map(eq, words, words[1:])) / nw,
        len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(words) / len(lines)), float(-(share * np.log(share)).sum()), np.log1p(len(counts)),
    ]


N_STATISTICS = len(document_statistics("a"))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    rates: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Standardised statistics, their random Fourier features, and 1."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.freq + self.phase) * np.sqrt(2 / len(self.phase)), z, np.ones((len(z), 1))])

    def bins(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights
        return np.clip((raw - self.low) / (self.high - self.low) * _BINS, 0, _BINS - 1).astype(int)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.rates[self.bins(np.array([document_statistics(t) for t in texts]))]


def _sums(df: DataFrame, of, cells: int) -> np.ndarray:
    """`cells` numbers: the sum over partitions of what `of` makes of (statistics, y). Each task adds its batches before anything is shuffled."""

    def run(batches):
        total = np.zeros(cells)
        for b in batches:
            if b.num_rows:
                total += of(np.array(b.column("x").to_pylist()), b.column("y").to_numpy(zero_copy_only=False).astype(float), b.column("fold").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "v"])

    out = np.zeros(cells)
    for r in df.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # at most `cells` rows
        out[r["at"]] = r["v"]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", features: int = 160, ridge: float = 1e-3, seed: int = 7, most: int = 60_000) -> QualityModel:
    """Fits on at most `most` labelled documents (a bounded sample, see labelled_sample), those with crc32(id) mod 4 = 2 left out.

    What reaches the driver: sums of a fixed number of cells. No labelled rows: every score is 0.5."""
    sample = F.broadcast(labelled_sample(labels, label, id_col, most))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    rows = rows.select("text", "y", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)).cast("int").alias("fold"))
    rows = materialize(map_batches(rows, lambda b: {"x": [document_statistics(t) for t in b["text"]], "y": b["y"], "fold": b["fold"]}, "x array<double>, y int, fold int"), "quality-rows")
    k = N_STATISTICS
    got = _sums(rows, lambda x, y, _: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * k)
    n = max(got[0], 1.0)
    mean = got[2 : 2 + k] / n
    scale = np.sqrt(np.maximum(got[2 + k :] / n - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(size=(k, features)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, features), np.zeros(features + k + 1), 0.0, 1.0, np.full(_BINS, 0.5))
    if not got[0]:
        return model
    d = features + k + 1
    upper = np.triu_indices(d)

    cells = len(upper[0]) + d

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = []
        for k in (0, 1):
            f, own = model.features(x[fold == k]), y[fold == k]
            out += [(f.T @ f)[upper], f.T @ own]
        return np.concatenate(out)

    def solved(sums: np.ndarray) -> np.ndarray:
        gram = np.zeros((d, d))
        gram[upper] = sums[:-d]
        gram += np.triu(gram, 1).T
        rows_ = gram[-1, -1]
        penalty = np.full(d, ridge * max(rows_, 1.0))
        penalty[-1] = 1e-6
        return np.linalg.solve(gram + np.diag(penalty), sums[-d:])

    halves = _sums(rows, normal, 2 * cells).reshape(2, cells)
    model.weights = solved(halves.sum(0))
    model.low, model.high = -0.25, 1.25
    # each half is calibrated on scores that the other half's solution gives it
    other = [replace(model, weights=solved(h)) for h in halves[::-1]]

    def calibration(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        b = np.where(fold == 0, other[0].bins(x), other[1].bins(x))
        return np.concatenate([np.bincount(b, y, _BINS), np.bincount(b, minlength=_BINS)])

    got = _sums(rows, calibration, 2 * _BINS)
    model.rates = isotonic(got[:_BINS], got[_BINS:])
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every whole text; null and empty texts are scored as texts without words. Null and repeated ids stay; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, lambda b: {"id": b["id"], "score": model.score(b["text"])}, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, model: QualityModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`."""
    return map_texts(docs, lambda texts: model.score(texts) >= least, text=text_col)


def quality_report(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
