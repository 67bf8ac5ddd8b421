"""Language ID by segmentation-marginalised unigrams: per-language piece probabilities over a fixed public vocabulary; a forward algorithm sums all segmentations of a word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches

#: Longer words are summed over in logarithms: products of so many probabilities could vanish.
_PLAIN = 24
#: Cells (letters x piece lengths x languages) of words that are worked on at once; a longer word on its own.
_CELLS = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


def read_pieces(path: str) -> list[str]:
    """Lower-cased distinct pieces of letters (and the word mark) of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in found if p and all(c.isalpha() or c == "▁" for c in p))


class Pieces:
    """Finds pieces by a rolling hash of code points, in two fixed tables; what collides in the first is in the second."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.longest = pieces, max(map(len, pieces))
        with np.errstate(over="ignore"):
            self.keys = np.array([self._hash(p) for p in pieces], np.uint64)
            assert len(set(self.keys.tolist())) == len(pieces)
            self.tables, self.salts, left = [], [], np.arange(len(pieces))
            for salt in range(1, 1000, 2):
                slot = self._slot(self.keys[left], salt)
                _, first = np.unique(slot, return_index=True)
                if self.tables and len(first) < len(left):
                    continue
                table = np.full(1 << _SLOTS, -1, np.int32)
                table[slot[first]] = left[first]
                self.tables.append(table)
                self.salts.append(salt)
                left = np.delete(left, first)
                if not len(left):
                    break
            assert not len(left)

    @staticmethod
    def _slot(keys: np.ndarray, salt: int) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * (_MULTIPLIER * np.uint64(salt))) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        for c in piece:
            h = h * np.uint64(1_000_003) + np.uint64(ord(c))
        return h + np.uint64(len(piece))

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int32)
        for table, salt in zip(self.tables, self.salts):
            got = table[self._slot(keys, salt)]
            np.copyto(out, got, where=(got >= 0) & (self.keys[got] == keys))
        return out

    def lattice(self, words: list[str]) -> list[np.ndarray]:
        """For words of one length n: by piece length l (from 1) the piece ids that start at each position (positions, words), -1 for none."""
        n = len(words[0])
        codes = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).T).astype(np.uint64)
        out, h = [], np.zeros_like(codes)
        with np.errstate(over="ignore"):
            for size in range(1, min(n, self.longest) + 1):
                h = h[: n - size + 1] * np.uint64(1_000_003) + codes[size - 1 :]
                out.append(self.find(h + np.uint64(size)))
        return out


def _groups(words: list[str], longest: int, columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, which words have this length), in groups of bounded size."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, at in groups.items():
        step = max(1, _CELLS // (n * min(n, longest) * max(columns, 1)))
        for i in range(0, len(at), step):
            yield n, np.array(at[i : i + step])


def _chances(grid: list[np.ndarray], prob: np.ndarray, unknown: float) -> list[np.ndarray]:
    """By piece length (positions, words, columns): the piece probabilities. A letter that is no piece counts `unknown`, no other piece nothing."""
    out = []
    for k, g in enumerate(grid):
        more = np.full((1, prob.shape[1]), unknown if k == 0 else 0.0)
        out.append(np.concatenate([prob, more])[g])  # -1 is the last row
    return out


def forward(p: list[np.ndarray]) -> np.ndarray:
    """The logarithm of the summed probability of all segmentations of every prefix (n + 1, words, columns)."""
    n = len(p[0])
    if n > _PLAIN:
        return _forward_log(p)
    alpha = np.zeros((n + 1, *p[0].shape[1:]))
    alpha[0] = 1
    for j in range(1, n + 1):
        for k in range(min(j, len(p))):
            alpha[j] += alpha[j - k - 1] * p[k][j - k - 1]
    with np.errstate(divide="ignore"):
        return np.log(alpha)


def _forward_log(p: list[np.ndarray]) -> np.ndarray:
    n = len(p[0])
    with np.errstate(divide="ignore"):
        p = [np.log(x) for x in p]
    alpha = np.full((n + 1, *p[0].shape[1:]), -np.inf)
    alpha[0] = 0
    for j in range(1, n + 1):
        for k in range(min(j, len(p))):
            alpha[j] = np.logaddexp(alpha[j], alpha[j - k - 1] + p[k][j - k - 1])
    return alpha


def backward(p: list[np.ndarray]) -> np.ndarray:
    """As `forward`, of every suffix: the pieces read from the other end."""
    n = len(p[0])
    return forward([x[::-1] for x in p])[::-1] if n else forward(p)


def letters_of(token: str) -> str:
    """The letters of a token, lower case, behind the word mark; empty if it has none."""
    word = token.lower()
    if not word.isalpha():
        word = "".join(c for c in word if c.isalpha())
    return word and "▁" + word


def expected_counts(pieces: Pieces, words: list[str], weights: np.ndarray, prob: np.ndarray, unknown: float) -> np.ndarray:
    """Expected uses of each piece by language over all segmentations; weights: (words, languages) counts. prob has one column for each language, or one for all."""
    out = np.zeros((len(pieces.pieces), weights.shape[1]))
    for n, own in _groups(words, pieces.longest, weights.shape[1]):
        grid = pieces.lattice([words[x] for x in own])
        p = _chances(grid, prob, unknown)
        alpha, beta = forward(p), backward(p)
        whole = alpha[n]
        for k, g in enumerate(grid):
            at, word = np.nonzero(g >= 0)
            if len(at):
                use = np.exp(alpha[at, word] + beta[at + k + 1, word] - whole[word]) * p[k][at, word] * weights[own[word]]
                piece = g[at, word]
                for lang in range(weights.shape[1]):
                    out[:, lang] += np.bincount(piece, use[:, lang], len(out))
    return out


@dataclass
class LanguageModel:
    vocabulary: list[str]
    languages: list[str]
    log_prior: np.ndarray
    prob: np.ndarray
    unknown: float = 1e-7

    def word_scores(self, pieces: Pieces, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for n, own in _groups(words, pieces.longest, len(self.languages)):
            out[own] = forward(_chances(pieces.lattice([words[x] for x in own]), self.prob, self.unknown))[n]
        return out

    def predictor(self):
        """A function of texts: (language, score). It remembers tokens' scores, a bounded number of them."""
        pieces = Pieces(self.vocabulary)
        rows: dict[str, int] = {}
        held = [np.zeros((0, len(self.languages) + 1))]

        def learn(tokens: list[str]) -> None:
            if len(rows) + len(tokens) > 400_000:
                rows.clear()
                held[0] = held[0][:0]
            words = [letters_of(t) for t in tokens]
            got, at = np.zeros((len(tokens), len(self.languages) + 1)), np.flatnonzero([w != "" for w in words])
            if len(at):
                number = {w: i for i, w in enumerate(dict.fromkeys(w for w in words if w))}  # tokens of the same letters are summed once
                got[at, :-1] = self.word_scores(pieces, list(number))[[number[words[i]] for i in at]]
                got[at, -1] = 1
            rows.update(zip(tokens, range(len(held[0]), len(held[0]) + len(tokens))))
            held[0] = np.vstack([held[0], got])

        def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
            langs, scores = [], []
            for start in range(0, len(texts), 500):
                bags = [Counter((t or "").split()) for t in texts[start : start + 500]]
                new = list({w for bag in bags for w in bag if w not in rows})
                if new:
                    before = len(rows)
                    learn(new)
                    if len(rows) < before + len(new):
                        learn([w for w in {w for bag in bags for w in bag} if w not in rows])
                for bag in bags:
                    got = np.fromiter(bag.values(), float, len(bag)) @ held[0][[rows[w] for w in bag]] if bag else np.zeros(1)
                    if not got[-1] or not self.languages:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    x = got[:-1] + self.log_prior
                    x = np.exp(x - x.max())
                    best = int(x.argmax())
                    langs.append(self.languages[best])
                    scores.append(float(x[best] / x.sum()))
            return langs, scores

        return predict


def fit_language(docs: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", smooth: float = 0.1) -> LanguageModel:
    """One expectation step over all given documents from uniform piece probabilities, then smoothed piece frequencies by language.

    Each task sums expected counts over its documents; what is shuffled is a row for each task, piece and language, what reaches the driver
    a row for each piece of the vocabulary and language. Null languages and null texts teach nothing."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())  # a row for each language
    langs, number = [x for x, _ in seen], {x: i for i, (x, _) in enumerate(seen)}
    words = read_pieces(vocabulary)
    v, k = len(words), len(langs)
    if not langs:
        return LanguageModel(words, [], np.zeros(0), np.zeros((v, 0)))

    def run(batches):
        pieces, total, bags, first = Pieces(words), np.zeros((v, k)), [Counter() for _ in langs], np.full((v, 1), 1.0 / v)

        def add() -> None:
            words: dict[str, np.ndarray] = {}
            for i, bag in enumerate(bags):
                for token, n in bag.items():
                    word = letters_of(token)
                    if word:
                        words.setdefault(word, np.zeros(k))[i] += n
                bag.clear()
            if words:
                total.__iadd__(expected_counts(pieces, list(words), np.array(list(words.values())), first, 1e-7))

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                bags[number[lang]].update(text.split())
                if sum(map(len, bags)) > 300_000:
                    add()
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["at", "v"])

    counts = np.zeros(v * k)
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toLocalIterator():
        counts[r["at"]] = r["v"]
    counts = counts.reshape(v, k) + smooth
    n = np.array([x for _, x in seen], float)
    return LanguageModel(words, langs, np.log(n / n.sum()), counts / counts.sum(0))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (posterior) of every whole text; 'und' and 0 for null texts and those without a letter. Null and repeated ids stay; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(b: dict, predict) -> dict:
        langs, scores = predict(b["text"])
        return {"id": b["id"], "lang_pred": langs, "score": scores}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), step, f"id {kind}, lang_pred string, score double", model.predictor).withColumnRenamed("id", id_col)


def language_report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents whose crc32(doc_id) mod 3 is not 1."""
    part = crc_mod(F.col("doc_id"), 3)
    model = fit_language(docs.where(part != 1), vocabulary)
    return predict_language(docs, model).select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")
