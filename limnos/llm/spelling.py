"""Spelling variants: words one inserted, deleted or replaced letter apart, found by FM-indexes that are searched from both ends.

If two words differ by one letter, the first half of the one stands unchanged at the start of the other, or its second half at the end. Spark deals
words out by halves, so that either search has all its answers in one task: a word goes by its own first half, where it asks, and by
what would be the first half of words a letter shorter or longer, where it answers; likewise by second halves. A task builds an FM-index over a
block of words with delimiters, in reading order for first halves and backwards for second ones. A search matches the half step by step as an
interval of suffix ranks and extends it over the other half with one error; all words of a block advance together. What both
searches find is counted once: the backward search leaves out words with an unchanged first half. Tasks send one row a word and search, not pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, materialize

LETTERS, LEAST, OCCURRENCES, LOSSES, FACTOR = "a-zÀ-ÿ", 7, 2, 31, 10
#: Rows of words that a task indexes at once (halves are not torn apart).
BLOCK = 60_000
#: Steps of a search after which equal states are merged each time; shorter searches hardly have any.
_MERGE_AFTER = 32


class FMIndex:
    """Suffix ranks over delimited words, read from the left: a state is the interval of suffixes that start with what has been read, and a step appends a letter.

    The text is stored backwards, so that appending is the backward step of the index. Suffixes are ordered as far as the longest word reaches."""

    def __init__(self, words: list[str]) -> None:
        text = "\0" + "\0".join(words) + "\0"
        letters, codes = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
        self.letters, self.codes = letters, codes.astype(np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.sizes + 1) - self.sizes
        back = self.codes[::-1]
        n = self.n = len(back)
        rank, depth = back.copy(), 1
        order = np.argsort(rank, kind="stable")
        while depth <= int(self.sizes.max(initial=0)) + 2:
            key = rank * (n + 1)
            key[: n - depth] += rank[depth:] + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
            rank[order] = np.cumsum(new)
            depth *= 2
            if rank[order[-1]] == n - 1:
                break
        self.order = order
        self.before = back[order - 1]  # the letter before each suffix; the text is a circle of delimiters
        self.steps = np.sort(self.before * (n + 1) + np.arange(n))

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with a letter appended, empty ones too."""
        key = letter * (self.n + 1)
        return np.searchsorted(self.steps, key + low), np.searchsorted(self.steps, key + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which of the intervals, letter, low, high) for every letter that may follow, delimiters left out. Equal intervals are looked up once."""
        one, back = np.unique(low, return_inverse=True)
        end = np.empty_like(one)
        end[back] = high
        size = end - one
        at = np.repeat(one - np.cumsum(size) + size, size) + np.arange(size.sum())
        sigma = len(self.letters)
        found = np.unique(np.repeat(np.arange(len(one)), size) * sigma + self.before[at])
        owner, letter = found // sigma, found % sigma
        owner, letter = owner[letter > 0], letter[letter > 0]
        a, b = self.step(letter, one[owner], end[owner])
        first, count = np.searchsorted(owner, np.arange(len(one))), np.bincount(owner, minlength=len(one))
        mine = count[back]
        take = np.repeat(first[back] - np.cumsum(mine) + mine, mine) + np.arange(mine.sum())
        return np.repeat(np.arange(len(low)), mine), letter[take], a[take], b[take]

    def near(self, asking: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, near word) by index, each pair once: words that begin with the first `half` letters of an asking word and differ from it by one error behind them."""
        q, n = asking, len(asking)
        low, high = self.step(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.n))
        none = (np.zeros(0, np.int64),) * 3
        wrong, out, j = none, [], 0
        while len(q) or len(wrong[0]):
            at = self.begin[q] + j
            open_ = half[q] <= j if len(q) else np.zeros(0, bool)
            left = self.sizes[q] > j
            if open_.any():
                some = np.flatnonzero(open_)
                who, letter, a, b = self.children(low[some], high[some])
                other = ~left[some][who] | (letter != self.codes[at[some][who]])
                who, letter, a, b = some[who[other]], letter[other], a[other], b[other]
                wrong = tuple(np.concatenate(x) for x in zip(wrong, (q[who], a, b)))  # a letter more
                replaced = left[who]
                missing = open_ & left
                ahead = tuple(np.concatenate(x) for x in zip((q[who[replaced]], a[replaced], b[replaced]), (q[missing], low[missing], high[missing])))
            else:
                ahead = none
            done = self.sizes[wrong[0]] == j
            if done.any():
                w = wrong[0][done]
                a, b = self.step(np.zeros(len(w), np.int64), wrong[1][done], wrong[2][done])
                full = b > a
                out.append((w[full], a[full]))
            wrong = tuple(x[~done] for x in wrong)
            wrong = self._read(*wrong, j)
            wrong = tuple(np.concatenate(x) for x in zip(wrong, ahead))
            q, low, high = self._read(q[left], low[left], high[left], j)
            j += 1
            if j > _MERGE_AFTER and len(wrong[0]) > 1:
                wrong = tuple(np.unique(np.stack(wrong), axis=1))
        if not out:
            return none[0], none[0]
        w, row = (np.concatenate(x) for x in zip(*out))
        # a row's suffix begins with the delimiter behind its word in the text read backwards, so it ends the word in reading order
        end = self.n - 1 - self.order[row]
        other = np.searchsorted(self.begin + self.sizes, end)
        pair = np.unique(w * (len(self.sizes) + 1) + other)
        return pair // (len(self.sizes) + 1), pair % (len(self.sizes) + 1)

    def _read(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.step(self.codes[self.begin[q] + j], low, high)
        some = b > a
        return q[some], a[some], b[some]


def near_in_block(words: list[str], asking: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, near word) by index in `words`, for asking words, each pair once: with the first half unchanged, or (backwards) with the second half unchanged and the first one changed."""
    size = np.array([len(w) for w in words])
    if not backwards:
        return FMIndex(words).near(asking, size // 2)
    w, other = FMIndex([x[::-1] for x in words]).near(asking, (size + 1) // 2)
    new = np.array([words[b][: len(words[a]) // 2] != words[a][: len(words[a]) // 2] for a, b in zip(w.tolist(), other.tolist())], bool)
    return w[new], other[new]


def _halves(word: Column) -> Column:
    """The cells of a word: (back, half, asks)."""
    n = F.length(word)
    cell = lambda back, k: F.struct(F.lit(back).alias("back"), (F.right(word, k) if back else F.left(word, k)).alias("half"), (k == ((n + 1) / 2 if back else n / 2).cast("int")).alias("asks"))
    front, back = ((n - 1) / 2).cast("int"), (n / 2).cast("int")
    return F.array(cell(False, front), cell(False, front + 1), cell(True, back), cell(True, back + 1))


_NEAR = "word string, n long, n_near long, best_n long, best string"


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) for every row of words (word, n; words differ and have two letters or more): how many other words are one error away, and the one of them with the largest n (ties: first in code-point order)."""
    cells = words.select("word", "n", F.explode(_halves(F.col("word"))).alias("c")).select("word", "n", "c.back", "c.half", "c.asks")
    target = arrow_schema(_NEAR)

    def found(t: pa.Table, back: bool) -> pa.RecordBatch:
        held: dict[str, list] = {}
        for w, n, asks in zip(*(t.column(c).to_pylist() for c in ("word", "n", "asks"))):
            held.setdefault(w, [n, False])[1] |= asks
        ws = sorted(held)
        n = np.array([held[w][0] for w in ws], np.int64)
        w, other = near_in_block(ws, np.flatnonzero([held[w][1] for w in ws]), back)
        order = np.lexsort((other, -n[other], w))
        w, other = w[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))[: len(w)]
        count = np.diff(np.append(first, len(w)))
        return pa.RecordBatch.from_arrays([pa.array([ws[k] for k in w[first].tolist()], pa.string()), pa.array(n[w[first]]), pa.array(count.astype(np.int64)), pa.array(n[other[first]]), pa.array([ws[k] for k in other[first].tolist()], pa.string())], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows > BLOCK:
                key = list(zip(held.column("back").to_pylist(), held.column("half").to_pylist()))
                end = len(key)
                cuts = [k for k in range(1, end) if key[k] != key[k - 1]]
                if not cuts:
                    break
                cut = next((k for k in reversed(cuts) if k <= BLOCK), cuts[0])
                turn = next((k for k in cuts if key[k][0] != key[k - 1][0]), end)
                cut = min(cut, turn)
                yield found(held.slice(0, cut), key[0][0])
                held = held.slice(cut)
        while held is not None and held.num_rows:
            back = held.column("back").to_pylist()
            cut = next((k for k in range(1, len(back)) if back[k] != back[k - 1]), len(back))
            yield found(held.slice(0, cut), back[0])
            held = held.slice(cut)

    met = cells.repartition("back", "half").sortWithinPartitions("back", "half").mapInArrow(run, _NEAR)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")).unionByName(met)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    out = rows.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, losses: int = LOSSES) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z in lower case, with at least `least` letters, and how often they occur.

    With `losses`, a run of a document loses a letter if that divides the CRC-32 of `<id>:<run>`, at the place that the CRC-32 modulo the run's length names: typing errors that do not depend on the order of rows. A null id is an empty string there; null texts have no runs."""
    text = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    run = F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run)
    word = F.col("run")
    if losses:
        rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % losses == 0, F.concat(F.left("run", at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.length("word") >= least)


def follow_forms(forms: DataFrame, tables: Scratch) -> DataFrame:
    """(word, root) for every row of forms (word, form; no circles): from word, follow forms to the last. Each round joins roots with roots, so that paths double."""
    step = forms.select("word", F.col("form").alias("root"))
    while True:
        step = tables.write(step, "roots")
        more = step.select(F.col("word").alias("root"), F.col("root").alias("then"))
        met = step.join(more, "root", "left")
        if met.where("then IS NOT NULL").isEmpty():
            return step
        step = met.select("word", F.coalesce("then", "root").alias("root"))


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words (word, n). form: the near word of largest n, if that is at least `factor` (over 1) times the word's; else null. root: the end of the path of forms, the word itself where there is none."""
    if factor <= 1:
        raise ValueError("factor: over 1, or forms may run in circles")
    with Scratch(words.sparkSession, "spelling") as tables:
        words = tables.write(words, "words")
        near = tables.write(near_words(words), "near")
        is_form = F.col("best_n") >= factor * F.col("n")
        rows = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n"))
        roots = follow_forms(rows.where("form IS NOT NULL").select("word", "form"), tables)
        out = rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialize(out, "spelling-groups")


def spelling_report(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word with two occurrences or more. Tables without texts have no words."""
    return group_variants(word_counts(docs).where(F.col("n") >= OCCURRENCES))
