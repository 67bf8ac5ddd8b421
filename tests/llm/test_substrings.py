"""Recompression against brute force: settled symbols, runs, pairs that only differ at their ends, crowded anchors."""

import numpy as np
import pytest

from limnos.llm import substrings
from limnos.llm.common import words_of
from limnos.llm.hashing import WordDigests


def brute(rows):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 63), i)
    out = []
    for i, t in rows:
        w, gone = words_of(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def corpus(seed, documents=80):
    """Few words, so that runs, alternations and chance repeats are common, and passages that documents share."""
    rng = np.random.default_rng(seed)
    rows = []
    passages = [" ".join(f"p{x}" for x in rng.integers(0, 300, n)) for n in (12, 13, 14, 40, 90)] + ["be " * n for n in (12, 13, 20, 60)] + ["ab cd " * 15]
    for i in range(documents):
        parts = []
        for _ in range(rng.integers(0, 7)):
            kind = rng.integers(0, 4)
            if kind == 0:
                parts.append(passages[rng.integers(0, len(passages))])
            elif kind == 1:
                parts.append(" ".join(rng.choice(["x", "y", "z"], rng.integers(1, 40))))
            else:
                parts.append(" ".join(f"w{x}" for x in rng.integers(0, 2000, rng.integers(1, 60))))
        rows.append((int(i * 7 % 81), " ".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (2, 20_000), (3, 5), (4, 1)])
def test_against_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(substrings, "_MOST_ROWS", group)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if seed % 2 else 10_000)  # groups go on over batches
    rows = corpus(seed)
    got = substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_with_different_ends_stay(spark):
    middle = "b791460 c727345 d972780 e326865 f416599 g391108 h22462 i980147 j560946 k166649 l6859"
    rows = [(1, f"p786 {middle} q537440"), (2, f"p1014 {middle} q914392")]
    assert {r["n_removed"] for r in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_a_window_that_settles_a_symbol_has_it_wherever_it_stands():
    """The symbols that a window settles are the same in another document, on every level."""
    rng = np.random.default_rng(5)
    for seed in range(40):
        passage = " ".join(rng.choice(["a", "b", "c", "d", "e"] if seed % 2 else [f"w{k}" for k in range(60)], 30))
        texts = [" ".join([*rng.choice(["a", "b", "x"], 4), passage, *rng.choice(["a", "b", "y"], 4)]).encode() for _ in range(2)]
        p = substrings.Parsed(WordDigests(), [*texts, b"", passage.encode()])
        with np.errstate(over="ignore"):
            for level in range(4):
                s = p.level(level).settled()
                assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all()
                window = p.windows()
                begin, end = p.ranges(s, window)
                found = {}
                for w, b, e in zip(window, begin, end):
                    assert [k for k in range(len(s.low)) if s.low[k] >= w and s.high[k] <= w + 13] == list(range(b, e))
                    key = tuple(p.word[w : w + 13])
                    own = [(s.name[k], s.low[k] - w, s.high[k] - w) for k in range(b, e)]
                    assert found.setdefault(key, own) == own
            anchors = {}
            for w, a in zip(p.windows(), p.anchors(p.windows())):
                assert anchors.setdefault(tuple(p.word[w : w + 13]), a) == a


def test_a_smaller_bitmap_changes_nothing(spark, monkeypatch):
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "_MOST_BITS", 16)
    assert sorted((r["doc_id"], r["n_removed"]) for r in substrings.cut_repeats(docs).collect()) == [(i, n) for i, _, n, _ in brute(rows)]


def test_prints_hold_128_bits(spark):
    """No window is judged by fewer than two independent 64-bit hashes."""
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20))), (2, " ".join(f"w{k}" for k in range(20)))], "doc_id long, text string")
    known = substrings.recompress(docs)[0]
    rows = substrings._candidates(docs, "doc_id", "text", known, None, 0).collect()
    assert sum(len(r["prints"]) for r in rows) == 16 * 8 * 2
    halves = {bytes(r["prints"][k : k + 8]) for r in rows for k in range(0, len(r["prints"]), 8)}
    assert len(halves) == 16


@pytest.mark.parametrize("letters", [512, 1024, 2048])
def test_words_that_share_every_polynomial_hash(spark, letters):
    """A Thue-Morse word and its complement have the same polynomial modulo 2^64 in every odd base, from 1,024 letters on."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(letters))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(k, " ".join([*(f"w{i}" for i in range(6)), w, *(f"z{i}" for i in range(6))])) for k, w in enumerate((word, other, word), 1)]
    got = substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == brute(rows)


def test_names_of_words():
    """Names tell words apart that differ in zero bytes, length or one letter, and are the same wherever a word stands."""
    words = [b"a", b"a\0", b"a\0\0", b"abcdefgh", b"abcdefg", b"abcdefghi", b"abcdefghj", b"x" * 300, b"x" * 301, "é".encode()]
    h = WordDigests()

    def names(texts):
        data, _, begin, end = h.split(texts)
        return [tuple(x) for x in h.names(data, begin, end).tolist()]

    one = names([b" ".join(words)])
    assert len(set(one)) == len(words) and names([b"", b"  ", b"\t".join(words[::-1]), b"\n"]) == one[::-1] and names([b"", b" "]) == []
