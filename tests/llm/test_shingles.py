"""The near-dedup of the pipeline against brute force over all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from limnos.llm import shingles, simhash
from limnos.llm.common import words_of


def edited_copies(seed=3):
    rng = np.random.default_rng(seed)
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE two"), (None, "one two three"), (1005, "a b c d e f"), (1006, "a b c d e f")]
    shared = [f"s{k}" for k in range(40)]
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 4000, rng.integers(20, 260))]
        if base % 3 == 0:
            words[5:5] = shared
        for copy in range(6):
            own = list(words)
            for at in rng.integers(0, len(own), rng.integers(0, 1 + len(own) // 25)):
                own[at] = f"e{rng.integers(0, 9999)}"
            rows.append((base * 10 + copy, " ".join(own)))
    return [rows[i] for i in rng.permutation(len(rows))]


def brute_groups(rows, shingle=5, similarity=0.8):
    def grams(t):
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                was, now = root[i], root[j]
                root = [now if r == was else r for r in root]
    return root


def test_edited_copies_go(spark, tmp_path):
    rows = edited_copies()
    docs = spark.createDataFrame([(i, t, "kept_id") for i, t in rows], "doc_id long, text string, kept_id string").repartition(3)
    root = brute_groups(rows)
    want = sorted(min((i is None, i or 0) for (i, _), r in zip(rows, root) if r == g) for g in set(root))
    got = corpus_pipeline.near_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == want
    assert simhash.drop_near(docs).count() > len(want)
    assert shingles.drop_similar(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 10, 99, 100])
def test_prefix_length(n):
    assert shingles.prefix_length(n, 0.8) == n - -(-4 * n // 5) + 1


def test_least_difference_is_a_bound():
    rng = np.random.default_rng(1)
    for n, extra in ((1, 0), (7, 3), (60, 9), (500, 40), (520, 300)):
        x = np.unique(rng.integers(-(2**62), 2**62, n))
        y = np.unique(np.concatenate([x[: n - n // 10], rng.integers(-(2**62), 2**62, extra)]))
        assert shingles.least_difference(shingles.odd_bits(x), shingles.odd_bits(y)) <= len(np.setxor1d(x, y))
