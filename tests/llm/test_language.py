"""Language ID against enumeration of all segmentations: learned piece probabilities, posteriors, long words, long pieces."""

import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from limnos.llm import language
from limnos.llm.queries import vocabulary

PIECES = vocabulary("piece_bpe_32k.model")


def letters(token):
    w = "".join(c for c in token.lower() if c.isalpha())
    return "▁" + w if w else ""


def segmentations(word, pieces):
    """All ways to cut a word into pieces; a letter that is no piece stands alone."""
    if not word:
        yield ()
        return
    for k in range(1, len(word) + 1):
        if word[:k] in pieces or k == 1:
            for rest in segmentations(word[k:], pieces):
                yield (word[:k], *rest)


def test_the_report_by_enumeration(spark):
    rng = np.random.default_rng(2)
    words = {"en": ["the", "cat", "here", "of", "in"], "de": ["die", "katze", "hier", "auf", "in"]}
    rows = [(i, " ".join(rng.choice(words[g], 6)), g) for i in range(24) for g in [("en", "de")[i % 2]]] + [(90, "123 !!", "en"), (91, None, "de"), (92, "in", None), (93, "Ünx", "de")]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[2] and r[1]]
    pieces = set(language.read_pieces(PIECES))
    v, langs = len(pieces), sorted({r[2] for r in train})
    unknown = 1e-7
    counts = {g: defaultdict(float) for g in langs}
    first = lambda x: 1 / v if x in pieces else unknown
    for _, text, g in train:
        for w in filter(None, map(letters, text.split())):
            ways = [(s, math.prod(map(first, s))) for s in segmentations(w, pieces)]
            whole = sum(p for _, p in ways)
            for s, p in ways:
                for x in s:
                    if x in pieces:
                        counts[g][x] += p / whole
    total = {g: sum(counts[g].values()) + 0.1 * v for g in langs}
    chance = lambda g, x: (counts[g][x] + 0.1) / total[g] if x in pieces else unknown
    prior = Counter(r[2] for r in train)
    for r in language.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        own = [w for w in map(letters, (text or "").split()) if w]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = {g: math.log(prior[g] / sum(prior.values())) + sum(math.log(sum(math.prod(chance(g, x) for x in s) for s in segmentations(w, pieces))) for w in own) for g in langs}
        best = max(logs, key=logs.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), abs=1e-6)


def test_long_words_and_long_pieces():
    """Nothing is cut: pieces of any length count, and words of any length are summed whole."""
    pieces = ["a", "b", "ab", "abababababababab", "▁"]
    prob = np.array([[0.1, 0.2], [0.2, 0.1], [0.05, 0.3], [0.3, 0.1], [0.3, 0.3]])
    p = language.Pieces(pieces)
    m = language.LanguageModel(p.pieces, ["x", "y"], np.zeros(2), prob)
    for word in ("▁" + "ab" * 8, "▁" + "ab" * 40, "▁" + "abb" * 400, "▁" + "q" * 3000):

        @lru_cache
        def logs(n, k, word=word):
            if not n:
                return 0.0
            ends = [(x, prob[i, k]) for i, x in enumerate(pieces) if word[:n].endswith(x)]
            if word[n - 1] not in pieces:
                ends.append((word[n - 1], 1e-7))
            return np.logaddexp.reduce([math.log(c) + logs(n - len(x), k) for x, c in ends])

        for n in range(len(word)):  # fills the cache from the front
            logs(n, 0), logs(n, 1)
        assert m.word_scores(p, [word])[0] == pytest.approx([logs(len(word), 0), logs(len(word), 1)])
    assert max(map(len, language.read_pieces(PIECES))) > 10


def test_expected_counts_of_long_words():
    """Expected uses add up to the word's letters, however long it is."""
    p = language.Pieces(["a", "b", "ab", "ba", "▁"])
    for n in (3, 30, 2000):
        use = language.expected_counts(p, ["▁" + "ab" * n], np.array([[2.0]]), np.full((5, 1), 0.2), 1e-7)[:, 0]
        assert use @ [len(x) for x in p.pieces] == pytest.approx(2 * (2 * n + 1))
