"""Spelling variants against all pairs of words and a plain reading of the rules."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from limnos.llm import spelling


def one_apart(a, b):
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def counted(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def grouped(words):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    best = {w: min(x, key=lambda y: (-words[y], y)) if x else None for w, x in near.items()}
    form = {w: b if b is not None and words[b] >= 10 * words[w] else None for w, b in best.items()}
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def vocabulary(seed, n=400):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abé"))
    out = set()
    while len(out) < n:
        w = "".join(rng.choice(letters, rng.integers(7, 12)))
        out.add(w)
        for _ in range(3):
            k, c = int(rng.integers(len(w))), str(rng.choice(letters))
            out |= {x for x in (w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], c + w, w + c) if len(x) >= 7}
    return {w: int(10 ** rng.uniform(0.4, 4)) for w in sorted(out)}


def test_index_finds_all_pairs():
    words = sorted(vocabulary(1))
    asking = np.arange(0, len(words), 2)
    got = set()
    for back in (False, True):
        w, other = spelling.near_in_block(words, asking, back)
        pairs = set(zip(w.tolist(), other.tolist()))
        assert len(pairs) == len(w) and not got & pairs
        got |= pairs
    assert got == {(a, b) for a in asking.tolist() for b in range(len(words)) if one_apart(words[a], words[b])}


@pytest.mark.parametrize(("seed", "block"), [(2, 60_000), (3, 50), (4, 1)])
def test_groups(spark, monkeypatch, seed, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = vocabulary(seed)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert sorted(tuple(r) for r in spelling.group_variants(df).select(COLUMNS).collect()) == grouped(words)


def test_paths_of_forms(spark):
    """Each word is ten times as frequent as the one before: forms lead over many words to one root."""
    words = {"abcdefgh" + "i" * k: 2 * 10**k for k in range(12)} | {"zzzzzzz": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(tuple(r) for r in spelling.group_variants(df).select(COLUMNS).collect()) == grouped(words)


def texts(seed, n=150):
    rng = np.random.default_rng(seed)
    base = ["running", "stopped", "Écriture", "straßen", "letters", "lettres", "thousand", "thousands", "SHORT", "wonderful", "aaaaaaa", "aaaaaaaa"]
    p = np.array([2.0 ** -k for k in range(len(base))])
    return [(i, " ".join(str(x) for x in rng.choice(base, rng.integers(0, 120), p=p / p.sum())).replace("pp", "pP")) for i in range(n)]


def report(spark, rows):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, word string, n string, run string").repartition(3)
    return sorted((tuple(r) for r in spelling.spelling_report(docs).select(COLUMNS).collect()))


def test_documents(spark):
    rows = texts(5, 900)
    want = grouped(counted(rows))
    assert report(spark, rows) == want
    assert sum(r[1] is not None for r in want) > 4


def test_odd_rows(spark):
    """Null ids and texts, texts without letters, repeated rows, signs between letters, letters outside the range, long words of one letter and of many."""
    long = "".join(np.random.default_rng(6).choice(list("abcdefg"), 3000))
    rows = [(None, "wonderful wonderful"), (None, None), (1, "wonderful"), (1, "wonderful"), (2, ""), (3, "12 - ,"), (4, "won’derful wonderfulœwonderful wonderfu wonderfu"), (5, "é" * 900 + " " + "é" * 901 + " " + "é" * 900), (6, f"{long} {long} {long[:-1]} {long[:-1]} {'é' * 901}"), (7, "WONDERFUL×÷")]
    assert report(spark, rows) == grouped(counted(rows))
    assert report(spark, []) == [] and report(spark, [(1, None)]) == []
