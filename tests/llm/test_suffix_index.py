"""Removal of repeated bytes against all windows; samples, levels, names that collide, crowded suffixes and pieces of long texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from limnos.llm import suffix_index as si
from limnos.llm.common import Scratch


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k : k + 200] for _, d in data for k in range(len(d) - 199))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - 199):
            if count[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((str(i), len(d), len(d) - len(kept), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], "doc_id long, text string, name string, k1 string").repartition(3)
    return sorted((str(r[0]), *r[1:]) for r in si.remove_repeats(docs, keep=False, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def corpus(seed, n=60):
    """Passages of 150 to 700 characters in changing neighbourhoods, near copies, periods, runs of one letter, letters of two bytes."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefgh éß"))
    text = lambda n: "".join(rng.choice(letters, n))
    passages = [text(k) for k in (120, 170, 190, 200, 201, 260, 400, 700)] + ["ab" * 150, "x" * 260, text(37) * 9]
    rows = []
    for i in range(n):
        parts = [passages[rng.integers(len(passages))] if rng.random() < 0.5 else text(rng.integers(1, 300)) for _ in range(rng.integers(0, 6))]
        rows.append((i, "".join(parts)))
        if rng.random() < 0.3 and rows[-1][1]:
            t = rows[-1][1]
            at = int(rng.integers(len(t)))
            rows.append((1000 + i, t[:at] + "#" + t[at + 1 :]))
    return rows


@pytest.mark.parametrize(("seed", "batches"), [(1, 4), (2, 1), (3, 3)])
def test_all_windows(spark, seed, batches):
    rows = corpus(seed)
    assert found(spark, rows, batches=batches) == brute(rows)


def test_odd_rows(spark):
    """Null and empty texts, a null id, repeated ids and rows, 199 and 200 bytes, a long period, a text with nothing but one letter."""
    rng = np.random.default_rng(4)
    t = "".join(rng.choice(list("abcd "), 450))
    rows = [(1, t), (1, t), (1, "other " + t[:230]), (None, t[100:350]), (None, None), (2, ""), (3, t[:199]), (4, "z" * 3000), (5, "z" * 199), (6, t[:120] + "!" + t[121:]), (7, "no repeat here")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])


def test_pieces_and_crowded_suffixes(spark, monkeypatch):
    monkeypatch.setattr(si, "_CHUNK", 333)
    rows = corpus(5, 30)
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(si, "_MOST_CONTEXTS", 1)
    monkeypatch.setattr(si, "_REMEMBERED", 2)
    assert found(spark, rows) == brute(rows)


def test_names_that_collide(monkeypatch):
    """With names of two values, whatever is compared is compared by bytes."""
    name = si.doubled
    texts = [t.encode()[:330] for _, t in corpus(6, 40) if len(t.encode()) > 200]
    texts = list(dict.fromkeys(texts))
    want = si.repeated_offsets(texts, np.ones(len(texts), np.int64))
    monkeypatch.setattr(si, "doubled", lambda data, n: name(data, n) % np.uint64(2))
    got = si.repeated_offsets(texts, np.ones(len(texts), np.int64))
    offsets = lambda runs: [sorted({k for x, y in r for k in range(x, y + 1)}) for r in runs]
    assert offsets(got) == offsets(want) and any(want)


def test_equal_strings_sample_the_same_suffix():
    rng = np.random.default_rng(7)
    same = rng.integers(97, 101, 200).astype(np.uint8).tobytes()
    at = set()
    for k in range(20):
        before, after = (rng.integers(97, 101, int(rng.integers(0, 400))).astype(np.uint8).tobytes() for _ in range(2))
        s = si.Sampled([b"q" * 250, before + same + after])
        w = 250 + len(before)
        k = np.flatnonzero((s.first <= w) & (s.last >= w))
        assert len(k) == 1
        at.add((int(s.at[k[0]]) - w, int(s.name[k[0]])))
    assert len(at) == 1


def test_levels(spark):
    """Batch sizes add up like binary digits, levels are in order, and every batch meets what came before."""
    batches = [[(k % 7, k % 3, 1) for k in range(b, b + 5)] for b in range(6)]
    with Scratch(spark, "levels") as tables:
        index = si.SuffixIndex(tables, 2)
        held = Counter()
        for b, rows in enumerate(batches, 1):
            got = {tuple(r) for r in index.add(spark.createDataFrame(rows, "head long, name long, n int")).collect()}
            new = Counter((h, n) for h, n, _ in rows)
            assert got == {x for x, n in new.items() if n > 1 or held[x]}
            held += new
            assert [x is not None for x in index.levels] == [bool(b >> k & 1) for k in range(len(index.levels))]
        assert sum((Counter({(r["head"], r["name"]): r["n"] for r in x.collect()}) for x in index.levels if x is not None), Counter()) == held
        index.close()
    assert not spark.catalog.listTables() or all(not t.name.startswith("suffixes_") for t in spark.catalog.listTables())


def test_kept_bytes_and_spans(spark):
    rows = corpus(8, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in si.remove_repeats(docs).collect():
        data = dict(rows)[r["doc_id"]].encode()
        left = b"".join(data[a:b] for a, b in zip([0, *(s["end"] for s in r["spans"])], [*(s["begin"] for s in r["spans"]), len(data)]))
        assert left == bytes(r["kept"]) and hashlib.sha256(left).hexdigest() == r["kept_sha256"] and len(r["spans"]) == r["n_spans"]
