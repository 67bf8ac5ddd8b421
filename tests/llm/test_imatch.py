"""I-Match against a scalar version: document frequencies, the band, every subset's mark, both likenesses and the edited texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from limnos.llm import imatch
from limnos.llm.common import words_of
from limnos.llm.hashing import BASES

M = (1 << 64) - 1


def scalar_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def scalar_hash(values, base):
    return scalar_mix(sum(v * pow(base, i, 1 << 64) for i, v in enumerate(values)) & M)


def term(word):
    return scalar_hash([scalar_mix(b + 1) for b in word.lower().encode()], BASES[0])


def brute_fingerprint(text, band, seed):
    places = sorted({scalar_mix(term(w) ^ scalar_mix(seed + 1)) for w in words_of(text) if w.lower() in band})
    out = []
    for k, used in enumerate(imatch.SUBSETS):
        for cell in range(used):
            own = [p for p in places if p >> (64 - 2 * k) == cell]
            out.append(max(1, scalar_hash(own, 0xD1342543DE82EF95) >> 32) if own else 0)
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    at, shares = 0, []
    for used in imatch.SUBSETS:
        pairs = [(x, y) for x, y in zip(a[at : at + used], b[at : at + used]) if x or y]
        at += used
        shares.append((len(pairs), sum(x == y for x, y in pairs)))
    shares.reverse()  # smallest share first
    n, same = next((s for s in shares if s[0] >= 8), max(shares, key=lambda s: s[0]))
    return same / n if n else 0.0


def texts():
    rng = np.random.default_rng(7)
    vocabulary = [f"Wörd{i}" if i % 9 == 0 else f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(vocabulary, rng.integers(0, 150))) for _ in range(60)]
    return out + ["", None, " \t\n", "ein", out[3], out[3].upper(), "x" * 10_000, " ".join(rng.choice(vocabulary, 20_000)), "w1 w2 w3 İSTANBUL ΣΑΣ ΣΑΣ", "aaaa"]


@pytest.mark.parametrize(("low", "high"), [(0.0, 0.2), (0.05, 1.0), (0.9, 0.9)])
def test_fingerprints_and_likeness(spark, low, high):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n = len(rows)
    df = Counter(w for _, t in rows for w in {w.lower() for w in words_of(t)})
    band = {w for w, c in df.items() if max(2, low * n) <= c <= max(2, high * n)}
    lexicon = imatch.fit_lexicon(docs, low=low, high=high, seed=5)
    assert sorted(lexicon.terms.tolist()) == sorted(term(w) for w in band)
    want = {i: brute_fingerprint(t, band, 5) for i, t in rows}
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_texts(docs, lexicon).collect()}
    assert {i: [int(f[k : k + 8], 16) for k in range(0, len(f), 8)] for i, f in got.items()} == want
    for r in imatch.edit_report(docs, lexicon=lexicon, per_range=7).collect():
        i = r["doc_id"]
        text, following = rows[i][1] or "", rows[(i + 1) % n][1] or ""
        new = imatch.edited(text, following)
        changed = brute_fingerprint(new, band, 5)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert [int(r["edited_fingerprint"][k : k + 8], 16) for k in range(0, len(r["edited_fingerprint"]), 8)] == changed, i
        assert r["fingerprint"] == got[i]
        assert r["near_edited"] == pytest.approx(brute_likeness(want[i], changed)) and r["near_next"] == pytest.approx(brute_likeness(want[i], want[(i + 1) % n]))
        assert imatch.likeness(r["fingerprint"], r["edited_fingerprint"]) == pytest.approx(r["near_edited"])


def test_edited_texts_stay_near(spark):
    rng = np.random.default_rng(1)
    p = 1 / np.arange(1, 3001)
    rows = [(i, " ".join(f"w{x}" for x in rng.choice(3000, rng.integers(100, 800), p=p / p.sum()))) for i in range(200)]
    got = imatch.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.95
