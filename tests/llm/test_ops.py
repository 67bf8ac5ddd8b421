"""The text operators against brute force on small fixtures with nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import struct

import numpy as np
import pytest
import xxhash

from limnos.llm import bpe, imatch, language, lines, media, mixing, quality, simhash, substrings, toxicity
from limnos.llm.common import isotonic, words_of
from limnos.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, name string, place int, k int"


def long_text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


TEXTS = [
    (3, "a b\nc d\ne f"), (1, "x\na b\nc d\ny"), (2, "a b\nc d\ne f"), (4, None), (5, ""), (6, "q\nq\nq\nq"), (6, "q\nq\nq\nq"), (None, "a b\nc d"), (7, "  \t\n "),
    (8, long_text(1, 60)), (9, long_text(2, 20) + " " + " ".join(long_text(1, 60).split()[10:40])), (10, long_text(1, 60)), (11, "be " * 40), (12, "be " * 30), (13, long_text(5, 3000)), (14, long_text(5, 3000) + " tail"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 3 else "s", len(t or ""), 1, "n", 2, 3) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media(docs, none):
    rows = media.text_media(docs).collect()
    assert len(rows) == len(TEXTS) and media.text_media(none).count() == 0
    for r in rows:
        px = media.decode(r["media"])
        assert hashlib.sha256(px.tobytes()).hexdigest() == r["payload_sha256"] and px.size % 64 == 0 and px.tobytes()[: r["n_bytes"]].rstrip(b"\0") == px.tobytes().rstrip(b"\0")


def test_media_formats():
    px = np.random.default_rng(0).integers(0, 256, (7, 13)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(px)) == px).all() and (media.decode(media.encode_pgm(px)) == px).all()
    assert media.decode(b"P1\n# c\n2 1\n1 0\n").tolist() == [[0, 255]] and media.decode(b"P3 1 1 255 1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert np.allclose(media.area_resize(px, 1, 1), px.mean()) and np.allclose(media.area_resize(np.kron(px, np.ones((2, 2))), 7, 13), px)


def test_bpe(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    own = bpe.WordBpe(vocabulary("word_bpe_49k.json"))
    for text in [x or "" for _, x in TEXTS] + ["It's <|endoftext|> ΑΣ 12 aaaa... ﬁé", "ab" * 500]:
        e = t.encode(text, add_special_tokens=False)
        n, ids, decoded = own.encode(text)
        assert ids == struct.pack(f"<{len(e.ids)}I", *e.ids) and n == len(e.ids) and decoded.decode() == t.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode_texts(docs, vocabulary("word_bpe_49k.json")).count() == len(TEXTS)


def brute_simhash(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    got = simhash.near_classes(docs).collect()
    marks = [(i, brute_simhash(t)) for i, t in TEXTS]
    assert sorted((r["doc_id"] or -1, r["fp"] & (2**64 - 1)) for r in got) == sorted((i or -1, f) for i, f in marks)
    for r in got:
        seen, todo = set(), [r["fp"] & (2**64 - 1)]
        while todo:
            f = todo.pop()
            if f not in seen:
                seen.add(f)
                todo += [x for _, x in marks if bin(x ^ f).count("1") <= 4]
        ids = [i for i, f in marks if f in seen and i is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert simhash.near_classes(none).count() == 0
    kept = simhash.drop_near(docs).collect()
    assert len(kept) == len({r["component_id"] for r in got}) and len(kept[0]) == 9


def test_simhash_links_random(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64) for _ in range(k)]) for k in (1, 3, 4, 5)])
    fps = np.unique(near).view(np.int64)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect()}
    u = fps.view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    assert got == {tuple(sorted((int(fps[i]), int(fps[j])))) for i, j in zip(a, b)}


def test_simhash_dense_cluster(spark, monkeypatch):
    """All fingerprints within two bits of one, so that each is near to every other, beside two chains: few rows, the same components; also when a task hands on early."""
    one = np.uint64(0x0123456789ABCDEF)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    ball = np.unique(np.concatenate([[one], one ^ bits, (one ^ bits[:, None] ^ bits[None, :]).ravel()]))
    chains = np.concatenate([np.bitwise_xor.accumulate(np.concatenate([[s], bits[:12]])) for s in (np.uint64(0), ~np.uint64(0))])
    fps = np.unique(np.concatenate([ball, chains])).view(np.int64)
    u = fps.view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    want = dict(zip(*(x.tolist() for x in simhash.stars_of(fps[a], fps[b]))))
    prints = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(3)
    for pairs, held in ((500_000, 1_000_000), (1, 1)):
        monkeypatch.setattr(simhash, "_MOST_PAIRS", pairs)
        monkeypatch.setattr(simhash, "_MOST_HELD", held)
        rows = simhash.spanning_links(prints)
        assert {r["node"]: r["root"] for r in simhash.components(rows).collect() if r["node"] != r["root"]} == want
        if held > 1:
            assert rows.count() <= len(fps) * spark.sparkContext.defaultParallelism < len(a)


def test_stars_of():
    rng = np.random.default_rng(9)
    for n, m in ((0, 0), (1, 1), (50, 20), (200, 400)):
        a, b = (rng.integers(0, max(n, 1), m) for _ in range(2))
        root = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(len(root) + 1):
            for x, y in zip(a.tolist(), b.tolist()):
                root[x] = root[y] = min(root[x], root[y])
        assert dict(zip(*(x.tolist() for x in simhash.stars_of(a, b)))) == {k: v for k, v in root.items() if k != v}
    path = np.arange(5000)
    assert set(simhash.stars_of(path[1:], path[:-1])[1].tolist()) == {0}


def brute_lines(texts, least=2):
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0, k))
    seen, gone = set(), {}
    for k in order:
        ls = (texts[k][1] or "").split("\n")
        gone[k] = set()
        for i in range(len(ls) - least + 1):
            key = tuple(ls[i : i + least])
            if key in seen:
                gone[k] |= set(range(i, i + least))
            seen.add(key)
    return sorted((-1 if t[0] is None else t[0], "\n".join(x for i, x in enumerate((t[1] or "").split("\n")) if i not in gone[k])) for k, t in enumerate(texts))


@pytest.mark.parametrize("least", [2, 3])
def test_lines(docs, none, least):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in lines.dedup_lines(docs, least=least).collect())
    assert got == brute_lines(TEXTS, least)
    assert lines.dedup_lines(none).count() == 0


def test_substrings(docs, none):
    first = {}
    for i, t in TEXTS:
        w = words_of(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 63), 1 << 62 if i is None else i)
    want = []
    for i, t in TEXTS:
        w, out = words_of(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (1 << 62 if i is None else i):
                out |= set(range(k, k + 13))
        want.append((-1 if i is None else i, " ".join(x for k, x in enumerate(w) if k not in out), len(out)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["kept"], r["n_removed"]) for r in substrings.cut_repeats(docs).collect())
    assert got == sorted(want) and substrings.cut_repeats(none).count() == 0


def test_imatch(docs):
    rows = imatch.edit_report(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    ids = [(i, t or "") for i, t in TEXTS if i in (8, 9)]
    want = hashlib.sha256(imatch.edited(ids[0][1], ids[1][1]).encode()).hexdigest()
    assert [r["edited_sha256"] for r in rows if r["doc_id"] == 8] == [want]
    by = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert by[8] == by[10] and imatch.likeness(by[8], by[10]) == 1.0


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(TEXTS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in rows) == sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix_sources(docs).collect())
    assert sum(r["copies"] for r in rows) == mixing.take_mix(docs).count() and mixing.mix_sources(none).count() == 0


def test_targets():
    assert mixing.source_targets([("a", 100), ("b", 100), (None, 800)]) == [("a", 100, 200.0), ("b", 100, 200.0), (None, 800, 1100.0)]


def test_language(spark):
    p = language.Pieces(["▁", "a", "b", "ab", "ba", "▁a"])
    prob = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [0.2]])
    m = language.LanguageModel(p.pieces, ["x"], np.zeros(1), prob)
    ways = lambda s: 1.0 if not s else sum(prob[p.pieces.index(s[:k]), 0] * ways(s[k:]) for k in range(1, min(2, len(s)) + 1) if s[:k] in p.pieces)
    assert np.exp(m.word_scores(p, ["▁abba", "▁ab"]))[:, 0] == pytest.approx([ways("▁abba"), ways("▁ab")])
    rows = [(k, t, g) for k, (t, g) in enumerate([("the cat is here", "en"), ("die katze ist hier", "de")] * 30)] + [(98, None, "en"), (99, "123 ...", None)]
    got = {r["doc_id"]: r for r in language.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary("piece_bpe_32k.model")).collect()}
    assert all(got[k]["lang_pred"] == g for k, _, g in rows[:60]) and got[98]["lang_pred"] == got[99]["lang_pred"] == "und"


def test_classifiers(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(k, (long_text(k, 40) + (" you are an idiotic loser." if k % 3 == 0 else ".")) if k % 2 else "SPAM!! " * 30) for k in range(300)]
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    y = spark.createDataFrame([(k, k % 2, int(k % 2 == 1 and k % 3 == 0)) for k in range(300)] + [(5, None, None)], "doc_id long, quality int, toxic int")
    q = [r for r in quality.quality_report(d, y).collect() if r["doc_id"] < 300]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in q if r["held_out"]]) > 0.9
    t = [r for r in toxicity.toxicity_report(d, y).collect() if r["doc_id"] < 300]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 6 == 3) for r in t if r["held_out"]]) > 0.9
    assert quality.quality_report(docs.select("doc_id", "text"), y.where("false")).count() == len(TEXTS)
    assert rng is not None and isotonic(np.array([1.0, 0, 2]), np.array([1.0, 1, 2])).tolist() == [0.5, 0.5, 1.0]


def test_grammar_weakens_negation_and_reports():
    f = toxicity.ToxicModel({"idiot": 1.0}, np.zeros(400)).scorer()
    assert f("you idiot.") > f("idiot.") > f("not an idiot.") > 0 and f("He said idiot.") < f("He idiot.") and f("") == f(None) == 0
