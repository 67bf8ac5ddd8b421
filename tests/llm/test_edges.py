"""Every operator and stage on empty tables, null columns, repeated rows and columns whose names clash with its own; edited neighbours against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from limnos.llm import bpe, imatch, language, lines, media, mixing, quality, simhash, spelling, substrings, suffix_index, toxicity, vectors
from limnos.llm.queries import vocabulary

NAMES = "size copies rows n copy lists several nth spans lost_id lost_own kept_id kept_own id own fp x y bin fold part key first last range place source_no block order p whole mix_id anchor start mask".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)
BODY = "the quick brown fox jumps over the lazy dog near the river bank today"
TEXTS = [(1, BODY), (1, BODY), (2, f"{BODY}\n{BODY} again\nlast"), (3, f"head\n{BODY}\n{BODY} again\nlast"), (4, None), (None, None), (None, BODY + " tail"), (5, ""), (6, "one two"), (6, "three four"), (7, "é" * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None if k % 2 else "s", None, *[None] * len(NAMES)) for k, (i, t) in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


def operators(labels):
    pieces, words = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
    return {
        "media": media.text_media,
        "language": lambda d: language.language_report(d, pieces),
        "imatch": imatch.edit_report,
        "simhash": simhash.near_report,
        "lines": lines.line_report,
        "toxicity": lambda d: toxicity.toxicity_report(d, labels),
        "quality": lambda d: quality.quality_report(d, labels),
        "bpe": lambda d: bpe.encode_texts(d, words),
        "substrings": substrings.cut_repeats,
        "mixing": mixing.mix_report,
        "suffixes": suffix_index.remove_repeats,
    }


@pytest.mark.parametrize("name", ["media", "language", "imatch", "simhash", "lines", "toxicity", "quality", "bpe", "substrings", "mixing", "suffixes"])
def test_a_row_for_each_document(docs, labels, name):
    op = operators(labels)[name]
    assert op(docs).count() == len(TEXTS)
    assert op(docs.limit(0)).count() == 0


def test_no_labels(docs, labels):
    for report in (toxicity.toxicity_report, quality.quality_report):
        assert {r["score"] for r in report(docs, labels.limit(0)).collect()} == {0.5}


def test_stages_keep_columns(docs, spark, tmp_path):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(TEXTS)


def test_mix_deals_copies_of_repeated_ids(spark):
    rows = [(1, f"{'a' * k} b c", "s") for k in range(1, 6)] + [(2, "x y z", "s")] * 3 + [(None, "p q", None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.take_mix(d).count() == sum(r["copies"] for r in mixing.mix_sources(d).collect())


@pytest.mark.parametrize("per_range", [1, 3, 100])
def test_edited_by_the_next_in_order(spark, per_range):
    rows = [(k * 7 % 31 - 10, f"t{k} " * (k % 5 + 1)) for k in range(25)] + [(100, None), (101, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = [t or "" for _, t in sorted(rows)]
    ids = sorted(i for i, _ in rows)
    want = {i: hashlib.sha256(imatch.edited(t, texts[(k + 1) % len(texts)]).encode()).hexdigest() for k, (i, t) in enumerate(zip(ids, texts))}
    assert {r["doc_id"]: r["edited_sha256"] for r in imatch.edit_report(d, per_range=per_range).collect()} == want


def test_range_lookup(spark):
    d = spark.createDataFrame([(k,) for k in range(-3, 60)] + [(None,)], "id long")
    for n in (0, 1, 2, 7, 50):
        cuts = list(range(0, n))
        got = {r["id"]: r["r"] for r in d.withColumn("r", imatch._range_of(F.col("id"), cuts)).collect()}
        assert all(v == (n if k is None else sum(c <= k for c in cuts)) for k, v in got.items())


@pytest.mark.parametrize("name", ["language", "simhash", "lines", "toxicity", "quality", "bpe", "substrings", "mixing", "suffixes"])
def test_a_very_long_text(spark, labels, name):
    """A text of 30,000 words and 3,000 lines beside short ones: a row each, and what can be counted is."""
    long = "\n".join(" ".join(f"w{(k * 7919 + j) % 5003}" for j in range(10)) for k in range(3000))
    rows = [(1, "a short text"), (2, long), (3, long[: len(long) // 2]), (4, None)]
    got = {r["doc_id"]: r.asDict() for r in operators(labels)[name](spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert set(got) == {1, 2, 3, 4}
    if name == "substrings":
        assert got[2]["n_words"] == 30_000
    if name == "suffixes":
        assert got[2]["n_bytes"] == len(long) and got[3]["n_removed"] >= len(long) // 2 - 400
    if name == "lines":
        assert got[2]["n_lines"] == 3000 and got[3]["n_removed"] > 1400
    if name == "mixing":
        assert got[2]["size"] == 30_000 and got[2]["taken"] <= 60_000


def test_empty_tables_of_vectors_and_words(spark):
    rows = "vec_id long, embedding array<float>, label int"
    assert vectors.code_report(spark.createDataFrame([], rows)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert spelling.spelling_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_pipeline_is_its_stages(spark, tmp_path):
    """run() over a table equals the stages one by one: rejected documents, repeated lines and near copies are gone, all others are encoded as often as the mix takes them."""
    good = [f"the {a} {b} walked along the quiet river and told a long story about {c} and {d} to everyone who listened there" for k, (a, b, c, d) in enumerate((f"n{k}a", f"n{k}b", f"n{k}c", f"n{k}d") for k in range(60))]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(good)] + [(100 + k, "$$$ !!! " * 30, "en", "s0", 240) for k in range(20)]
    rows += [(200, good[0], "en", "s1", len(good[0])), (201, good[1].replace("quiet", "calm") + " " + good[1], "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows if i < 200], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
    want = sorted(map(tuple, kept.collect()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == want
    ids = [r[0] for r in got]
    assert not {i for i in ids if 100 <= i < 200} and len(set(ids)) >= 55
    assert all(r[1] == 0 for r in got if r[0] == 200)  # a copy as a whole has lost its one line
