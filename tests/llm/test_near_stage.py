"""The pipeline's near-dedup stage: SimHash, and an exact search after it."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from limnos.llm import bpe, common, mixing, shingles, simhash
from limnos.llm.queries import vocabulary


def test_simhash_and_the_exact_search_both_drop(spark, monkeypatch):
    """F8: the stage took no fingerprints. Two texts within four bits whose shingles are unlike fall by SimHash; two beyond four bits whose shingles are alike fall by the exact search."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    base = " ".join(rng.choice(words) for _ in range(400)).split()
    far = list(base)
    for i in range(20, 400, 48):
        far[i] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(far)), (3, " ".join(rng.choice(words) for _ in range(300)))]
    # a shingle so frequent that it decides every bit: four-word hashes agree, most five-word sets do not
    loud = ["la"] * 60
    rows += [(k, " ".join(loud + [rng.choice(words) for _ in range(30)])) for k in (10, 11)]
    prints = {k: simhash.simhash(t) for k, t in rows}
    bits = lambda a, b: bin(prints[a] ^ prints[b]).count("1")
    assert bits(10, 11) <= 4 < bits(1, 2)
    alike = lambda a, b: shingles._similar(shingles.shingle_set(dict(rows)[a]), shingles.shingle_set(dict(rows)[b]), 0.8)
    assert alike(1, 2) and not alike(10, 11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == [1, 3, 10]


def test_prefixes_travel_packed(spark):
    """The check of the pipeline: a row for every shingle of a prefix, twice over, took more disk than the texts. What meets is what a plain join finds; no row is made of the rest."""
    rng = np.random.default_rng(4)
    rows = [(c, 300, [int(t) for t in rng.permutation(np.unique(rng.integers(0, 3000, rng.integers(0, 60))) * 0x9E3779B97F4A7 - 2**61)]) for c in range(150)]
    often = np.unique(np.concatenate([r[2][:1] for r in rows if r[2]])).astype(np.int64)
    holders = {}
    for c, _, p in rows:
        for t in p:
            holders.setdefault(t, set()).add(c)
    frequent = set(often.tolist())
    want = sorted((t, c, n, at) for c, n, p in rows for at, t in enumerate(p) if len(holders[t]) > 1 or t in frequent)
    classes = spark.createDataFrame(rows, "c long, n int, p array<long>").repartition(5)
    assert sorted(map(tuple, shingles.met_prefixes(classes, often).collect())) == want
    none = np.zeros(0, np.int64)
    assert sorted(map(tuple, shingles.met_prefixes(classes, none).collect())) == [r for r in want if len(holders[r[0]]) > 1]
    assert shingles.met_prefixes(classes.limit(0), none).count() == 0


def test_texts_are_shuffled_once(spark):
    """The check of the pipeline: the join with the documents that stay and the search for equal rows each shuffled all texts."""
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d"), (None, "c d"), (2, "a b")], "doc_id long, text string")
    named = spark.createDataFrame([(1, (False, 1, "a b")), (1, (False, 2, "a b")), (2, (True, None, "c d"))], "root long, first struct<late: boolean, id: long, own: string>")
    named = named.select("root", named["first"].withField("own", simhash.F.xxhash64("first.own")).alias("first"))
    kept = simhash.keep_firsts(docs, named.hint("merge"), "doc_id", "text")
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.distinct().where("doc_id IS NULL OR doc_id = 1").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = simhash.keep_firsts(docs, named, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) <= 3, plan  # the texts, and the names twice


def test_a_worker_holds_a_piece_of_a_batch():
    """The check of the pipeline: a batch of 10,000 texts became Python values at once, and workers kept that memory. Pieces are all rows, in order, of about PIECE bytes."""
    batch = pa.RecordBatch.from_pydict({"n": pa.array(range(3000)), "text": pa.array(["x" * 2000] * 3000)})
    got = list(common.pieces(iter([batch, batch.slice(0, 0), batch.slice(7, 1)])))
    assert [x for p in got for x in p.column("n").to_pylist()] == [*range(3000), 7]
    assert len(got) > 5 and max(p.nbytes for p in got) < 1.01 * common.PIECE


def test_verifying_takes_one_worker_a_task(spark, monkeypatch):
    """The check of the pipeline: texts were picked by one Python step and made sets by another; with a broadcast between, each task held two workers."""
    seen = []
    real = common.Scratch.write
    monkeypatch.setattr(common.Scratch, "write", lambda self, df, name, codec="snappy": (seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())), real(self, df, name, codec))[1])
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (None, text + " other"), (4, "alone")], "doc_id long, text string")
    assert [r["doc_id"] for r in shingles.drop_similar(docs).orderBy("doc_id").collect()] == [1, 4]
    plans = [p for name, p in seen if name == "sets"]
    assert plans and all(p.count("MapInArrow") == 1 for p in plans)


def test_encoder_with_little_memory():
    """The check of the pipeline: encoders held 200,000 words and chunks, decoded texts too. With room for five the ids are the same, and no more are held."""
    texts = [" ".join(f"Word{i % 7}x{i}, été {i}. plain" for i in range(k, k + 9)) for k in range(6)]
    path = vocabulary("word_bpe_49k.json")
    small, large = bpe.WordBpe(path, 5), bpe.WordBpe(path)
    assert [small.encode(t) for t in texts] == [large.encode(t) for t in texts]
    assert max(len(small.words), len(small.chunks)) <= 5


def test_tables_of_the_driver_start_no_workers(spark):
    """The check of the pipeline: the mixing stage's table of sources, made from a list, left a second daemon and two workers on each executor."""
    table = mixing._table(spark, [(1, None), (2, 7)], "a int, b long")
    assert sorted(map(tuple, table.collect()), key=str) == [(1, None), (2, 7)] and table.dtypes == [("a", "int"), ("b", "bigint")]
    assert mixing._table(spark, [], "a int, b long").count() == 0
    assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString() or "Python" not in table._jdf.queryExecution().toRdd().toDebugString()
