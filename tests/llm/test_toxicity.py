"""The composed grammar against a plain reading of its patterns, and what single patterns weigh."""

import random

import pytest

from limnos.llm import toxicity as t

MODEL = t.ToxicModel({"idiot": 1.0, "scum": 2.0, "fool*": 0.75}, None)


def plain(clause):
    """Each match by itself: where the taken word stands, what is before it and what comes behind."""

    def factor(i, target):
        out = 1.0
        if target and any(clause[k][0] == t.TARGET for k in range(max(0, i - 4), i)):
            out *= 1.5
        if any(clause[k][0] == t.NEGATION for k in range(max(0, i - 3), i)):
            out *= 0.3
        if any(clause[k][0] == t.REPORT for k in range(i)):
            out *= 0.5
        return out

    total = 0.0
    for i, (symbol, w) in enumerate(clause):
        if symbol == t.INSULT:
            behind = any(clause[k][0] == t.TARGET for k in range(i + 1, min(len(clause), i + 4)))
            total += w * factor(i, True) * (1.5 if behind else 1.0)
        if symbol == t.THREAT:
            ahead = any(clause[k][0] == t.TARGET for k in range(i + 1, min(len(clause), i + 5)))
            before = any(clause[k][0] == t.TARGET for k in range(max(0, i - 4), i))
            total += w * factor(i, False) * (ahead + 0.8 * before)
    return total


def test_the_product_machine_weighs_as_a_plain_reading():
    rng, grammar = random.Random(3), t.compile_grammar()
    for _ in range(3000):
        clause = [(s, rng.choice([0.5, 1.0, 2.0])) for s in rng.choices(t.SYMBOLS, k=rng.randint(0, 14))]
        assert t.clause_weight(grammar, clause) == pytest.approx(plain(clause))


def test_reported_speech_reaches_to_the_end_of_the_clause():
    f = MODEL.scorer()
    for n in (1, 20, 30, 500):
        assert f("said " + "word " * n + "idiot") == pytest.approx(0.5)
    assert f("said it. idiot") == 1.0


def test_a_threat_needs_a_target():
    f = MODEL.scorer()
    assert f("kill the process") == 0 and f("kill you") == 1.0 and f("you will burn") == pytest.approx(0.8)
    assert f("kill. you") == 0 and f("he kills time") == 0


def test_clauses_add_up():
    f = MODEL.scorer()
    assert f("idiot. you scum! not an idiot") == pytest.approx(1.0 + 3.0 + 0.3)
    assert f("scum you") == pytest.approx(3.0) and f("foolish") == 0.75 and f("") == f(None) == f(" \n") == 0


def test_all_learned_terms_stay(spark):
    """No cap on the lexicon: every term that the labelled rows teach is in it."""
    words = [f"bad{k:05d}x" for k in range(6000)]
    rows = [(i, " ".join(words) if i % 2 else "fine " * 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert set(words) <= set(t.fit_toxicity(docs, labels, odds=2.0).weight)


def test_arcs_follow_the_labels():
    """Labels drawn from a grammar with other weights: arcs that labelled paths take move towards them, others keep theirs."""
    import numpy as np

    rng = np.random.default_rng(1)
    true = (0.5, 0.8, 3.0, 0.05, 0.5, 1.0)
    sums = np.zeros((6000, 64))
    for row in sums:
        for m in rng.choice([0, t.BEHIND, t.AIMED, t.NEGATED, t.AIMED | t.NEGATED], rng.integers(0, 4)):
            row[m] += rng.choice([0.5, 1.0, 2.0])
    z = -3 + 4 * np.log1p(sums @ t.mark_weights(true))
    y = (rng.random(6000) < 1 / (1 + np.exp(-z))).astype(float)
    arcs = t.fit_arcs(sums, y)
    assert arcs[2] == pytest.approx(3.0, rel=0.25) and arcs[3] < 0.15 and arcs[1] == 0.8 and arcs[4] == 0.5 and arcs[5] == 1.0
    assert tuple(t.fit_arcs(sums[:0], y[:0])) == tuple(t.fit_arcs(sums, y * 0)) == t.PRIOR


def test_negated_insults_of_clean_documents_weaken_negation(spark):
    """Labels that call negated insults clean are followed by the fitted model."""
    rows = [(i, f"line {i} you are an idiot today") for i in range(0, 300, 2)] + [(i, f"line {i} you are not an idiot today") for i in range(1, 300, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = t.fit_toxicity(docs, spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert model.arcs[3] < t.PRIOR[3]
    score = {r["doc_id"]: r["score"] for r in t.score_toxicity(docs, model).collect()}
    assert min(score[i] for i in range(0, 300, 2)) > 0.9 > 0.1 > max(score[i] for i in range(1, 300, 2))
