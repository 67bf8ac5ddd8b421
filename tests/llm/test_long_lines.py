"""Single lines that count as repeats by their words, against brute force."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from limnos.llm import lines
from limnos.llm.common import words_of

LONG = " ".join(f"w{k}" for k in range(50))
SHORT = " ".join(f"w{k}" for k in range(49))
ONE = "only line of this text"
ROWS = [
    (1, f"a\n{LONG}\nb\n{SHORT}"), (2, f"c\n{LONG}\nd\n{SHORT}\ne"), (3, ONE), (4, ONE), (5, f"x\n{ONE}\ny"), (6, None), (7, None), (8, ""), (9, " \t"), (10, " \t"),
    (11, f"p\n{SHORT}\nq"), (12, f"p\n{SHORT}\nq\n{LONG}\n{LONG}"), (None, LONG), (13, f"{LONG}\n{LONG}\nb\nz"), (14, f"q\n{LONG}"),
]


def brute(rows, least, words):
    seen, seen_lines, out = set(), set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ls, gone = (t or "").split("\n"), set()
        for at, line in enumerate(ls):
            n = len(words_of(line))
            if line in seen_lines and (n >= words or (len(ls) == 1 and n)):
                gone.add(at)
            seen_lines.add(line)
            run = tuple(ls[at : at + least])
            if len(run) == least:
                gone |= set(range(at, at + least)) if run in seen else set()
                seen.add(run)
        out.append((i or -1, t if not gone else "\n".join(x for at, x in enumerate(ls) if at not in gone)))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("least,words", [(2, 50), (3, 49)])
def test_long_single_lines(spark, least, words):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] or -1, r["text"]) for r in lines.dedup_lines(docs, least=least, words=words).collect()), key=lambda r: r[0])
    assert got == brute(ROWS, least, words)


def test_line_stage_takes_single_lines(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"a\n{LONG}\nb"), (2, f"c\n{LONG}\nd"), (3, ONE), (4, ONE)], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()}
    assert got == {1: (f"a\n{LONG}\nb", len(LONG) + 4), 2: ("c\nd", 3), 3: (ONE, len(ONE)), 4: ("", 0)}
