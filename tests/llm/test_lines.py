"""The suffix array of lines against sorted suffixes, frequent lines by broadcast, tables that end with their job."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.llm import lines
from limnos.llm.common import Scratch, shared_dir

from .test_ops import brute_lines


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    blocks = [[f"b{rng.integers(0, 40)}" for _ in range(rng.integers(1, 12))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.integers(0, 6)):
            text += blocks[rng.integers(0, 8)] if rng.random() < 0.6 else [""] * rng.integers(1, 5) if rng.random() < 0.5 else [f"x{rng.integers(0, 1000)}"]
        rows.append((i, "\n".join(text)))
    return rows + [(n, None), (n + 1, rows[3][1]), (n + 2, rows[3][1])]


@pytest.mark.parametrize("heavy", [1000, 3])
def test_suffix_array(spark, monkeypatch, heavy):
    monkeypatch.setattr(lines, "_HEAVY_COPIES", heavy)
    docs = spark.createDataFrame(corpus(1), "doc_id long, text string").repartition(4)
    with Scratch(spark, "test") as tables:
        placed = tables.write(lines.line_ids(docs, "doc_id", "text", tables), "placed")
        suffixes = []
        for r in placed.collect():
            ids = [(x["h"], x["g"]) for x in r["ids"]]
            suffixes += [(ids[k:], r["first"] + k) for k in range(len(ids))]
        suffixes.sort()
        want = []
        for k, (s, place) in enumerate(suffixes):
            lcp = 0
            if k:
                while lcp < min(len(s), len(suffixes[k - 1][0])) and s[lcp] == suffixes[k - 1][0][lcp]:
                    lcp += 1
            want.append((k, place, lcp))
        got = sorted((r["rank"], r["place"], r["lcp"]) for r in lines.suffix_array(placed, tables).collect())
    assert got == want


@pytest.mark.parametrize(("seed", "least", "heavy"), [(2, 2, 1000), (3, 2, 3), (4, 3, 3), (5, 5, 1000)])
def test_deleted_lines(spark, monkeypatch, seed, least, heavy):
    monkeypatch.setattr(lines, "_HEAVY_COPIES", heavy)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["text"] or "") for r in lines.dedup_lines(docs, least=least).collect())
    assert got == brute_lines(rows, least)


def test_tables_end_with_their_job(spark):
    top = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    lines.line_report(spark.createDataFrame(corpus(6, 10), "doc_id long, text string")).collect()
    assert [x.split("-")[1] for x in set(os.listdir(top)) - before] == ["lost"]


def test_lines_that_share_chained_hashes(spark):
    """Both lines have the same xxhash64, and so the same xxhash64 with more columns behind them."""
    pair = ["qxejicphfxhibyrtcwtfhpiuamhzmxkxwcmjzonszatomrdwevoosnocmfnlxxaq", "plxiwpnafxhibyrtcwtfhpiuamhzmxkxB>@X$,=2zatomrdwevoosnocmfnlxxaq"]
    docs = spark.createDataFrame([(k, f"{x}\nsecond line") for k, x in enumerate(pair)], "doc_id long, text string")
    assert docs.select(F.xxhash64(F.split("text", "\n")[0])).distinct().count() == 1
    assert sorted((r["n_lines"], r["n_removed"]) for r in lines.line_report(docs).collect()) == [(2, 0), (2, 0)]
