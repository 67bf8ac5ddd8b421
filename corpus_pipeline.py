"""A corpus pipeline of five stages over `documents`: quality filter, line dedup, near-dedup, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its input is what the stage before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import bpe, lines, mixing, quality, shingles, simhash
from limnos.llm.common import materialize
from limnos.llm.queries import vocabulary

#: Documents with a lower quality score go.
LEAST_QUALITY = 0.7
#: A line of so many words is a passage by itself: later copies go, whatever stands beside them.
PASSAGE_WORDS = 50
#: Words and chunks that a task of the encoder remembers: its executor is as full as the stages before left it.
REMEMBERED = 30_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score LEAST_QUALITY or more, by a classifier fitted on labels of the documents at hand. Without labels every score is 0.5, so all go; null texts are scored as texts without words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, quality.fit_quality(docs, labels), LEAST_QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    out = lines.dedup_lines(docs, words=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash first: one document stays of each group within four bits (`simhash.near_firsts`, which names it by id and hash: texts are not written for it). An exact search follows over what it left: pairs of five-word Jaccard similarity 0.8 or more, most of which lie farther than four bits from each other."""
    return shingles.drop_similar(docs, among=simhash.near_firsts(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy of a document that the mix takes: none, one or more, at most what makes twice its size. Null sources are a source; empty texts have size 0 and are drawn like others."""
    return mixing.take_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, a row for every row; null texts are empty ones."""
    return bpe.encode_texts(docs, vocabulary("word_bpe_49k.json"), keep_ids=False, remembered=REMEMBERED)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("bpe encoding", encoding_stage),
]

#: The stages learn, draw and encode: SQL cannot express them. tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table `documents`; what a stage keeps is written to the shared folder and read again. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
