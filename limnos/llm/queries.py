"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, imatch, language, lines, media, mixing, quality, simhash, spelling, substrings, suffix_index, toxicity, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the package that holds it is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as stored image bytes, read back, with their features. Null and empty texts: 64 zero bytes."""
    return media.text_media(_table(spark, sf_dir, "documents"), tiles=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from documents whose crc32(doc_id) mod 3 is not 1. Null texts and texts without a letter: und, 0."""
    return language.language_report(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text, and their likenesses. Null texts are empty ones."""
    return imatch.edit_report(_table(spark, sf_dir, "documents"))


def op4_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and the components over those within four bits. Texts without words: fingerprint zero, linked like others."""
    return simhash.near_report(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every whole text, and how many of them lie in runs of two or more that occur earlier. A null text has one empty line."""
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labels whose crc32(doc_id) mod 4 is not 2. Null and empty texts hold no clause."""
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from labels whose crc32(doc_id) mod 4 is not 2. Null and empty texts count as texts without words."""
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding. Null texts are empty ones."""
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text, and those that windows of 13 words of smaller ids take away. A null text has no words."""
    return substrings.cut_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document. A null source is a source; null texts have size 0."""
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all whole texts with their near words, the form that each is a variant of, and the root of its forms. Null texts have no words."""
    return spelling.spelling_report(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text, and those in 200 bytes that also start anywhere else. A null text is an empty one."""
    return suffix_index.remove_repeats(_table(spark, sf_dir, "documents"), keep=False)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector without null or non-finite components, their errors, and the sums of errors by label."""
    return vectors.code_report(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_language_id, op3_imatch, op4_simhash_near, op5_line_dedup, op6_toxicity, op7_quality, op8_bpe, op9_substring_dedup, op10_mixing, op11_spelling_variants, op12_suffix_dedup, op13_vector_codes)}

_LINES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
p AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM d),
w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS then_ FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, then_ ORDER BY doc_id, i) AS r FROM w WHERE then_ IS NOT NULL),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM f, (VALUES (0), (1)) v(k) WHERE r > 1),
s AS (SELECT p.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(p.line, chr(10) ORDER BY p.i) FILTER (g.i IS NULL), '') AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM s
"""

_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS win,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM x WHERE n = 13),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM m, range(13) r(k) WHERE low < doc_id),
s AS (SELECT p.doc_id, count(c.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

_SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT doc_id, h, n, row_number() OVER () AS k FROM d),
q AS (SELECT k, n, f, h[2 * f + 1 : 2 * f + 1422] AS h FROM (SELECT k, h, n, unnest(range(0, n, 512)) AS f FROM k)),
p AS (SELECT k, n, f, h, unnest(range(least(512, n - f))) AS o FROM q),
w AS (SELECT k, f + o AS i, n, h[2 * o + 1 : 2 * o + 2] AS byte, CASE WHEN f + o + 200 <= n THEN md5(h[2 * o + 1 : 2 * o + 400]) END AS win FROM p),
c AS (SELECT k, i, byte, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS starts FROM w),
g AS (SELECT k, i, byte, coalesce(max(CASE WHEN starts THEN i END) OVER (PARTITION BY k ORDER BY i) > i - 200, false) AS gone FROM c),
b AS (SELECT k, i, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY k ORDER BY i), false) AS head FROM g),
s AS (SELECT k, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM b GROUP BY k)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM k LEFT JOIN s USING (k)
"""


def _vector_sql(parts: int = vectors.PARTS, entries: int = vectors.ENTRIES, rounds: int = vectors.ROUNDS, scale: int = vectors.SCALE) -> str:
    """Every round is two steps: assign parts to entries, average by entry."""
    steps = [f"""
WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, label, p, list_transform(range(w), lambda d: cast(floor(cast(v[p * w + d + 1] AS double) * {scale}) AS bigint)) AS c
      FROM (SELECT vec_id, label, v, len(v) // {parts} AS w, unnest(range({parts})) AS p FROM kept)),
b0 AS (SELECT p, e, c FROM (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM x) WHERE e < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT vec_id, label, p, c, min(struct_pack(d := d, e := e)) AS m
      FROM (SELECT x.vec_id, x.label, x.p, x.c, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d FROM x JOIN b{k} b ON x.p = b.p) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT p, e, list(floor(s / n)::bigint ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, sum(c[i]) AS s, count(*) AS n FROM (SELECT p, m, c, unnest(range(1, len(c) + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)""")
    return ",".join(steps) + f""",
r AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::bigint AS error FROM a{rounds} GROUP BY ALL),
l AS (SELECT label, sum(error)::bigint AS label_error FROM r GROUP BY label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM r JOIN l ON r.label IS NOT DISTINCT FROM l.label, h
"""


ORACLES = {"op12_suffix_dedup": _SUFFIXES, "op13_vector_codes": _vector_sql(), "op5_line_dedup": _LINES, "op9_substring_dedup": _SUBSTRINGS}
