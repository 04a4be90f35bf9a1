"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiframe.llm.cdc_dedup import substring_report
from kpiframe.llm.common import table
from kpiframe.llm.decontaminate import contaminated
from kpiframe.llm.exact_dedup import exact_report
from kpiframe.llm.html_extract import extract_text
from kpiframe.llm.licenses import scan_licenses
from kpiframe.llm.line_dedup import line_report
from kpiframe.llm.mixing import mix_report
from kpiframe.llm.quality import quality_rules
from kpiframe.llm.simhash import near_duplicates
from kpiframe.llm.spelling import spelling_variants, word_counts
from kpiframe.llm.suffix_dedup import suffix_report
from kpiframe.llm.toxicity import score_toxicity
from kpiframe.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's made-up misspellings: one run in 97 loses a code point
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), slip=97))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_report(table(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    """Product quantisation in plain integer arithmetic: all distances, round by round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS (
  SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS far
  FROM p JOIN b{r} b ON p.part = b.part AND p.pos = b.pos GROUP BY ALL),
a{r} AS (
  SELECT vec_id, part, min(far * {ENTRIES} + entry) % {ENTRIES} AS entry, min(far) AS far
  FROM d{r} GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""
n{r} AS (
  SELECT p.part, a.entry, p.pos, sum(p.x) AS s, count(*) AS c
  FROM p JOIN a{r} a ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY ALL),
b{r + 1} AS (
  SELECT b.part, b.entry, b.pos,
         CAST(CASE WHEN n.c IS NULL THEN b.x ELSE (n.s - ((n.s % n.c) + n.c) % n.c) // n.c END
              AS BIGINT) AS x
  FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry AND b.pos = n.pos)""")
    last = f"b{ROUNDS}", f"a{ROUNDS}"
    return f"""
WITH v AS (
  SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT vec_id, i // w AS part, i % w AS pos,
         CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * {SCALE}) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM v)),
b0 AS (
  SELECT part, entry, pos, x
  FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v) s
       ON p.vec_id = s.vec_id AND s.entry < {ENTRIES}),{",".join(steps)},
e AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code,
         CAST(sum(far) AS BIGINT) AS error
  FROM {last[1]} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS sha
          FROM {last[0]})
SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT)
       AS label_error, books.sha AS codebooks_sha256
FROM v JOIN e ON v.vec_id = e.vec_id, books
"""


REGISTRY = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_license_scan": op6_license_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_extract": op9_html_extract,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE = {
    "op12_vector_codes": _codes_sql(),
    "op13_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
g AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size,
         first_value(doc_id) OVER (PARTITION BY s ORDER BY n_chars DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
       sha256(s) AS text_sha256
FROM g
""",
    "op3_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
flagged AS (
  SELECT l.doc_id, l.i, l.line, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone
  FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
""",
    "op7_mix_sources": r"""
WITH sizes AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS slot,
         row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE slot WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CAST(source_size AS DOUBLE) * 3.0::DOUBLE AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM per_source),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY cap / w, i
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / w, i) AS rk
  FROM weighed),
targets AS (
  SELECT source, source_size, slot,
         CASE WHEN cap > level * w THEN w * (SELECT min_by(level, rk) FROM levels WHERE cap > level * w)
              ELSE cap END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.slot, t.target,
         CAST(floor(t.target + 0.5) AS BIGINT) AS demand,
         CAST(sum(s.size) OVER (PARTITION BY s.source
              ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN greatest(0, least(size, demand % source_size - start))
              ELSE 0 END AS rest
  FROM placed),
timed AS (
  SELECT *, CAST(passes * size + rest AS BIGINT) AS taken,
         CAST(start AS DOUBLE) / CAST(demand AS DOUBLE) AS u FROM taking)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken = 0 THEN NULL WHEN u <= 0 THEN 0.0::DOUBLE ELSE round(CASE slot
         WHEN 0 THEN 2.0::DOUBLE * u / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * u)))
         WHEN 1 THEN 2.0::DOUBLE * u / (1.0::DOUBLE + 1.0::DOUBLE)
         ELSE 2.0::DOUBLE * u / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * u)) END, 9) END AS position
FROM timed
""",
}
