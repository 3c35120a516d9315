"""The thin queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .decontamination import contamination_report, decontaminate
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives, quantised
from .language import fit_languages, predict_languages
from .line_dedup import line_report
from .mixing import Mix
from .packing import pack
from .simhash import simhash_dedup
from .substring_dedup import substring_dedup
from .token_counts import line_token_counts
from .token_files import read_token_files, write_token_files
from .url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


#: Fixed rules of op2.
ALLOW = ["example.com/en/7", "net/de/"]
BLOCK = ["com/en/", "example.net/de/8", "org/es/"]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(_table(spark, sf_dir, "pages"), ALLOW, BLOCK)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = predict_languages(docs, fit_languages(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), limit=1024)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, n_sections (lines) and section_tokens, the tokens that begin
    in each line, in order; they add up to n_tokens."""
    counts = line_token_counts(_table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "section_tokens")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repeated passage: words [start, end) of doc_id repeat words [start0, end0) of doc0, its
    first occurrence, with that share of equal words."""
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "doc0", "start0", "end0", F.round("similarity", 6).alias("similarity"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (not blank), n_deleted, deleted (line numbers from 0, comma-joined):
    every line that occurred before, whatever its neighbours."""
    found = line_report(_table(spark, sf_dir, "documents"), run=1, window=4, short=True)
    return found.select("doc_id", "n_lines", "n_deleted", F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).report()


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    plain = pick(vectors, "vec_id", "label", "embedding").withColumn("label", label)
    return hard_negatives(quantised(plain), F.col("vec_id") % 50 == 0)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (
    SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, g.k, item_id FROM grams g JOIN windows USING (k, gram)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


OP9_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM s),
k AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) > 1 AS gone
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted,
         string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (gone) AS deleted
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(deleted, '') AS deleted
FROM documents d LEFT JOIN g USING (doc_id)
"""

OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id AS id,
         CAST(list_sum(list_transform(list_zip(a.q, v.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM a, v WHERE a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 3
"""


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_url_filter": op2_url_filter,
        "op3_packing": op3_packing,
        "op4_simhash": op4_simhash,
        "op5_token_files": op5_token_files,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_language_id": op8_language_id,
        "op9_line_dedup": op9_line_dedup,
        "op10_token_counts": op10_token_counts,
        "op11_mixing": op11_mixing,
        "op12_hard_negatives": op12_hard_negatives,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op6_exact_dedup": OP6_SQL,
        "op9_line_dedup": OP9_SQL,
        "op12_hard_negatives": OP12_SQL,
    }
