"""Registered queries of the operators over the given tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hard_negatives, jaccard_join, kneser_ney, licenses, line_frequency, materialise, minmax_dedup, packing, phrases, suffix_dedup, token_counts, url_filters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, sf_dir, "documents"))


def op3_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.stored(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", *line_frequency.FIELDS, "base_failed", "removed_words", "kept")


# The rules of the url filter.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filters.judge(pages, URL_RULES, pages, "html")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_budget(counts, 4096)


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.scored(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder tree by source and id, in which every fiftieth file is named LICENSE."""
    name = F.when(F.col("doc_id") % 50 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.col("doc_id") % 97, F.col("doc_id") % 7, name)
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 get the next label first, as hard cases."""
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_materialise": op3_materialise,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_frequency": op5_line_frequency,
    "op6_url_filters": op6_url_filters,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_licenses": op10_licenses,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_minmax_dedup": op12_minmax_dedup,
    "op13_phrases": op13_phrases,
}

SQL: dict[str, str] = {
    "op5_line_frequency": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rn, generate_subscripts(ws, 1) AS p, unnest(ws) AS word
  FROM (SELECT rn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
), wc AS (
  SELECT rn, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rn
), g AS (
  SELECT rn, p, string_agg(word, ' ') OVER (PARTITION BY rn ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram,
         count(*) OVER (PARTITION BY rn ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS size
  FROM w
), tw AS (
  SELECT rn, p FROM (SELECT rn, p, count(*) OVER (PARTITION BY rn, gram) AS c FROM g WHERE size = 8) WHERE c > 1
), rep AS (
  SELECT rn, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT rn, unnest(generate_series(p, p + 7)) AS q FROM tw) GROUP BY rn
), l AS (
  SELECT rn, host, text, line, ws, len(ws) AS words,
         array_to_string(list_transform(ws, lambda x: regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g')), ' ') AS norm
  FROM (SELECT rn, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws
        FROM (SELECT rn, host, text, unnest(string_split(text, chr(10))) AS line FROM d))
  WHERE len(ws) > 0
), dup AS (
  SELECT rn, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rn
), freq AS (
  SELECT c.host, c.norm FROM
    (SELECT host, norm, count(DISTINCT text) AS n FROM l GROUP BY host, norm) c
    JOIN (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host) t ON c.host IS NOT DISTINCT FROM t.host
  WHERE c.n > greatest(20, 0.002 * t.texts)
), rem AS (
  SELECT l.rn, sum(l.words) AS removed_words FROM l JOIN freq f ON l.host IS NOT DISTINCT FROM f.host AND l.norm = f.norm
  GROUP BY l.rn
), base AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN wc USING (rn) LEFT JOIN rep USING (rn) LEFT JOIN dup USING (rn) LEFT JOIN rem USING (rn)
)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(removed_words AS BIGINT) AS removed_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 10
         AND n_words - removed_words >= 0.3 * n_words AS kept
FROM base
""",    "op11_hard_negatives": r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.rn, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rn <> b.rn WHERE a.vec_id % 100 = 0
), good AS (
  SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) <= 5
)
SELECT g.anchor_id, g.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY g.rn, g.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, g.score AS positive_score, n.score AS negative_score
FROM good g JOIN s n ON n.rn = g.rn AND NOT n.alike AND 80 * g.score <= 100 * n.score AND 100 * n.score <= 100 * g.score
QUALIFY row_number() OVER (PARTITION BY g.rn, g.vec_id ORDER BY n.score DESC, n.vec_id) <= 5
""",
    "op12_minmax_dedup": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT rn, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] END AS shingle
  FROM (SELECT rn, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS p FROM d WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT rn, count(*) AS n FROM s GROUP BY rn
), links AS MATERIALIZED (
  SELECT c.u, c.v FROM (SELECT a.rn AS u, b.rn AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.rn <> b.rn GROUP BY 1, 2) c
  JOIN n x ON x.rn = c.u JOIN n y ON y.rn = c.v
  WHERE 100 * c.c >= 85 * (x.n + y.n - c.c)
), reach AS (
  SELECT rn AS a, rn AS b FROM d
  UNION
  SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u
), low AS (
  SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.rn = reach.b GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.component_id, d.doc_id IS NOT DISTINCT FROM low.component_id AS kept
FROM d LEFT JOIN n USING (rn) JOIN low ON low.a = d.rn
""",    "op13_phrases": r"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS piece, lang, ws FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
      SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents))
  WHERE len(ws) > 0
), n AS (
  SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang
), g AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(ws[q:q + m - 1], ' ') AS phrase FROM (
      SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS q
      FROM p, (SELECT unnest(generate_series(1, 5)) AS m) WHERE len(ws) >= m))
  GROUP BY lang, m, phrase HAVING count(*) >= 100
), cut AS (
  SELECT lang, m, phrase, f, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM (
    SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w, unnest(generate_series(1, m - 1)) AS k FROM g WHERE m > 1)
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, n.n,
         (1000::HUGEINT * c.f * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM cut c JOIN g x ON x.lang = c.lang AND x.phrase = c.head JOIN g y ON y.lang = c.lang AND y.phrase = c.tail JOIN n ON n.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM g WHERE g.lang = s.lang AND g.m > s.m AND 100 * g.f >= 100 * s.a AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
""",
}
