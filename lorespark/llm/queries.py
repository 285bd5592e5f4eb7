"""The operators applied to the driver tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstok, decontam, htmlmain, langid, mixing, neardup_text, neardup_vec, quality, resample, secrets, substrings, tokenbin, toxicity
from .common import remainder, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_report(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vec.link_vectors(table(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_text.classes(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = htmlmain.extract(pages.select("page_id", "url", "html"), htmlmain.fit(pages))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 4) != 2)
    scored = quality.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.alignment_report(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_report(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OPERATORS = (
    op1_mixing, op2_token_binary, op3_embedding_near_dedup, op4_secret_scan, op5_toxicity, op6_decontamination, op7_language_id,
    op8_minhash_near_dedup, op9_html_extraction, op10_quality, op11_token_alignment, op12_substring_dedup, op13_importance_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
weighed AS (
  SELECT *, CAST([5, 2, 1][CAST(rank % 3 + 1 AS INT)] AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM ranked),
levels AS (
  SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () AS all_words,
         coalesce(sum(cap) OVER below, 0) AS cap_below,
         sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS weight_left
  FROM weighed
  WINDOW below AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap <= (all_words - cap_below) / weight_left * weight AS full_up FROM levels),
goals AS (
  SELECT source, source_size, rank,
         CASE WHEN full_up THEN cap ELSE (all_words - coalesce(sum(CASE WHEN full_up THEN cap END) OVER (), 0))
           / nullif(sum(weight) OVER () - coalesce(sum(CASE WHEN full_up THEN weight END) OVER (), 0), 0) * weight END AS target
  FROM capped),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.rank, CAST(floor(g.target) AS BIGINT) AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS UNBOUNDED PRECEDING) - s.size AS begin
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
taken AS (
  SELECT *, CAST(greatest(0, least(size, budget - begin)) AS BIGINT) AS first_take,
         CAST(greatest(0, least(size, budget - begin)) + greatest(0, least(size, budget - begin - source_size))
              + greatest(0, least(size, budget - begin - 2 * source_size)) AS BIGINT) AS taken
  FROM placed),
shares AS (SELECT *, CASE WHEN first_take > 0 THEN (begin + first_take / 2) / target END AS u FROM taken)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
       round(CASE rank % 3
         WHEN 0 THEN 2 * u / (1.5 + sqrt(greatest(2.25 - 2 * u, 0)))
         WHEN 1 THEN u
         ELSE CASE WHEN u < 0.3125
           THEN 2 * u / (0.5 + sqrt(0.25 + u))
           ELSE 0.5 + 2 * (u - 0.3125) / (0.75 + sqrt(0.5625 + 5 * (u - 0.3125))) END END, 6) AS position
FROM shares
"""


OP12_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT row, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs WHERE doc_id IS NOT NULL AND len(words) >= 50),
windows AS MATERIALIZED (SELECT row, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM starts),
owners AS (SELECT h, min(doc_id) AS owner FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
gone AS MATERIALIZED (SELECT DISTINCT row, unnest(range(i, i + 50)) AS k FROM windows JOIN owners USING (h) WHERE owner < doc_id),
removed AS (SELECT row, count(*) AS n FROM gone GROUP BY row),
spread AS (SELECT row, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS word FROM docs WHERE row IN (SELECT row FROM removed)),
kept AS (SELECT row, sha256(string_agg(word, ' ' ORDER BY k)) AS h FROM spread ANTI JOIN gone USING (row, k) GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
       CASE WHEN n IS NULL THEN sha256(array_to_string(words, ' ')) ELSE coalesce(h, sha256('')) END AS kept_sha256
FROM docs LEFT JOIN removed USING (row) LEFT JOIN kept USING (row)
"""

OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
doc_words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM docs),
target_words AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
vocabulary AS (SELECT word FROM doc_words UNION SELECT word FROM target_words),
bytes AS (SELECT word, list_transform(regexp_extract_all(hex(word), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM vocabulary),
buckets AS (
  SELECT word, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
         / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS gain
  FROM s LEFT JOIN t USING (bucket)),
sums AS (
  SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
  FROM doc_words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN sums USING (row)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r,
         count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op12_substring_dedup": OP12_SQL, "op13_importance_resampling": OP13_SQL}
