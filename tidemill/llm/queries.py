"""The corpus operators as queries over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, exact_dedup, fill_middle, id_files, lang_id, mixing, packing, quality_crf, quality_rules, secret_scan, simhash_pivot, substring_dedup, toxicity
from .common import fold, shared_root


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = fold(F.col("doc_id"), 4) == 2
    model = lang_id.train(docs.where(~held_out), lang_id.default_vocabulary())
    return lang_id.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _labelled(spark: SparkSession, sf_dir: str, label: str, parts: int, held: int) -> tuple[DataFrame, DataFrame]:
    """(id, text, lang) of the documents and (id, label) of those that may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), parts) != held)
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "lang"), labels.select(F.col("doc_id").alias("id"), F.col(label).alias("label"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(*_labelled(spark, sf_dir, "toxic", 3, 1))
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score(_documents(spark, sf_dir), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_windows(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_digest(_documents(spark, sf_dir))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = quality_crf.train(*_labelled(spark, sf_dir, "quality", 5, 0))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality_crf.score(_documents(spark, sf_dir), field).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_documents(spark, sf_dir))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivot.near_duplicates(_documents(spark, sf_dir), words_per_shingle=4)


def op11_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_root(spark)}/token-ids-{uuid.uuid4().hex}"
    id_files.write_ids(_documents(spark, sf_dir), folder)
    return id_files.read_ids(spark, folder)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(_documents(spark, sf_dir)).withColumnRenamed("groups", "groups_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_middle.restore(fill_middle.fill_in_middle(_documents(spark, sf_dir)))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


SQL_OP7 = r"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""


SQL_OP5 = r"""
WITH r AS (
  SELECT doc_id,
    CASE WHEN regexp_matches(coalesce(source, ''), '[0-9]{1,9}$')
      THEN 'domain' || (CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT) % 4) ELSE 'other' END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), l AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_docs FROM r GROUP BY ALL),
n1 AS (
  SELECT domain, sum(tokens) * 2.0::DOUBLE AS cap, (SELECT sum(tokens) FROM l) * 0.8::DOUBLE AS budget,
    CASE domain WHEN 'domain0' THEN 4.0 WHEN 'domain1' THEN 3.0 WHEN 'domain2' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM l GROUP BY domain
), s1 AS (
  SELECT *, cap * (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) <= w * (budget - coalesce(sum(cap) OVER o, 0)) AS f
  FROM n1 WINDOW o AS (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b1 AS (
  SELECT domain, CASE WHEN f THEN cap ELSE w * (budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN f THEN 0 ELSE w END) OVER () END AS budget FROM s1
), n2 AS (
  SELECT domain, lang, sum(tokens) * 2.0::DOUBLE AS cap, any_value(b1.budget) AS budget,
    CASE lang WHEN 'en' THEN 5.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM l JOIN b1 USING (domain) GROUP BY domain, lang
), s2 AS (
  SELECT *, cap * (sum(w) OVER p - coalesce(sum(w) OVER o, 0)) <= w * (budget - coalesce(sum(cap) OVER o, 0)) AS f
  FROM n2 WINDOW p AS (PARTITION BY domain), o AS (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b2 AS (
  SELECT domain, lang, CASE WHEN f THEN cap ELSE w * (budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER p) / sum(CASE WHEN f THEN 0 ELSE w END) OVER p END AS budget
  FROM s2 WINDOW p AS (PARTITION BY domain)
), n3 AS (
  SELECT domain, lang, source, sum(tokens) * 2.0::DOUBLE AS cap, any_value(b2.budget) AS budget, 1.0::DOUBLE AS w FROM l JOIN b2 USING (domain, lang) GROUP BY domain, lang, source
), s3 AS (
  SELECT *, cap * (sum(w) OVER p - coalesce(sum(w) OVER o, 0)) <= w * (budget - coalesce(sum(cap) OVER o, 0)) AS f
  FROM n3 WINDOW p AS (PARTITION BY domain, lang), o AS (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b3 AS (
  SELECT domain, lang, source,
    floor(1e-6 + CASE WHEN f THEN cap ELSE w * (budget - sum(CASE WHEN f THEN cap ELSE 0 END) OVER p) / sum(CASE WHEN f THEN 0 ELSE w END) OVER p END)::BIGINT AS budget
  FROM s3 WINDOW p AS (PARTITION BY domain, lang)
), q AS (SELECT l.*, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM l JOIN b3 USING (domain, lang, source)),
o AS (SELECT r.*, budget, whole, budget - whole * tokens AS rest, md5('17:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM r JOIN q USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget,
  (whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM o
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": SQL_OP5, "op7_exact_dedup": SQL_OP7}
