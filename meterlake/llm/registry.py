"""Queries of this subpackage for the driver, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterlake.llm import collocations, langid, licenses, lm_scoring, merkle, mixing, near_dedup, packing, quality_model, quality_rules, secrets, url_filter, vector_dedup
from meterlake.llm.words import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_model(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), carry=["doc_id"])


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    found = langid.identify(docs, docs.where(~F.col("held_out")), carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_lm_scoring, op3_quality_model, op4_license_scan, op5_mixing, op6_quality_rules, op7_vector_dedup, op8_language_id, op9_url_filter, op10_near_dedup, op11_collocations, op12_merkle_manifest, op13_secrets)}


def oracle_sql() -> dict:
    return {"op5_mixing": mixing.SQL, "op6_quality_rules": quality_rules.SQL, "op7_vector_dedup": vector_dedup.SQL, "op10_near_dedup": near_dedup.SQL, "op11_collocations": collocations.SQL, "op12_merkle_manifest": merkle.SQL}
