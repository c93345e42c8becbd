"""The registered queries of the training-data operators: thin digests over the operators' general interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, context_mixing, fingerprints, langid, mixing, mixing_sql, neardup, quality, toxicity, urls
from .common import is_remainder, small_batches, table

TOXIC_AT, QUALITY_AT = 0.7, 0.3


def _predicted(at: float):
    return F.when(F.col("score") >= at, 1).otherwise(0).cast("int").alias("predicted")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = is_remainder("doc_id", 3, 1)
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", _predicted(TOXIC_AT))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = is_remainder("doc_id", 5, 0)
    model = langid.train_language_id(docs.select("doc_id", "text", "lang"), ~held)
    found = langid.identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = is_remainder("doc_id", 5, 0)
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", _predicted(QUALITY_AT))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, sf_dir, "documents"), ~is_remainder("doc_id", 7, 2))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf_dir, "documents"))


QUERIES = (op1_neardup, op2_toxicity, op3_url_filter, op4_bpe, op5_ann, op6_language, op7_quality, op8_lm_score, op9_mix, op10_fingerprints)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: lambda spark, sf_dir, f=f: f(small_batches(spark), sf_dir) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": urls.filter_sql(), "op9_mix": mixing_sql.mix_sql()}
