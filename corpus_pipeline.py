"""From raw documents to token ids: toxicity, quality, near-duplicates, source mix, byte-pair encoding.

Every stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept; its result is
written as Parquet and read again as the docs of the next.  All but the last return the columns of documents.
Learned stages read their labels from ``labels`` in ``sf_dir`` and their texts from the docs they are given, and
leave out the held-out folds of the matching queries.  Rows without a text are judged by the two classifiers as
empty texts, form no groups, and are dropped by the mix, which takes words.  Rows without an id are judged as all
others; of equal rows the near-duplicate stage keeps one, which of ties is told there.  Further columns, whatever
their names, go through every stage but the last unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import bpe, mixing, neardup, quality, toxicity
from gridmill.llm.common import free_name, is_remainder, small_batches, stored, table

TOXIC_AT, QUALITY_AT = 0.7, 0.3


def scored_rows(docs: DataFrame, model, scores, keep) -> DataFrame:
    """Rows of ``docs`` whose score ``keep`` wants."""
    name = free_name(docs, "score")
    return toxicity.scored(docs, model, scores, name).where(keep(F.col(name))).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below TOXIC_AT."""
    model = toxicity.train_toxicity(docs, table(small_batches(spark), sf_dir, "labels"), ~is_remainder("doc_id", 3, 1))
    return scored_rows(docs, model, toxicity.flat_scores, lambda score: score < TOXIC_AT)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least QUALITY_AT."""
    model = quality.train_quality(docs, table(small_batches(spark), sf_dir, "labels"), ~is_remainder("doc_id", 5, 0))
    return scored_rows(docs, model, lambda m, texts: m.scores(texts), lambda score: score >= QUALITY_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id."""
    small_batches(spark)
    return neardup.without_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often, and in such parts, as the source mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every row."""
    small_batches(spark)
    found = bpe.bpe_encode(docs)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix),
    ("encode", encode),
]

#: Models are trained and texts are tokenised: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(small_batches(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
