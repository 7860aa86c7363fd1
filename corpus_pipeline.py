"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``. A filter
whose classifier has no labelled row to learn from rejects nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealith.llm.mixing import mixed_documents
from arealith.llm.neardup import near_duplicates
from arealith.llm.pieces import tokenized
from arealith.llm.quality import score_quality, train_quality
from arealith.llm.queries.pieces import model_path
from arealith.llm.toxicity import score_toxicity, train_toxicity
from arealith.sources.tables import scratch, shared_dir, table


def filtered(docs: DataFrame, scored: DataFrame, stays: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs`` whose score (the last column of ``scored``) lets them stay."""
    return scored.filter(stays(F.col(scored.columns[-1]))).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    trees = train_quality(docs, table(spark, sf_dir, "labels"))
    if not trees.trained:
        return docs
    return filtered(docs, score_quality(docs, trees, [*docs.columns]), lambda score: score >= 0.7)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    if not model.trained:
        return docs
    return filtered(docs, score_toxicity(docs, model, [*docs.columns]), lambda score: score < 0.5)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; rows without an id stay.

    Of rows that repeat an id, the one whose text and columns have the least hashes stays, in every run.
    """
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    order = F.struct(F.xxhash64("text").alias("text"), F.xxhash64(*docs.columns).alias("row"))
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi")
    named = named.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return named.union(docs.filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, pass by pass."""
    return mixed_documents(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's pieces, with their number."""
    ids = tokenized(docs, model_path(), keep=("doc_id", "lang", "source"), decoded=False)
    return ids.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near duplicates", dedup), ("mix", mix), ("tokens", tokens)]

#: Learned scores and pieces have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's own tables go when it is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
