from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealith.llm.labelled import fold
from arealith.llm.quality import score_quality, train_quality
from arealith.sources.tables import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, trees, ["doc_id"]).select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
