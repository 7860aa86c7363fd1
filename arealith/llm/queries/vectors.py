from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.vectors import near_vectors
from arealith.sources.tables import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
