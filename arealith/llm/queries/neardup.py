from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.neardup import near_duplicates
from arealith.sources.tables import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
