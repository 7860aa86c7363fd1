from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.mixing import mix_report
from arealith.sources.tables import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
