from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.pieces import digests, tokenized
from arealith.sources.tables import table


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(tokenized(table(spark, sf_dir, "documents"), model_path()))
