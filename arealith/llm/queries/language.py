from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.labelled import fold
from arealith.llm.language import predict_language, train_language
from arealith.sources.tables import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language(docs)
    return predict_language(docs, model, ["doc_id"]).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
