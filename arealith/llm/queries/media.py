from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.media import decoded_images, stored_images
from arealith.sources.tables import table


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = stored_images(table(spark, sf_dir, "documents"))
    return decoded_images(images, tensors=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
