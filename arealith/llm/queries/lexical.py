from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.lexical import lexical_search
from arealith.sources.tables import table

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

SQL = f"""
WITH o AS (SELECT doc_id, {_TERMS} AS term FROM documents),
d AS (SELECT doc_id, term, count(*) AS tf FROM o GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM d GROUP BY ALL), s),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM len, s),
i AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
r AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN d USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 10
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
