from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.repeats import without_repeats
from arealith.sources.tables import table

#: Strings of 400 bytes as 800 hex digits, compared by their 128-bit digests.
SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
s AS (SELECT row, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT row, h, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)),
r AS (SELECT row, p FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
e AS (SELECT row, p, coalesce(p - lag(p) OVER w > 400, true) AS fresh FROM r WINDOW w AS (PARTITION BY row ORDER BY p)),
g AS (SELECT row, p, sum(fresh::INT) OVER (PARTITION BY row ORDER BY p) AS span FROM e),
x AS (SELECT row, span, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY ALL),
k AS (
  SELECT row, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS before,
         CASE WHEN lead(a) OVER w IS NULL THEN substr(h, 2 * b + 1) ELSE '' END AS behind
  FROM x JOIN d USING (row) WINDOW w AS (PARTITION BY row ORDER BY a)
), t AS (SELECT row, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(before || behind, '' ORDER BY a) AS kept FROM k GROUP BY row)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (row)
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
