from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealith.llm.merkle import manifest
from arealith.sources.tables import table

_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))
#: CRC-32 of the decimal id, a character and then a bit at a time.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

SQL = f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, * FROM (
    SELECT doc_id, lang, sha256({_FIELDS.replace("{n}", "n_chars")}) AS leaf,
           CASE WHEN {_CRC} % 7 = 0 THEN sha256({_FIELDS.replace("{n}", "(n_chars + 1)")}) END AS tampered FROM documents)
), t AS (
  SELECT lang, 0 AS level, idx, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, idx // 2, n
), s AS (SELECT lang, d AS subroot FROM t WHERE n = 1), u AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, subroot AS d, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, idx // 2, n
), named AS (SELECT s.*, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS up FROM s), p AS (
  SELECT l.lang, l.idx, coalesce(string_agg(t.d, '' ORDER BY t.level), '') AS proof,
         list({{'d': t.d, 'right': (l.idx >> x.level::BIGINT) & 1}} ORDER BY x.level) AS way
  FROM l JOIN (SELECT DISTINCT lang, level FROM t WHERE n > 1) x ON l.lang IS NOT DISTINCT FROM x.lang
  LEFT JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.level = x.level AND t.idx = xor(l.idx >> x.level::BIGINT, 1) GROUP BY l.lang, l.idx
), q AS (
  SELECT m.up, coalesce(string_agg(u.d, '' ORDER BY u.level), '') AS proof, list({{'d': u.d, 'right': (m.up >> x.level::BIGINT) & 1}} ORDER BY x.level) AS way
  FROM named m CROSS JOIN (SELECT DISTINCT level FROM u WHERE n > 1) x LEFT JOIN u ON u.level = x.level AND u.idx = xor(m.up >> x.level::BIGINT, 1) GROUP BY m.up
), joined AS (
  SELECT l.doc_id, l.leaf, m.subroot, (SELECT d FROM u WHERE n = 1) AS root, coalesce(p.proof, '') || coalesce(q.proof, '') AS proof,
         list_concat([{{'d': coalesce(l.tampered, l.leaf), 'right': 0::BIGINT}}], coalesce(p.way, []), coalesce(q.way, [])) AS way
  FROM l JOIN named m ON l.lang IS NOT DISTINCT FROM m.lang LEFT JOIN p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx LEFT JOIN q ON q.up = m.up
), f AS (
  SELECT *, list_reduce(way, lambda a, b: {{'d': sha256(CASE WHEN b."right" = 1 THEN coalesce(b.d, '') || a.d ELSE a.d || coalesce(b.d, '') END), 'right': 0::BIGINT}}).d AS folded_root FROM joined
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
