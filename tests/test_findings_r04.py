"""Findings of round 4: results against their SQL, and operators against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arealith.functions import columns as C
from arealith.operators import fields
from arealith.operators import spatial as S
from arealith.operators.bridges import bridges


def against_sql(spark, folder, name, *tables):
    """Rows of a query and of its SQL over the tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(map(tuple, entry.queries()[name](spark, str(folder)).collect()), key=repr), sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def shuffled(spark, work):
    """A result and the rows that were shuffled for it."""
    sc, lists = spark.sparkContext, spark._jvm.java.util.ArrayList

    def rows():
        stages = sc._jsc.sc().statusStore().stageList(lists(), False, False, sc._gateway.new_array(spark._jvm.double, 0), lists())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before, out = rows(), work()
    return out, rows() - before


def suppliers(spark, folder, n):
    rows = spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit("x").alias("s_name"), (F.col("id") % 5).cast("int").alias("s_nationkey"), F.when(F.col("id") != 17, F.expr("pmod(id * 7919, 101) / 4D")).alias("s_acctbal"))
    rows.write.parquet(f"{folder}/supplier.parquet")


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    texts = ["öin of", "in木 Über_in in", "İn the", "thß OFÄ inn"]
    rows = [(c, t, "user", x) for c in (0, 5, 8) for t, x in enumerate(texts)] + [(3, t, "user", x) for t, x in zip((2, None, 0, 1), texts, strict=True)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = against_sql(spark, tmp_path, "word_bias", "conversations")
    assert got == want and want[0][:3] == (0, 4, 10)


def test_bridges_plan_with_known_sizes(spark):
    # The size that Spark guesses for a plan is squared by each join of a table with itself; planning slows down with its digits.
    path = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = bridges(path)
    assert len(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 300
    assert {tuple(r) for r in out.collect()} == {(k, k + 1, min(k + 1, 40 - k), max(k + 1, 40 - k)) for k in range(40)}


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_ranks_dealt_by_tables(spark, n):
    keys = (F.lit(1), F.lit(7))
    want = [r.k for r in spark.range(n).select("id", C.dealt_rank(F.col("id"), F.lit(n), *keys).alias("k")).orderBy("id").collect()]
    table = spark.range(1).select(fields.round_tables(fields.rank_bits(n)[1], 6, *keys).alias("t")).first().t
    assert sorted(want) == list(range(n)) and fields.dealt(np.arange(n), n, np.array(table)).tolist() == want


def test_permutations_move_no_draws(spark, tmp_path, monkeypatch):
    suppliers(spark, tmp_path, 230)
    (got, want), rows = shuffled(spark, lambda: against_sql(spark, tmp_path, "moran_permutation", "supplier"))
    assert got == want and rows < 230 * 999
    monkeypatch.setattr(S, "BLOCK_BITS", 5)
    monkeypatch.setattr(S, "CHUNK", 300)
    monkeypatch.setattr(S, "LOOKED_UP", 4000)
    assert against_sql(spark, tmp_path, "moran_permutation", "supplier") == (got, want)


def test_local_permutations_move_no_draws(spark, tmp_path, monkeypatch):
    suppliers(spark, tmp_path, 130)
    (got, want), rows = shuffled(spark, lambda: against_sql(spark, tmp_path, "lisa_cond_perm_suppliers", "supplier"))
    lost = [r for r in got if r[1] is None]  # the area without a value
    assert got == want and len(lost) == 1 and rows < 130 * 99
    monkeypatch.setattr(S, "BLOCK_BITS", 5)
    monkeypatch.setattr(S, "LOOKED_UP", 4000)
    assert against_sql(spark, tmp_path, "lisa_cond_perm_suppliers", "supplier") == (got, want)


def test_few_others_are_all_drawn_from(spark, tmp_path):
    suppliers(spark, tmp_path, 14)  # 2 x 8 neighbours reach the 13 others
    got, want = against_sql(spark, tmp_path, "lisa_cond_perm_suppliers", "supplier")
    assert got == want and len(got) == 14


def test_band_sums_write_no_pairs(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.02, (800, 3)).astype(np.float32)  # all within some 30 km around
    v[:40], v[40:44] = v[40:80], [[5, 1, 1], [-7, 1, 1], [2, 4, 1], [3.75, 4.5, 1]]  # places of one point, lonely ones, one near the pole
    rows = [(k, [float(x) for x in e]) for k, e in enumerate(v)] + [(800, [0.0, 0.0, None]), (801, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    (got, want), rows = shuffled(spark, lambda: against_sql(spark, tmp_path, "weight_sensitivity", "embeddings"))
    pairs = entry.queries()["distance_band"](spark, str(tmp_path)).filter("km <= 30").count()
    assert got == want and rows < 802 * 40 < pairs
