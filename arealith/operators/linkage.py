"""Linking names to reference rows inside blocks: normalisation, tiers, overrides, proposals.

Joins on suffixes and prefixes explode the (bounded) suffixes of each name into keys of an equi-join,
so a block of g names costs its names' lengths, not g squared.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Words for legal entities that names may carry, and words for types of facilities.
LEGAL_TERMS = (
    "社会医療法人社団", "社会医療法人財団", "特定医療法人社団", "特定医療法人財団", "医療法人社団", "医療法人財団", "医療法人", "社会医療法人", "特定医療法人", "独立行政法人", "国立研究開発法人", "地方独立行政法人", "国立大学法人",
    "公立大学法人", "学校法人", "公益社団法人", "一般社団法人", "公益財団法人", "一般財団法人", "社会福祉法人", "恩賜財団", "厚生農業協同組合連合会", "農業協同組合連合会", "厚生連", "国民健康保険団体連合会", "共済組合連合会",
)
TYPE_WORDS = (
    "病院", "医院", "診療所", "クリニック", "医療センター", "センター", "歯科医院", "歯科診療所", "歯科クリニック", "歯科", "薬局", "内科", "外科", "眼科", "耳鼻科", "耳鼻咽喉科", "皮膚科", "皮膚泌尿器科", "産婦人科", "産科", "婦人科",
    "小児科", "精神科", "神経科", "神経内科", "心療内科", "整形外科", "形成外科", "美容外科", "脳神経外科", "呼吸器科", "呼吸器内科", "循環器科", "循環器内科", "消化器科", "消化器内科", "泌尿器科", "放射線科", "麻酔科", "リハビリテーション科",
    "リハビリ科", "アレルギー科", "腫瘍内科", "乳腺外科", "肛門科", "胃腸科",
)

# The marks that names are compared without.
MARKS = "・･｡｢｣「」『』【】()（）[]｛｝{}<>〈〉《》〔〕、。，．,.!！?？:：;；~～-ー－―_/／\\｜|"
SYMBOLS = "[" + "".join(f"\\{c}" if ord(c) < 128 else c for c in MARKS) + "]"


def nfkc(text: Column) -> Column:
    """Unicode compatibility form, in Arrow batches: Spark has no function for it."""
    @pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return form(text)


def bare(text: Column) -> Column:
    """Lower case without white space and marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s\u3000]+", ""), SYMBOLS, "")


def _plain(words: Sequence[str]) -> list[str]:
    import re
    import unicodedata

    out = {re.sub(rf"\s|{SYMBOLS}", "", unicodedata.normalize("NFKC", w).lower()) for w in words}
    return sorted(out - {""}, key=lambda w: (-len(w), w))


def removed(text: Column, words: Sequence[str]) -> Column:
    """The text without the words, the longest first, one after the other."""
    for w in _plain(words):
        text = F.replace(text, F.lit(w), F.lit(""))
    return text


def normalised(text: Column, legal: Sequence[str] = LEGAL_TERMS, types: Sequence[str] = TYPE_WORDS) -> Column:
    """Bare form without legal terms, unless only words for types would be left. For other scripts apply ``nfkc`` first."""
    before = bare(text)
    after = removed(before, legal)
    return F.when(removed(after, types) == "", before).otherwise(after)


def type_word_only(name: Column, types: Sequence[str] = TYPE_WORDS) -> Column:
    return removed(name, types) == ""


def suffix_pairs(left: DataFrame, right: DataFrame, least: int = 5, types: Sequence[str] = TYPE_WORDS) -> DataFrame:
    """``(left_id, right_id)``: names of a block of which one ends with the other, not equal; the shorter has five characters and more than type words."""

    def long_side(d: DataFrame, name: str) -> DataFrame:
        n = F.length("norm")
        tails = F.transform(F.sequence(F.lit(2), F.greatest(n - least + 1, F.lit(2))), lambda k: F.substring(F.col("norm"), k, n))
        return d.select(F.col("id").alias(f"{name}_id"), "block", F.explode(tails).alias("tail")).filter(F.length("tail") >= least)

    def short_side(d: DataFrame, name: str) -> DataFrame:
        return d.filter((F.length("norm") >= least) & ~type_word_only(F.col("norm"), types)).select(F.col("id").alias(f"{name}_id"), "block", F.col("norm").alias("tail"))

    one = long_side(left, "left").join(short_side(right, "right"), ["block", "tail"])
    two = short_side(left, "left").join(long_side(right, "right"), ["block", "tail"])
    same = left.select(F.col("id").alias("left_id"), "block", "norm").filter((F.length("norm") >= least) & ~type_word_only(F.col("norm"), types)).join(right.select(F.col("id").alias("right_id"), "block", "norm"), ["block", "norm"])
    return one.select("left_id", "right_id").union(two.select("left_id", "right_id")).union(same.select("left_id", "right_id")).distinct()


def exact_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(F.col("id").alias("left_id"), "block", "norm").join(right.select(F.col("id").alias("right_id"), "block", "norm"), ["block", "norm"]).select("left_id", "right_id")


def tiered_linkage(roster: DataFrame, reference: DataFrame, overrides: DataFrame, types: Sequence[str] = TYPE_WORDS) -> DataFrame:
    """``(id, status, method, ref_id, contested)`` for every roster row.

    roster ``(id, block, norm)``; reference ``(id, block, norm, source)``; overrides ``(id, ref_id)`` win.
    Tiers: exact then suffix in source 1, exact then suffix in source 2; the first tier with exactly one
    reference row counts. Two or more in some tier and one in none: ``multiple_candidates_in_block``.
    References that several rows without an override share are kept and flagged; overrides neither count nor are flagged.
    """
    tiers = []
    for source in (1, 2):
        ref = reference.filter(F.col("source") == source)
        tiers += [(f"exact/{source}", exact_pairs(roster, ref)), (f"suffix/{source}", suffix_pairs(roster, ref, types=types))]
    found = None
    for k, (name, pairs) in enumerate(tiers):
        one = pairs.groupBy("left_id").agg(F.count("*").alias("n"), F.min("right_id").alias("ref")).select("left_id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("method"), F.col("ref").alias("ref_id")).alias("t"), "n")
        found = one if found is None else found.union(one)
    best = found.groupBy(F.col("left_id").alias("id")).agg(F.min(F.when(F.col("n") == 1, F.col("t"))).alias("t"), F.max("n").alias("most"))
    own = overrides.select("id", F.col("ref_id").alias("override"))
    out = roster.select("id").join(own, "id", "left").join(best, "id", "left")
    over = F.col("override").isNotNull()
    out = out.select(
        "id",
        F.when(over | F.col("t").isNotNull(), "matched").otherwise("unmatched").alias("status"),
        F.when(over, "override").when(F.col("t").isNotNull(), F.col("t.method")).when(F.col("most") > 1, "multiple_candidates_in_block").otherwise("no_name_match").alias("method"),
        F.coalesce("override", "t.ref_id").alias("ref_id"),
    )
    shared = out.filter("ref_id is not null and method <> 'override'").groupBy("ref_id").agg((F.count("*") > 1).alias("shared"))
    contested = F.coalesce("shared", F.lit(False)) & (F.col("method") != "override")
    return out.join(shared, "ref_id", "left").select("id", "status", "method", "ref_id", contested.alias("contested"))


def resolved_codes(names: DataFrame, reference: DataFrame) -> DataFrame:
    """Codes of names that have exactly one distinct code in their block; else the reason."""
    n = reference.groupBy("block", "norm").agg(F.countDistinct("code").alias("codes"), F.min("code").alias("code"))
    out = names.join(n, ["block", "norm"], "left")
    return out.select("id", F.when(F.col("codes") == 1, F.col("code")).alias("code"), F.when(F.col("codes").isNull(), "not found").when(F.col("codes") > 1, "several codes").otherwise("").alias("reason"))


def prefix_proposals(names: DataFrame, pool: DataFrame, least: int = 4, top: int = 3) -> DataFrame:
    """The shortest names of the pool in a block that begin with a name of at least four characters and are longer."""
    k = F.sequence(F.lit(least), F.greatest(F.length("norm") - 1, F.lit(least)))
    heads = F.explode(F.transform(k, lambda n: F.substring(F.col("norm"), F.lit(1), n))).alias("head")
    longer = pool.select(F.col("id").alias("right_id"), "block", heads, F.col("norm").alias("right_norm")).filter(F.length("head") < F.length("right_norm"))
    whole = names.filter(F.length("norm") >= least).select(F.col("id").alias("left_id"), "block", F.col("norm").alias("head"))
    both = whole.join(longer, ["block", "head"]).select("left_id", "right_id", "right_norm")
    w = Window.partitionBy("left_id").orderBy(F.length("right_norm"), "right_norm", "right_id")
    return both.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top).select(F.col("left_id").alias("id"), "rank", F.col("right_id").alias("candidate"))


def fuzzy_candidates(names: DataFrame, pool: DataFrame, least: float = 0.68) -> DataFrame:
    """``(block, a, b)``: distinct forms of a block that may reach a ratio of matching characters.

    A ratio implies 2 * (characters in common, with counts) >= ratio * (summed lengths). Candidates meet on one of their
    rarest characters, as many of them as such a pair must share one of, once for each pair, and then pass that bound;
    names of equal form are compared once.
    """

    def marked(d: DataFrame) -> DataFrame:
        """A mark for each character and its number in the name."""
        every = F.transform(F.sequence(F.lit(1), F.length("norm")), lambda n: F.substring(F.col("norm"), n, F.lit(1)))
        d = d.filter(F.length("norm") > 0).select("block", "norm").distinct().select("block", "norm", F.posexplode(every).alias("at", "c"))
        number = F.row_number().over(Window.partitionBy("block", "norm", "c").orderBy("at"))
        return d.select("block", "norm", F.concat("c", number.cast("string")).alias("mark"))

    left, right = marked(names), marked(pool)
    often = left.union(right).groupBy("block", "mark").agg(F.count("*").alias("n"))

    def heads(d: DataFrame, name: str) -> DataFrame:
        marks = d.join(often, ["block", "mark"]).groupBy("block", "norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "mark"))), lambda m: m["mark"]).alias("marks"))
        # A partner is at least least / (2 - least) as long, so at least that share of the name's characters is common.
        must = F.greatest(F.ceil(F.size("marks") * (least / (2 - least)) - 1e-9), F.lit(1))
        head = F.slice("marks", F.lit(1), (F.size("marks") - must + 1).cast("int"))
        return marks.select("block", F.col("norm").alias(name), F.col("marks").alias(f"{name}_marks"), head.alias(f"{name}_head")).withColumn("mark", F.explode(f"{name}_head"))

    la, lb = F.length("a"), F.length("b")
    near = heads(left, "a").join(heads(right, "b"), ["block", "mark"]).filter((F.col("a") != F.col("b")) & (2 * F.least(la, lb) >= least * (la + lb) - 1e-9))
    near = near.filter(F.col("mark") == F.get(F.array_intersect("a_head", "b_head"), F.lit(0)))
    return near.filter(2 * F.size(F.array_intersect("a_marks", "b_marks")) >= least * (la + lb) - 1e-9).select("block", "a", "b")


def fuzzy_proposals(names: DataFrame, pool: DataFrame, least: float = 0.68, top: int = 3) -> DataFrame:
    """The most similar distinct names of a block by the ratio of matching blocks of characters, in Arrow batches."""

    @pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    near = fuzzy_candidates(names, pool, least).withColumn("ratio", ratio("a", "b")).filter(F.col("ratio") >= least)
    w = Window.partitionBy("block", "a").orderBy(F.col("ratio").desc(), "b")
    best = near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
    return names.select("id", "block", F.col("norm").alias("a")).join(best, ["block", "a"]).select("id", "rank", F.col("b").alias("candidate"), F.round("ratio", 6).alias("ratio"))


def proposals(names: DataFrame, pool: DataFrame, **options) -> DataFrame:
    """``(id, rank, candidate, ratio)``: names that begin alike, and only where a name has none, similar ones (``ratio`` is null for the former)."""
    first = prefix_proposals(names, pool).join(pool.select(F.col("id").alias("candidate"), F.col("norm").alias("form")), "candidate")
    left = names.join(first.select("id").distinct(), "id", "left_anti")
    return first.select("id", "rank", F.col("form").alias("candidate"), F.lit(None).cast("double").alias("ratio")).union(fuzzy_proposals(left, pool, **options))
