"""Agreement of two annotators over mention pairs (label_1, label_2, text_1, text_2, truth): a side without the mention has no label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import f1, ratio
from ..functions.text import clean_punct, contain_each_other


def _sides() -> tuple[Column, Column, Column]:
    one, two = F.col("label_1"), F.col("label_2")
    return one, two, one.isNotNull() & two.isNotNull()


def summarised(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """One row: pairs, cases, those both marked, label agreement (per cent), strict scores of the one by the other, and how often each is right by the adjudicated truth (Both, ONE, TWO)."""
    one, two, both = _sides()
    same = both & (one == two)
    exact = same & (F.col("text_1") == F.col("text_2"))
    resolved = F.col("truth").isin("Both", "ONE", "TWO")
    found = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("case_id").alias("cases"), F.count_if(both).alias("both"), F.count_if(same).alias("_same"), F.count_if(exact).alias("_exact"), F.count_if(one.isNotNull()).alias("_one"), F.count_if(two.isNotNull()).alias("_two"),
        F.count_if(resolved).alias("_resolved"), F.count_if(F.col("truth").isin("Both", "ONE")).alias("_right_one"), F.count_if(F.col("truth").isin("Both", "TWO")).alias("_right_two"),
    )
    p, r = ratio(F.col("_exact"), F.col("_one")), ratio(F.col("_exact"), F.col("_two"))
    percent = lambda a, b: F.round(100 * ratio(F.col(a), F.col(b)), digits)
    return found.select("pairs", "cases", "both", percent("_same", "both").alias("label_agreement"), F.round(p, digits).alias("strict_p"), F.round(r, digits).alias("strict_r"), F.round(f1(p, r), digits).alias("strict_f1"), percent("_right_one", "_resolved").alias("one_right"), percent("_right_two", "_resolved").alias("two_right"))


def discrepancy() -> Column:
    """What parts the two sides of a pair; null where nothing does."""
    one, two, both = _sides()
    a, b = F.col("text_1"), F.col("text_2")
    bare = clean_punct(a)
    apart = F.when((bare == clean_punct(b)) & (bare != ""), "punctuation").when(contain_each_other(a, b), "substring").otherwise("span")
    return F.when(~both, "unilateral").when(one != two, "wrong label").when(~a.eqNullSafe(b), apart)


def discrepancies(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """kind, n and percent (of all pairs that differ) of each kind of discrepancy."""
    kinds = pairs.select(discrepancy().alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(F.broadcast(kinds.agg(F.sum("n").alias("_all"))), F.lit(True)).select("kind", "n", F.round(100 * F.col("n") / F.col("_all"), digits).alias("percent"))


def by_category(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """By the first annotator's label: pairs that both marked, those of one label, per cent."""
    one, two, both = _sides()
    found = pairs.where(both).groupBy(one.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(one == two).alias("matched"))
    return found.withColumn("percent", F.round(100 * F.col("matched") / F.col("n"), digits))
