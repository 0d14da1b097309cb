"""Deterministic splits in the order of a hash that any SQL engine has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_order(df: DataFrame, key: str, seed: int, strata: list[str], digits: int = 3) -> DataFrame:
    """df with place: from 0, in the order of md5(seed, key) in each stratum.

    No stratum is sorted in one task: rows are numbered in 16**digits ranges of the
    hash, each of which begins where the counts of those before it end.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_range", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*strata, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*strata, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*strata, "_range").orderBy("_h", key)) - 1
    return hashed.withColumn("_inside", inside).join(starts, [*strata, "_range"]).withColumn("place", F.col("_start") + F.col("_inside")).drop("_h", "_range", "_inside", "_start")


def folds(df: DataFrame, key: str, k: int, *, seed: int = 42, strata: list[str] | None = None) -> DataFrame:
    """df with fold (0 to k - 1): dealt round robin, anew in each stratum."""
    return with_order(df, key, seed, strata or []).withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


def cross_validation(df: DataFrame, k: int, *, dev_offset: int = 1) -> DataFrame:
    """A row for each row of df (fold) and each test fold: part is test, dev or train."""
    part = F.when(F.col("fold") == F.col("test_fold"), "test").when(F.col("fold") == (F.col("test_fold") + dev_offset) % k, "dev").otherwise("train")
    return df.withColumn("test_fold", F.explode(F.array(*(F.lit(i) for i in range(k))))).withColumn("part", part)


def fractions(df: DataFrame, key: str, *, test: int, dev: int, seed: int = 42) -> DataFrame:
    """df with part: test and dev (per cent, at least a row each) by the order of a hash, the others train."""
    placed = with_order(df, key, seed, [])
    least = lambda percent: F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))
    sized = placed.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))), F.lit(True))
    part = F.when(F.col("place") < least(test), "test").when(F.col("place") < least(test) + least(dev), "dev").otherwise("train")
    return sized.withColumn("part", part).drop("place", "_n")


def leave_one_out(df: DataFrame, key: str, series: str, values: list, *, dev: int, seed: int = 42) -> DataFrame:
    """A row for each row of df and each series held out: part is test for that series, dev for so many per cent of the others, else train."""
    each = df.withColumn("held", F.explode(F.array(*map(F.lit, values))))
    rest = with_order(each.where(F.col(series) != F.col("held")), key, seed, ["held"])
    sizes = rest.groupBy("held").agg(F.count(F.lit(1)).alias("_n"))
    parts = rest.join(F.broadcast(sizes), "held").withColumn("part", F.when(F.col("place") < F.floor(F.col("_n") * dev / 100), "dev").otherwise("train"))
    return each.where(F.col(series) == F.col("held")).withColumn("part", F.lit("test")).unionByName(parts.drop("place", "_n"))


def frequent_labels(spans: DataFrame, train: DataFrame, label: str, least: int) -> DataFrame:
    """The spans whose label the training spans have at least so often."""
    return spans.join(train.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(label), label, "left_semi")
