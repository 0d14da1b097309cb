"""Maintenance of tables: upserts, replacement, differences of multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in; blank or null values of new leave what was there."""
    values = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values))
    filled = [F.coalesce(F.when(F.trim(F.col(f"_new_{c}").cast("string")) != "", F.col(f"_new_{c}")), F.col(c)).alias(c) for c in values]
    return old.join(renamed, keys, "full").select(*keys, *filled)


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with all rows of the keys that new has replaced by new's."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def reconcile(authority: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """By key: how many rows found has too few (missing) and too many (excess)."""
    a, b = (df.groupBy(key).agg(F.count(F.lit(1)).alias(name)) for df, name in ((authority, "_a"), (found, "_b")))
    diff = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return a.join(b, key, "full").select(key, F.greatest(diff, F.lit(0)).cast("long").alias("missing"), F.greatest(-diff, F.lit(0)).cast("long").alias("excess"))


def domain_problems(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """problem, value: values of a column that aren't allowed, and allowed ones that it lacks."""
    found = df.select(F.col(column).cast("string").alias("value")).distinct()
    known = df.sparkSession.createDataFrame([(x,) for x in allowed], "value string")
    extra, absent = found.join(known, "value", "left_anti"), known.join(found, "value", "left_anti")
    return extra.select(F.lit("unexpected").alias("problem"), "value").unionByName(absent.select(F.lit("missing").alias("problem"), "value"))


def looked_up(wanted: DataFrame, stored: DataFrame, name: str, stored_name: str, keys: list[str]) -> DataFrame:
    """wanted with the stored name that equals its name, else the one that does so less ``.json``; null where there is none."""
    bare = lambda c: F.regexp_replace(c, r"\.json$", "")
    pairs = wanted.join(stored.withColumn("_bare", bare(stored_name)), bare(name) == F.col("_bare"), "left")
    return pairs.groupBy(*keys, name).agg(F.min_by(stored_name, F.struct(F.col(stored_name) != F.col(name), F.col(stored_name))).alias(stored_name))


def latest(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Of each key the values of the row that is last in order."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_x")).select(*keys, f"_x.{order}", *(f"_x.{v}" for v in values))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, always: list[str], touched: str, at: Column) -> DataFrame:
    """merge() in which the columns always take new's value, and touched is set where new has a row."""
    both = merge(old.drop(*always, touched), new, keys)
    fresh = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in always), F.lit(True).alias("_new"))
    kept = old.select(*keys, *always, touched)
    out = both.join(fresh, keys, "left").join(kept, keys, "left")
    changed = {c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in always}
    return out.withColumns(changed | {touched: F.when(F.col("_new"), at).otherwise(F.col(touched))}).select(*old.columns)


def backfill(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, its blank and null values filled from new where that has a row; no row is added."""
    values = [c for c in old.columns if c not in keys]
    found = old.join(new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values)), keys, "left")
    return found.select(*keys, *(F.coalesce(F.when(F.trim(F.col(f"_new_{c}").cast("string")) != "", F.col(f"_new_{c}")), F.col(c)).alias(c) for c in values))


def insert_or_keep(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows; of a row that both have, new's values where they aren't null."""
    values = [c for c in old.columns if c not in keys]
    found = old.join(new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values)), keys, "full")
    return found.select(*keys, *(F.coalesce(f"_new_{c}", c).alias(c) for c in values))


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """links with those of new that it lacks."""
    return links.unionByName(new.distinct().join(links, links.columns, "left_anti"))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows whose key is among the deleted ones."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def reviewed(annotations: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """annotations (keys, note) after reviews (keys, verdict, user): each is noted on its annotation, and a verified one gets a copy of the user's own."""
    found = annotations.join(reviews, keys, "left")
    noted = F.when(F.col("verdict") == "verify", F.concat("note", F.lit(" | VERIFIED BY "), "user")).when(F.col("verdict") == "reject", F.concat("note", F.lit(" | REJECTED BY "), "user")).otherwise(F.col("note"))
    copies = found.where("verdict = 'verify'").withColumn("note", F.col("user"))
    return found.withColumn("note", noted).unionByName(copies).select(*annotations.columns)


def replayed(log: DataFrame, key: str, order: str) -> DataFrame:
    """key, value, disputed: what a log of edits (key, order, action, undoes, value) leaves.

    Actions are add, update, remove, dispute and undo, which takes back the edit
    whose order it names. An annotation is there if an add or update follows its
    last removal; it is disputed if the number of disputes since then is odd.
    """
    undone = log.where("action = 'undo' and undoes is not null").select(F.col("undoes").alias(order)).distinct()
    edits = log.where("action <> 'undo'").join(undone, order, "left_anti")
    removed = edits.where("action = 'remove'").groupBy(key).agg(F.max(order).alias("_removed"))
    live = edits.join(removed, key, "left").where(F.col("_removed").isNull() | (F.col(order) > F.col("_removed")))
    written = F.when(F.col("action").isin("add", "update"), F.col(order))
    found = live.groupBy(key).agg(F.max_by("value", written).alias("value"), (F.count_if(F.col("action") == "dispute") % 2 == 1).alias("disputed"), F.count(written).alias("_n"))
    return found.where("_n > 0").drop("_n")
