"""Case records: wide export rows to entries, products and term levels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ranked_items


def first_existing(df: DataFrame, aliases: list[str]) -> Column:
    """The first of the aliases that df has as a column, whatever the case; null where it has none."""
    names = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{names[a.lower()]}`") for a in aliases if a.lower() in names), F.lit(None).cast("string"))


def entries(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each column that isn't blank: keys, place (from 1, in the order of columns), label, value."""
    cells = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("label"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for i, c in enumerate(columns, 1)))
    return df.select(*keys, F.explode(F.filter(cells, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("_x")).select(*keys, "_x.place", "_x.label", "_x.value")


def rendered(found: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of a case as lines ``label: value``."""
    lines = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "label", "value"))).alias("_x"))
    return lines.select(*keys, F.array_join(F.transform("_x", lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "\n").alias("text"))


def products(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each ``Product N`` that has a field: keys, product (N), role, display_name, fields (name to value)."""
    found: dict[int, dict[str, str]] = {}
    for column in df.columns:
        if m := re.match(r"^Product (\d+) (.+)$", column):
            found.setdefault(int(m[1]), {})[m[2]] = column
    named = {n: fields for n, fields in found.items() if "Product Name" in fields}
    if not named:
        return df.select(*keys, F.lit(None).cast("int").alias("product"), F.lit("").alias("role"), F.lit("").alias("display_name"), F.create_map().cast("map<string,string>").alias("fields")).limit(0)

    def product(n: int, fields: dict[str, str]) -> Column:
        cells = F.array(*(F.struct(F.lit(k), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for k, c in fields.items()))
        return F.struct(F.lit(n).alias("product"), F.map_from_entries(F.filter(cells, lambda x: F.coalesce(x["v"], F.lit("")) != "")).alias("fields"))

    rows = df.select(*keys, F.explode(F.array(*(product(n, f) for n, f in sorted(named.items())))).alias("_x")).select(*keys, "_x.product", "_x.fields").where(F.size("fields") > 0)
    role = F.lower(F.coalesce(F.col("fields")["Role"], F.lit("")))
    name = F.coalesce(*(F.col("fields")[x] for x in ("Product Name", "Prod Active Ingred", "Product Active Ingredient")), F.lit("(Unnamed Product)"))
    return rows.select(*keys, "product", F.when(role == "suspect", "Suspect").when(role == "concomitant", "Concomitant").otherwise("Other").alias("role"), name.alias("display_name"), "fields")


def aligned_terms(df: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Ranked lists of several levels side by side: the item of rank term_id, else the one at that place, else empty; rows of nothing but empty terms go."""
    lists = df.select(*keys, *(ranked_items(F.col(x)).alias(x) for x in levels))
    number = F.greatest(*(F.size(x) for x in levels))
    rows = lists.withColumn("term_id", F.explode(F.sequence(F.lit(1), F.greatest(number, F.lit(1)))))

    def term(level: str) -> Column:
        ranked = F.get(F.filter(F.col(level), lambda x: x["rank"] == F.col("term_id")), F.lit(0))["text"]
        return F.coalesce(ranked, F.get(F.col(level), F.col("term_id") - 1)["text"], F.lit(""))

    return rows.select(*keys, "term_id", *(term(x).alias(x) for x in levels)).where(F.concat(*levels) != "")
