"""Corpus statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import n_sentences, n_tokens


def measured(documents: DataFrame) -> DataFrame:
    """documents with n_tokens (words and single other marks) and n_sentences (those that aren't blank)."""
    return documents.withColumns({"n_tokens": n_tokens(F.col("text")), "n_sentences": n_sentences(F.col("text"))})


def statistics(documents: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Documents, tokens and sentences by keys, with mean, sample deviation and median of tokens."""
    t = F.col("n_tokens")
    return measured(documents).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(t).alias("tokens"), F.sum("n_sentences").alias("sentences"), F.round(F.avg(t), digits).alias("mean_tokens"),
        F.round(F.coalesce(F.stddev_samp(t), F.lit(0.0)), digits).alias("sd_tokens"), F.median(t).alias("median_tokens"),
    )


def with_annotations(statistics: DataFrame, documents: DataFrame, annotations: DataFrame, key: str, *, left_out: dict[str, list[str]], ae: list[str], drug: list[str]) -> DataFrame:
    """statistics by key with annotations, ae_terms and drug_terms: of the annotations (doc_id, label, term) of the key's documents their number, less the labels that are left out for the key, and the different terms of two sets of labels."""
    out = [(F.col(key).eqNullSafe(F.lit(k))) & F.col("label").isin(*labels) for k, labels in left_out.items()]
    counted = reduce(lambda a, b: a & ~F.coalesce(b, F.lit(False)), out, F.lit(True))
    term = lambda labels: F.count_distinct(F.when(F.col("label").isin(*labels) & (F.col("term") != ""), F.col("term")))
    found = annotations.join(documents.select("doc_id", key), "doc_id").groupBy(F.col(key).alias("_key")).agg(F.count_if(counted).alias("annotations"), term(ae).alias("ae_terms"), term(drug).alias("drug_terms"))
    names = ("annotations", "ae_terms", "drug_terms")
    # As many rows on either side as there are keys.
    joined = statistics.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def source_matrix(spans: DataFrame, source: str, values: list[str]) -> DataFrame:
    """Counts by label and source, side by side, with a row of totals (label TOTAL)."""
    cells = [F.count_if(F.col(source) == v).alias(v) for v in values]
    return spans.rollup("lab").agg(F.grouping("lab").alias("_all"), *cells).select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("lab").cast("string")).alias("lab"), *values)
