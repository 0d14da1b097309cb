"""Annotations as they are stored (label, note, used, s, e, text, text_raw, with s and e as text): labels, offsets, layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_term, occurrences

#: Interface categories and what a label of theirs contains, first match first (fixed values).
UI_CATEGORIES = (
    ("ADVERSE EVENTS", ("AE", "SYMPTOM", "SIGN", "COD", "CAUSE OF DEATH")),
    ("MEDICAL HISTORY", ("MEDICAL HISTORY", "BSYM", "MHX", "DIAGNOSTIC", "R/O", "MH")),
    ("INTERVENTIONS", ("DRUG", "VACCINE", "LAB", "TREATMENT", "PROCEDURE", "DEVICE", "MEDICATION")),
    ("TEMPORAL", ("TEMPORAL", "DATE", "TIME", "DURATION", "RELATIVE", "LATENCY", "FREQUENCY", "TEMPORAL SEQUENCE")),
)
DEMOGRAPHICS = ("AGE", "SEX", "GENDER", "RACE", "ETHNICITY", "BIRTH", "DEMOGRAPHIC")


def canonical(label: Column) -> Column:
    """Trimmed, lower case, empty for null; ``r/o`` is ``ro``."""
    found = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(found == "r/o", "ro").otherwise(found)


def normalized(annotations: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """annotations with canonical, category and status by taxonomy (raw, canonical, category), whose raw labels are unique.

    A label is looked up as it is, then whatever its case: status is mapped,
    excluded (the taxonomy has it without a canonical label) or unknown.
    """
    trimmed = annotations.withColumn("_raw", F.trim("label"))
    exact = taxonomy.select(F.col("raw").alias("_raw"), F.struct("canonical", "category").alias("_exact"))
    folded = taxonomy.groupBy(F.lower("raw").alias("_low")).agg(F.min_by(F.struct("canonical", "category"), "raw").alias("_folded"))
    found = trimmed.join(exact, "_raw", "left").join(folded, F.lower("_raw") == F.col("_low"), "left").withColumn("_hit", F.coalesce("_exact", "_folded"))
    status = F.when(F.col("_hit").isNull(), "unknown").when(F.col("_hit.canonical").isNull(), "excluded").otherwise("mapped")
    return found.withColumns({"canonical": F.col("_hit.canonical"), "category": F.col("_hit.category"), "status": status}).drop("_raw", "_low", "_exact", "_folded", "_hit")


def with_offsets(annotations: DataFrame, length: Column) -> DataFrame:
    """annotations with s and e as numbers and reason: valid, or why they aren't (no number, negative, empty, beyond the text)."""
    out = annotations.withColumns({"s": F.col("s").try_cast("int"), "e": F.col("e").try_cast("int")})
    s, e = F.col("s"), F.col("e")
    return out.withColumn("reason", F.when(s.isNull() | e.isNull(), "no number").when(s < 0, "negative").when(s >= e, "empty").when(e > length, "beyond").otherwise("valid"))


def prepared(annotations: DataFrame, taxonomy: DataFrame, length: Column) -> DataFrame:
    """doc_id, s, e, label, category of the annotations whose label is mapped and whose offsets are valid."""
    found = with_offsets(normalized(annotations, taxonomy), length).where("status = 'mapped' and reason = 'valid'")
    return found.select("doc_id", "s", "e", F.col("canonical").alias("label"), "category")


def loader_counts(annotations: DataFrame, taxonomy: DataFrame, length: Column) -> DataFrame:
    """One row: annotations seen, kept, excluded, of unknown label and of invalid offsets (of those with a label)."""
    found = with_offsets(normalized(annotations, taxonomy), length)
    mapped = F.col("status") == "mapped"
    return found.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(mapped & (F.col("reason") == "valid")).alias("kept"), F.count_if(F.col("status") == "excluded").alias("excluded"),
        F.count_if(F.col("status") == "unknown").alias("unknown"), F.count_if(mapped & (F.col("reason") != "valid")).alias("invalid"),
    )


def is_human(note: Column) -> Column:
    """No model's note, or one that a human has verified."""
    up = F.upper(F.coalesce(note, F.lit("")))
    return ~up.rlike("AI|LLM|LLAMA|BERT") | up.contains("VERIFIED")


def layer(note: Column) -> Column:
    up = F.upper(F.coalesce(note, F.lit("")))
    return F.when(is_human(note), "Human").when(up.rlike("LLM|LLAMA"), "LLM").when(up.contains("BERT"), "BERT").otherwise("LLM")


def display_pick(annotations: DataFrame, order: str, *, show_rejected: bool = False) -> DataFrame:
    """Of the annotations of a span (doc_id, s, e) the human one, else a language model's, else the encoder's; the last in order on ties."""
    shown = annotations if show_rejected else annotations.where(~F.upper(F.coalesce("note", F.lit(""))).contains("REJECTED"))
    # Dealt by span first: else each task sorts all that it reads, to send on the first of each span.
    shown = shown.withColumn("layer", layer(F.col("note"))).repartition("doc_id", "s", "e")
    rank = F.when(F.col("layer") == "Human", 1).when(F.col("layer") == "LLM", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("doc_id", "s", "e").orderBy(rank, F.desc(order)))
    return shown.withColumn("_place", place).where("_place = 1").drop("_place")


def ui_category(label: Column) -> Column:
    up = F.upper(label)
    found = F.when(up.isin(*DEMOGRAPHICS), "DEMOGRAPHICS")
    return reduce(lambda c, x: c.when(reduce(lambda a, b: a | b, (up.contains(w) for w in x[1])), x[0]), UI_CATEGORIES, found).otherwise("OTHER")


def terms(annotations: DataFrame) -> Column:
    return normalized_term(F.col("text_raw"), F.col("text"))


def flags(relationships: Column, kinds: tuple[str, ...]) -> list[Column]:
    """0/1 for each kind of relationship (a map from kind to span) whose span has a text."""
    return [F.coalesce((F.trim(relationships[k]["text"]) != "").cast("int"), F.lit(0)).alias(f"rel_{k}") for k in kinds]


def inventory(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """category, term, label, human, ai, in_texts: of each term in lower case how many annotations (doc_id, label, note, text) by humans and by models, and how often it stands, whatever its case, in the pages (doc_id, page) of its documents; a document counts once."""
    human = is_human(F.col("note"))
    by_doc = annotations.groupBy("doc_id", ui_category(F.col("label")).alias("category"), F.lower("text").alias("term"), canonical(F.col("label")).alias("label")).agg(F.count_if(human).alias("human"), F.count_if(~human).alias("ai"))
    found = by_doc.join(pages.select("doc_id", "page"), "doc_id", "left").withColumn("_n", F.coalesce(occurrences(F.col("page"), F.col("term")), F.lit(0)))
    return found.groupBy("category", "term", "label").agg(F.sum("human").alias("human"), F.sum("ai").alias("ai"), F.sum("_n").alias("in_texts"))
