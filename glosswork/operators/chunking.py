"""Texts in sentences and overlapping chunks, and spans put back into document coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, n_tokens, sentence_pieces
from .spans import FOLDED, clean_span, containment_join, kept_of_islands, with_islands

_CHUNKS = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("text", pa.string())])


def sentences(documents: DataFrame) -> DataFrame:
    """doc_id, sentence (from 0), s, e, text: the sentences of each document, whose ids are unique; joined they are the text."""
    pieces = documents.where("text is not null").select("doc_id", F.posexplode(sentence_pieces(F.col("text"))).alias("sentence", "text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("e", upto).select("doc_id", "sentence", (F.col("e") - F.length("text")).alias("s"), "e", "text")


def chunk_bounds(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of at most size characters that end at a blank beyond their middle, where there is one, and overlap."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            blank = text.rfind(" ", start, end)
            end = blank if blank > start + size // 2 else end
        yield start, end
        if end == len(text):
            return
        start = max(start + 1, end - overlap)
        while start < end and text[start].isspace():
            start += 1


def sliding_chunks(documents: DataFrame, *, size: int = 900, overlap: int = 150) -> DataFrame:
    """doc_id, chunk (from 0), s, e, text of each chunk; nothing for null and empty texts."""
    if not 0 <= overlap < size // 2:
        raise ValueError("an overlap must be less than half a chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bounds = list(chunk_bounds(text or "", size, overlap))
                for at in range(0, len(bounds), 1000):
                    part = bounds[at : at + 1000]
                    columns = [doc_id] * len(part), list(range(at, at + len(part))), [s for s, _ in part], [e for _, e in part], [text[s:e] for s, e in part]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNKS, strict=True)], schema=_CHUNKS)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, chunk int, s int, e int, text string")


def projected(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """Spans (s, e within a chunk from start to end of its document) in document coordinates, and margin: the distance to the chunk's nearer edge."""
    margin = F.least(F.col("s"), end - start - F.col("e"))
    return spans.withColumns({"margin": margin, "s": F.col("s") + start, "e": F.col("e") + start})


def _met(documents: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sentences, and each with the spans that overlap it: doc_id, sentence, s, e, lab, contained."""
    st = sentences(documents)
    bounds = st.select("doc_id", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), F.col("sentence").alias("lab"))
    pairs = containment_join(spans, bounds)
    return st, pairs.select("doc_id", F.col("lab2").alias("sentence"), "s", "e", "lab", (F.col("s") - F.col("s2")).alias("_s"), (F.col("e") - F.col("s2")).alias("_e"), "contained")


def sentence_examples(documents: DataFrame, spans: DataFrame, *, max_tokens: int = 512) -> DataFrame:
    """doc_id, sentence, text, spans, outcome, crossing of each sentence, as an example to learn spans from.

    spans are those inside the sentence, in its coordinates, moved inwards past
    white space, each once; crossing is the number of spans that lie across its bounds. An
    outcome is blank; too long (more than max_tokens tokens); overlap (of its spans); unaligned (a
    span begins or ends within a word); negative (no spans); or example.
    """
    return _examples(documents, spans, max_tokens).withColumn("crossing", F.size("_across")).select("doc_id", "sentence", "text", "spans", "outcome", F.col("crossing").cast("long").alias("crossing"))


def _examples(documents: DataFrame, spans: DataFrame, max_tokens: int) -> DataFrame:
    """sentence_examples with the spans across a sentence's bounds (_across: s, e, lab in the document)."""
    st, met = _met(documents, spans.join(documents.select("doc_id"), "doc_id", "left_semi"))
    own = F.collect_list(F.when(F.col("contained"), F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"), "lab"))).alias("_all")
    across = F.collect_list(F.when(~F.col("contained"), F.struct("s", "e", "lab"))).alias("_across")
    found = met.groupBy("doc_id", "sentence").agg(own, across)
    text, none = F.col("text"), lambda name: F.array().cast(found.schema[name].dataType)

    def inwards(x: Column) -> Column:
        low, high = clean_span(text, x["s"], x["e"])
        return F.struct(low.alias("s"), high.alias("e"), x["lab"].alias("lab"))

    kept = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("_all", none("_all")), inwards), lambda x: x["s"] < x["e"])))
    rows = st.join(found, ["doc_id", "sentence"], "left").withColumn("spans", kept)
    within = lambda at: F.substring(text, at, F.lit(2)).rlike(r"^[\p{L}\p{N}_]{2}\z")
    lapped = F.exists(F.transform("spans", lambda x, i: x["e"] > F.get("spans", i + 1)["s"]), lambda x: F.coalesce(x, F.lit(False)))
    cut = F.exists("spans", lambda x: ((x["s"] > 0) & within(x["s"])) | within(x["e"]))
    outcome = F.when(~text.rlike(rf"[^{SPACE}]"), "blank").when(n_tokens(text) > max_tokens, "too long").when(lapped, "overlap").when(cut, "unaligned").when(F.size("spans") > 0, "example").otherwise("negative")
    return rows.select("doc_id", "sentence", "text", "spans", outcome.alias("outcome"), F.coalesce("_across", none("_across")).alias("_across"))


def example_counts(documents: DataFrame, spans: DataFrame, *, max_tokens: int = 512) -> DataFrame:
    """One row: sentences, how many have each outcome, the spans of examples, and the different spans across bounds of sentences that aren't blank or too long."""
    # A row for each span across a sentence's bounds; the first, or the only one without, stands for the sentence.
    across = F.when(~F.col("outcome").isin("blank", "too long"), F.col("_across"))
    found = _examples(documents, spans, max_tokens).select("doc_id", "outcome", F.size("spans").alias("_n"), F.posexplode_outer(across).alias("_at", "_x"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    outcomes = {x.replace(" ", "_"): F.count_if(first & (F.col("outcome") == x)) for x in ("blank", "too long", "overlap", "unaligned", "example", "negative")}
    n_spans = F.coalesce(F.sum(F.when(first & (F.col("outcome") == "example"), F.col("_n"))), F.lit(0)).cast("long")
    crossing = F.count_distinct(F.when(F.col("_x").isNotNull(), F.struct("doc_id", "_x")))
    return found.agg(F.count_if(first).alias("sentences"), *(c.alias(n) for n, c in outcomes.items()), n_spans.alias("spans"), crossing.alias("crossing"))


def _larger_margins(spans: list[dict]) -> list[dict]:
    """As the fold below. A kept span that ended before a start meets no later one: those at the head are passed over for good."""
    kept, head = [], 0
    for x in spans:
        while head < len(kept) and kept[head]["e"] <= x["s"]:
            head += 1
        if head == len(kept):
            kept.append(x)
        elif x["m"] < kept[head]["m"]:
            kept[head] = x
    return kept


def dedupe_margin(spans: DataFrame, *, folded: int = FOLDED) -> DataFrame:
    """Of overlapping spans (doc_id, s, e, lab, margin) of one label, in order of start, the one of the larger margin takes the place of the kept one that it meets first. Spans hold something (s < e)."""
    keys = spans.withColumn("_doc", F.struct("doc_id", "lab")).withColumnRenamed("doc_id", "_id")
    islands = with_islands(keys.withColumnRenamed("_doc", "doc_id")).groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("s", "e", (-F.col("margin")).alias("m")))).alias("_all"))
    span = islands.schema["_all"].dataType.simpleString()
    meets = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])

    def step(acc: Column, x: Column) -> Column:
        # The first kept span that x meets; kept spans of an island may have been replaced and need not lie in order.
        hit = F.array_position(F.transform(acc, lambda k: meets(k, x)), F.lit(True)).cast("int")
        better = F.transform(acc, lambda k, i: F.when((i + 1 == hit) & (x["m"] < k["m"]), x).otherwise(k))
        return F.when(hit > 0, better).otherwise(F.array_append(acc, x))

    kept = F.aggregate(F.col("_all"), F.array().cast(span), step)
    found = kept_of_islands(islands.select("doc_id.doc_id", "doc_id.lab", "_all"), kept, _larger_margins, folded=folded)
    return found.select("doc_id", F.col("_x.s").alias("s"), F.col("_x.e").alias("e"), "lab", (-F.col("_x.m")).alias("margin"))
