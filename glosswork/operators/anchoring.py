"""Spans from what a model returned: inline tags, surfaces by category, or claimed offsets.

Tagged texts are parsed in Arrow batches, a text at a time, and spans of changed
texts follow the stretches that are equal. The k-th mention of a surface takes its
k-th occurrence in the text, in the JVM; mentions beyond the last one are dealt
out in order. Only surfaces without an exact occurrence go to the fuzzy search.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import exact_occurrences, nearest_occurrence
from .drift import boundaries
from .fuzzy import TextIndex, similar_window
from .spans import clean_span

_PARSED = pa.schema([("doc_id", pa.int64()), ("clean", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("lab", pa.string())]))), ("warnings", pa.list_(pa.string()))])
_PARSED_DDL = "doc_id long, clean string, spans array<struct<s:int,e:int,lab:string>>, warnings array<string>"

#: Texts that a task parses, and gives on, at once.
TEXTS = 100


def tag_pattern(tags: Iterable[str]) -> re.Pattern:
    names = "|".join(sorted(map(re.escape, tags), key=len, reverse=True))
    return re.compile(rf"<\s*(?P<close>/?)\s*(?P<tag>{names})\s*>", re.IGNORECASE)


def parse_tags(text: str, pattern: re.Pattern, labels: dict[str, str]) -> tuple[str, list[dict], list[str]]:
    """The text less its tags, the spans of closed tags in it, and what was wrong with the tags."""
    parts, spans, warnings, opened, at, length = [], [], [], [], 0, 0
    for m in pattern.finditer(text):
        parts.append(text[at : m.start()])
        length += m.start() - at
        at, tag = m.end(), m["tag"].upper()
        if not m["close"]:
            if opened:
                warnings.append(f"<{tag}> inside <{opened[-1][0]}>")
            opened.append((tag, length))
            continue
        own = next((i for i in reversed(range(len(opened))) if opened[i][0] == tag), None)
        if own is None:
            warnings.append(f"</{tag}> closes nothing")
            continue
        if own < len(opened) - 1:
            warnings.append(f"</{tag}> out of turn")
        start = opened.pop(own)[1]
        if start < length:
            spans.append({"s": start, "e": length, "lab": labels[tag]})
        else:
            warnings.append(f"<{tag}> holds nothing")
    warnings += [f"<{tag}> isn't closed" for tag, _ in opened]
    return "".join([*parts, text[at:]]), sorted(spans, key=lambda x: (x["s"], x["e"], x["lab"])), warnings


def parsed_tags(outputs: DataFrame, labels: dict[str, str]) -> DataFrame:
    """doc_id, clean, spans, warnings of outputs (doc_id, text); labels by tag, upper case. Null counts as empty."""
    pattern = tag_pattern(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            found = [parse_tags(x or "", pattern, labels) for x in b.column(1).to_pylist()]
            columns = [b.column(0), *([f[i] for f in found] for i in range(3))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _PARSED, strict=True)], schema=_PARSED)

    return outputs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PARSED_DDL)


def occupied(places: list[int], labels: list[str | None]) -> list[int | None]:
    """A place for each mention of a surface, in order: the first one after the mention before that its label hasn't had, else the first that its label hasn't had, else none."""
    free: dict[str | None, list[int]] = {}
    before, out = -1, []
    for label in labels:
        own = free.setdefault(label, list(places))
        at = bisect_right(own, before)
        at = at if at < len(own) else 0
        out.append(own.pop(at) if own else None)
        before = before if out[-1] is None else out[-1]
    return out


def _occupied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = b.to_pydict()
        found = [occupied(places, [m["lab"] for m in own]) for places, own in zip(columns["_at"], columns["_mentions"], strict=True)]
        again = [{"place": m["place"], "lab": m["lab"], "s": s} for own, at in zip(columns["_mentions"], found, strict=True) for m, s in zip(own, at, strict=True)]
        sizes = np.array([len(x) for x in found])
        rows = pa.RecordBatch.from_pylist(again, schema=pa.schema([*b.schema.field("_mentions").type.value_type, ("s", pa.int32())])) if again else None
        if rows is not None:
            owner = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(owner), b.column(1).take(owner), *rows.columns], names=["doc_id", "surface", "place", "lab", "s"])


def anchored_surfaces(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """mentions (doc_id, place, lab, surface) with s and e.

    The k-th mention of a surface in a document, by place, has its k-th occurrence.
    Later ones go round again: the first occurrence after the mention before that
    their label hasn't had, else the first it hasn't had; null where its label has
    had all. Mentions of documents that aren't among the texts, and empty surfaces, have none.
    """
    order = Window.partitionBy("doc_id", "surface").orderBy("place", "lab")
    numbered = mentions.withColumn("_k", F.row_number().over(order) - 1)
    # Occurrences are looked up once for each surface of a document.
    known = numbered.groupBy("doc_id", "surface").agg(F.count(F.lit(1)).alias("_n")).join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id")
    known = known.select("doc_id", "surface", "_n", exact_occurrences(F.col("_text"), F.col("surface")).alias("_at"))
    found = numbered.join(known, ["doc_id", "surface"], "left")
    over = (F.col("_n") > F.size("_at")) & (F.size("_at") > 0)
    first = found.where(~F.coalesce(over, F.lit(False))).withColumn("s", F.get("_at", F.col("_k"))).select(*mentions.columns, "s")
    # Of a surface that is mentioned more often than it stands there, all mentions are dealt out in order.
    groups = found.where(over).groupBy("doc_id", "surface").agg(F.first("_at").alias("_at"), F.sort_array(F.collect_list(F.struct("place", "lab"))).alias("_mentions"))
    kind = {f.name: f.dataType.simpleString() for f in mentions.schema}
    later = groups.mapInArrow(_occupied, f"doc_id {kind['doc_id']}, surface {kind['surface']}, place {kind['place']}, lab {kind['lab']}, s int")
    return first.unionByName(later).withColumn("e", F.col("s") + F.length("surface"))


def fuzzy_anchored(mentions: DataFrame, texts: DataFrame, *, least: float = 0.8) -> DataFrame:
    """doc_id, surface, s, e, ratio: for each surface of a document's mentions the window that is most like it; nulls where none is like enough, and for an empty or null surface or text.

    A text is indexed once for all surfaces of its document.
    """
    rows = mentions.groupBy("doc_id").agg(F.collect_set(F.coalesce("surface", F.lit(""))).alias("_surfaces")).join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                index, surfaces = TextIndex(b.column(2)[i].as_py() or ""), b.column(1)[i].as_py()
                found = [similar_window(index, x, least) or (None, None, None) for x in surfaces]
                s, e, ratio = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(found), b.schema.field(0).type), pa.array(surfaces, pa.string()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(ratio, pa.float64())], names=["doc_id", "surface", "s", "e", "ratio"])

    return rows.mapInArrow(run, f"doc_id {kind}, surface string, s int, e int, ratio double")


def anchored_entities(mentions: DataFrame, texts: DataFrame, *, least: float = 0.8) -> DataFrame:
    """mentions (doc_id, place, lab, surface) with s, e and how: exact, fuzzy (what no exact occurrence is left for) or unmapped; moved inwards past white space."""
    exact = anchored_surfaces(mentions, texts).withColumn("how", F.when(F.col("s").isNotNull(), "exact"))
    left = exact.where("s is null").drop("s", "e", "how")
    similar = fuzzy_anchored(left, texts, least=least).select("doc_id", F.col("surface"), "s", "e")
    again = left.join(similar, ["doc_id", "surface"], "left").withColumn("how", F.when(F.col("s").isNotNull(), "fuzzy").otherwise("unmapped"))
    found = exact.where("s is not null").unionByName(again).join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    low, high = clean_span(F.col("_text"), F.col("s"), F.col("e"))
    there = F.col("s").isNotNull()
    return found.withColumns({"s": F.when(there, low), "e": F.when(there, high)}).select(*mentions.columns, "s", "e", "how")


def anchored_tags(outputs: DataFrame, texts: DataFrame, labels: dict[str, str], *, window: int = 800) -> DataFrame:
    """doc_id, s, e, lab, how of the tags of outputs (doc_id, text), in the coordinates of the texts.

    Where an output less its tags is the text, spans stand where they stood (same). Else
    a span goes to where equal stretches around it are (near), and from there to the
    nearest place, at most window characters away, where its words stand exactly (refined);
    then inwards past white space. Equal spans come once, and what is empty then is left
    out, as are outputs without a text.
    """
    parsed = parsed_tags(outputs, labels).join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id").where("_text is not null")
    kind = parsed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc_id, clean, spans, text = (b.column(c)[i].as_py() for c in ("doc_id", "clean", "spans", "_text"))
                to = boundaries(clean, text) if spans else ()
                out = [(doc_id, text, clean[x["s"] : x["e"]], int(to[x["s"]]), int(to[x["e"]]), x["lab"]) for x in spans]
                for at in range(0, len(out), 100):
                    columns = zip(*out[at : at + 100], strict=True)
                    types = (b.schema.field("doc_id").type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "_text", "_words", "s", "e", "lab"])

    moved = parsed.where("clean <> _text").mapInArrow(run, f"doc_id {kind}, _text string, _words string, s int, e int, lab string")
    at = nearest_occurrence(F.col("_text"), F.col("_words"), F.col("s"), window)
    moved = moved.withColumn("_at", at).withColumns({"how": F.when(F.col("_at").isNotNull(), "refined").otherwise("near"), "e": F.coalesce(F.col("_at") + F.length("_words"), "e"), "s": F.coalesce("_at", "s")})
    same = parsed.where("clean = _text").select("doc_id", "_text", F.explode("spans").alias("_x")).select("doc_id", "_text", "_x.s", "_x.e", "_x.lab", F.lit("same").alias("how"))
    both = same.unionByName(moved.select("doc_id", "_text", "s", "e", "lab", "how"))
    low, high = clean_span(F.col("_text"), F.col("s"), F.col("e"))
    placed = both.select("doc_id", low.alias("s"), high.alias("e"), "lab", "how").where("s < e")
    return placed.groupBy("doc_id", "s", "e", "lab").agg(F.max("how").alias("how"))


def anchored_offsets(claims: DataFrame, texts: DataFrame, *, window: int = 800) -> DataFrame:
    """claims (doc_id, lab, s, surface) where the surface stands in the text: at s, else at the nearest place; those that it doesn't hold are left out, and equal spans come once."""
    rows = claims.join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id").where("surface <> '' and s is not null")
    there = F.substring("_text", F.greatest(F.col("s"), F.lit(0)) + 1, F.length("surface")) == F.col("surface")
    at = F.when(there & (F.col("s") >= 0), F.col("s")).otherwise(nearest_occurrence(F.col("_text"), F.col("surface"), F.col("s"), window))
    found = rows.withColumn("s", at).where("s is not null")
    return found.select("doc_id", "lab", "s", (F.col("s") + F.length("surface")).alias("e")).distinct()
