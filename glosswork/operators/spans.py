"""Operators on labelled spans (doc_id, s, e, lab): half-open, s < e."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.text import SPACE

#: Spans meet in buckets of so many characters: a document of very many spans is spread over its buckets.
BUCKET = 4096
#: Positions that are sorted together where documents may be giant: most are one stretch, a giant one is many.
STRETCH = 1 << 20
#: Spans of an island that a fold inside the JVM takes; its work grows with their square.
FOLDED = 48
Span = dict


def overlap_join(left: DataFrame, right: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """Each pair of overlapping spans of one document once: doc_id, s, e, lab, s2, e2, lab2, overlap."""
    cut = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket))).alias("_bucket")
    a = left.where("s < e").select("doc_id", "s", "e", "lab", cut("s", "e"))
    b = right.where("s < e").select("doc_id", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("lab").alias("lab2")).select("*", cut("s2", "e2"))
    start, end = F.greatest("s", "s2"), F.least("e", "e2")
    pairs = a.join(b, ["doc_id", "_bucket"]).where((start < end) & (F.floor(start / bucket) == F.col("_bucket")))
    return pairs.select("doc_id", "s", "e", "lab", "s2", "e2", "lab2", (end - start).alias("overlap"))


def containment_join(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """overlap_join with contained (inner lies in outer) against a mere crossing."""
    return overlap_join(inner, outer).withColumn("contained", (F.col("s") >= F.col("s2")) & (F.col("e") <= F.col("e2")))


def _in_stretches(spans: DataFrame, stretch: int) -> DataFrame:
    """spans with _stretch, _opens (whether an island begins) and _upto (how many have begun in the stretch).

    A span that reaches into later stretches stands in each of them once more, before
    the stretch's own spans, and is gone again at the end.
    """
    first = F.floor(F.col("s") / stretch).cast("long")
    last = F.floor((F.greatest(F.col("e"), F.col("s") + 1) - 1) / stretch).cast("long")
    each = spans.select("*", F.explode(F.sequence(first, last)).alias("_stretch")).withColumn("_own", F.col("_stretch") == first)
    order = Window.partitionBy("doc_id", "_stretch").orderBy("_own", "s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("_own") & (before.isNull() | (F.col("s") >= before)), 1).otherwise(0)
    opened = each.withColumn("_opens", opens).withColumn("_upto", F.sum("_opens").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return opened.where("_own").drop("_own")


def with_islands(spans: DataFrame, *, stretch: int | None = None) -> DataFrame:
    """spans with island: the number, in its document, of the cluster that chains of overlaps join.

    A document's spans are sorted by one task, unless stretch is given: then by
    stretches of so many positions, for corpora with giant documents. How many islands
    begin before a stretch is summed up from a row for each stretch. That costs a shuffle more.
    """
    if stretch is None:
        order = Window.partitionBy("doc_id").orderBy("s", "e")
        before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
        opened = spans.withColumn("_opens", F.when(before.isNull() | (F.col("s") >= before), 1).otherwise(0))
        return opened.withColumn("island", F.sum("_opens").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("_opens")
    opened = _in_stretches(spans, stretch)
    earlier = Window.partitionBy("doc_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = opened.groupBy("doc_id", "_stretch").agg(F.sum("_opens").alias("_n")).withColumn("_begun", F.sum("_n").over(earlier)).where("_begun is not null").select("doc_id", "_stretch", "_begun")
    numbered = opened.join(begun, ["doc_id", "_stretch"], "left")
    return numbered.withColumn("island", (F.coalesce("_begun", F.lit(0)) + F.col("_upto")).cast("int")).drop("_stretch", "_opens", "_upto", "_begun")


def kept_of_islands(groups: DataFrame, short: Column, keep: Callable[[list[Span]], Iterable[Span]], *, folded: int = FOLDED) -> DataFrame:
    """The columns of groups less _all, and _x: what is kept of each island's sorted spans (_all, structs). Short islands go by the fold short inside the JVM, longer ones by keep in Arrow batches."""
    keys = [c for c in groups.columns if c != "_all"]
    kind = groups.schema["_all"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found, one = list(keep(b.column("_all")[i].as_py())), b.slice(i, 1)
                for at in range(0, len(found), 10_000):
                    part = pa.array(found[at : at + 10_000], b.schema.field("_all").type.value_type)
                    owner = pa.array(np.zeros(len(part), np.int64))
                    yield pa.RecordBatch.from_arrays([*(one.column(k).take(owner) for k in keys), part], names=[*keys, "_x"])

    schema = StructType([*(groups.schema[k] for k in keys), StructField("_x", kind)])
    long = groups.where(F.size("_all") > folded).select(*keys, "_all").mapInArrow(run, schema)
    return groups.where(F.size("_all") <= folded).select(*keys, F.explode(short.cast(ArrayType(kind))).alias("_x")).unionByName(long)


def dedupe_longest(spans: DataFrame, *, stretch: int | None = None) -> DataFrame:
    """By start, the longest first: spans that begin before the last kept one ends go."""
    groups = with_islands(spans, stretch=stretch).groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("e")).alias("_e"), "lab"))).alias("_all"))
    kept = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.slice("_all", 1, 1), lambda acc, x: F.when(x["s"] >= -F.element_at(acc, -1)["_e"], F.array_append(acc, x)).otherwise(acc))
    return groups.select("doc_id", F.explode(kept).alias("_x")).select("doc_id", F.col("_x.s").alias("s"), (-F.col("_x._e")).alias("e"), F.col("_x.lab").alias("lab"))


def overlaps_nowhere(spans: DataFrame, *, stretch: int | None = None) -> DataFrame:
    """doc_id, disjoint: whether no two spans of the document overlap; stretch as in with_islands."""
    if stretch is not None:
        return _in_stretches(spans, stretch).groupBy("doc_id").agg((F.min("_opens") == 1).alias("disjoint"))
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    return spans.withColumn("_next", F.lead("s").over(order)).groupBy("doc_id").agg(F.bool_and(F.coalesce(F.col("_next") >= F.col("e"), F.lit(True))).alias("disjoint"))


def clean_span(text: Column, s: Column, e: Column) -> tuple[Column, Column]:
    """Start and end held within the text and moved inwards past white space."""
    low = F.least(F.greatest(s, F.lit(0)), F.length(text))
    high = F.greatest(F.least(e, F.length(text)), low)
    part = F.substring(text, low + 1, high - low)
    left = F.length(part) - F.length(F.regexp_replace(part, rf"^[{SPACE}]+", ""))
    right = F.length(part) - F.length(F.regexp_replace(part, rf"[{SPACE}]+\z", ""))
    return F.least(low + left, high), F.greatest(high - right, F.least(low + left, high))


class Apart:
    """Spans that don't overlap, in order."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, s: int, e: int) -> bool:
        """Takes the span if it overlaps none."""
        at = bisect_left(self.starts, s)
        if (at and self.ends[at - 1] > s) or (at < len(self.starts) and self.starts[at] < e):
            return False
        self.starts.insert(at, s)
        self.ends.insert(at, e)
        return True


def _longest_apart(spans: list[Span]) -> Iterator[Span]:
    apart = Apart()
    return (x for x in spans if apart.add(x["s"], x["e"]))


def longest_first(spans: DataFrame, *, stretch: int | None = None) -> DataFrame:
    """The longest spans first, then by start and label: each that overlaps none that was kept before. Spans hold something (s < e)."""
    groups = with_islands(spans, stretch=stretch).groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct((F.col("s") - F.col("e")).alias("_n"), "s", "e", "lab"))).alias("_all"))
    free = lambda acc, x: ~F.exists(acc, lambda k: (k["s"] < x["e"]) & (x["s"] < k["e"]))
    kept = F.aggregate(F.slice("_all", F.lit(2), F.size("_all")), F.slice("_all", 1, 1), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return kept_of_islands(groups, kept, _longest_apart).select("doc_id", "_x.s", "_x.e", "_x.lab")
