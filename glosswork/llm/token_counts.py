"""Token counts with overlap resynchronisation for huge documents.

A document above ``huge_chars`` is cut into overlapping chunks that are encoded
with offsets, each in any task. Neighbours are spliced at a position inside
their overlap where both have a token boundary and which is *proven stable*:
the characters around it are such that the tokenizer's pattern parts there in
every context (a non-space before white space). From a boundary of the left
chunk on, the right chunk's tokens depend on the text to their right alone, so
they are those of the whole text. Where an overlap holds no such position, the
document is encoded again with wider overlaps, in the end as one chunk.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows and
null or repeated ids give a row each; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, encoded, record, slices
from .tokens import STABLE, Encoder, load

#: Characters at a chunk's end in which a special string or a look-ahead may still be open.
GUARD = 64

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int64())])
_COUNTS_DDL = "doc_id long, n_bytes long, n_tokens long, n_chunks long"
_CHUNKS = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("chunk", pa.string())])
_CHUNKS_DDL = "_row long, doc_id long, n_bytes long, start long, last boolean, chunk string"
_MARKS = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("start", pa.int64()), ("last", pa.bool_()), ("total", pa.int64()), ("left_at", pa.list_(pa.int64())), ("left_n", pa.list_(pa.int64())), ("right_at", pa.list_(pa.int64())), ("right_n", pa.list_(pa.int64()))])
_MARKS_DDL = "_row long, doc_id long, n_bytes long, start long, last boolean, total long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in slices(batches, 1):
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield record(_COUNTS, b.column(0), [len(x) for x in encoded(b, 1)], [encoder.count(x) for x in texts], [1] * len(texts))

    return run


def _cut(step: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size, starts = len(text.encode()), range(0, max(1, len(text) - overlap), step)
                for part in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    yield record(_CHUNKS, [row] * len(part), [doc_id] * len(part), [size] * len(part), list(part), [s == starts[-1] for s in part], [text[s:] if s == starts[-1] else text[s : s + step + overlap] for s in part])

    return run


def _marks(path: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in slices(batches, 5, 200_000):
            rows = b.to_pylist()
            out: list[list] = [[] for _ in range(5)]
            for x, code in zip(rows, tokenizer.encode_batch([r["chunk"] for r in rows], add_special_tokens=False), strict=True):
                chunk, start = x["chunk"], x["start"]
                stable = {m.end() for m in STABLE.finditer(chunk, 0, overlap + 1)} if start else set()
                stable |= set() if x["last"] else {m.end() for m in STABLE.finditer(chunk, max(0, len(chunk) - overlap - 1))}
                ends = [(e, i + 1) for i, (_, e) in enumerate(code.offsets) if e in stable]
                sides = ([p for p in ends if start and p[0] <= overlap], [] if x["last"] else [p for p in ends if len(chunk) - overlap <= p[0] <= len(chunk) - GUARD])
                # A character of several tokens has its end at each: the last count is that of the boundary.
                sides = tuple(list({e: n for e, n in side}.items()) for side in sides)
                out[0].append(len(code.ids))
                for k, side in enumerate(sides):
                    out[1 + 2 * k].append([start + e for e, _ in side])
                    out[2 + 2 * k].append([n for _, n in side])
            yield record(_MARKS, *(b.column(i) for i in range(5)), *out)

    return run


def _spliced(docs: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """(_row, doc_id, n_bytes, n_tokens, n_chunks); n_tokens is null where some overlap had no common boundary."""
    chunks = docs.mapInArrow(_cut(step, overlap), _CHUNKS_DDL).repartition("_row", "start")
    order = Window.partitionBy("_row").orderBy("start")
    marks = chunks.mapInArrow(_marks(path, overlap), _MARKS_DDL).withColumns({"_next_at": F.lead("left_at").over(order), "_next_n": F.lead("left_n").over(order)})
    at = F.element_at(F.array_intersect("right_at", "_next_at"), 1)
    upto = lambda places, counts: F.try_element_at(counts, F.array_position(places, F.col("_at")).cast("int"))
    marks = marks.withColumn("_at", F.when(F.size(F.array_intersect("right_at", "_next_at")) > 0, at))
    marks = marks.withColumn("_n", F.when(F.col("last"), F.col("total")).otherwise(F.when(F.col("_at").isNotNull(), upto(F.col("right_at"), F.col("right_n")) - upto(F.col("_next_at"), F.col("_next_n")))))
    return marks.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
        F.when(F.count("_n") == F.count(F.lit(1)), F.sum("_n")).alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks"),
    )


def count_tokens(df: DataFrame, tokenizer: str, *, text: str = "text", huge_chars: int = 32_768, step: int = 16_384, overlap: int = 512, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks for each row of df (doc_id, text)."""
    if step < 2 * overlap or overlap <= 2 * GUARD:
        raise ValueError("an overlap must exceed twice the guard and fit twice into a step")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    counted = rows.where(size <= huge_chars).mapInArrow(_whole(tokenizer), _COUNTS_DDL)
    huge = rows.where(size > huge_chars).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    left, parts, longest = huge, [], None
    while True:
        done = checkpointed(_spliced(left, tokenizer, step, overlap))
        parts.append(done.where(F.col("n_tokens").isNotNull()))
        failed = done.where(F.col("n_tokens").isNull()).select("_row")
        if failed.isEmpty():
            break
        if longest is None:
            longest = huge.agg(F.max(F.length("text"))).first()[0]
        left = huge.join(failed, "_row", "left_semi").select("_row", "doc_id", "text")
        overlap, step = min(8 * overlap, longest + 1), min(16 * step, 2 * (longest + 1))
    for part in parts:
        counted = counted.unionByName(part.select("doc_id", "n_bytes", "n_tokens", "n_chunks"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
