"""Functions of SQL that give rows: FROM documents, LATERAL sliding_chunks(text, 900, 150)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class SlidingChunks:
    """chunk, s, e, text of the overlapping chunks of a text; no rows for null and empty texts."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        from glosswork.operators.chunking import chunk_bounds

        if not 0 <= overlap < size // 2:
            raise ValueError("an overlap must be less than half a chunk")
        for number, (s, e) in enumerate(chunk_bounds(text or "", size, overlap)):
            yield number, s, e, text[s:e]


class ParseInlineTags:
    """clean, s, e, lab, warnings of each closed tag of a text; labels by tag (upper case). A text without such a tag is one row without a span."""

    def __init__(self):
        self._patterns: dict[tuple, re.Pattern] = {}

    def eval(self, text: str, labels: dict) -> Iterator[tuple]:
        from glosswork.operators.anchoring import parse_tags, tag_pattern

        key = tuple(sorted(labels))
        if key not in self._patterns:
            self._patterns[key] = tag_pattern(key)
        clean, spans, warnings = parse_tags(text or "", self._patterns[key], labels)
        for x in spans or [{"s": None, "e": None, "lab": None}]:
            yield clean, x["s"], x["e"], x["lab"], warnings


def register_tables(spark: SparkSession) -> None:
    """Makes sliding_chunks(text, size, overlap) and parse_inline_tags(text, labels) functions of SQL."""
    spark.udtf.register("sliding_chunks", udtf(SlidingChunks, returnType="chunk int, s int, e int, text string"))
    spark.udtf.register("parse_inline_tags", udtf(ParseInlineTags, returnType="clean string, s int, e int, lab string, warnings array<string>"))
