"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Texts are lower-cased (A-Z) and split into words of ASCII letters, digits and
non-ASCII characters. Each benchmark item gives its windows of n words, a
shorter one itself as one window. A task numbers the words of a document by the
benchmark's vocabulary, looks up rolling hashes of its windows in the broadcast
set, verifies each hit word by word and marks the words that it covers.

The broadcast set is checked: above ``max_words`` benchmark words the items are
dealt by a hash of their ids into parts of about so many, and each part is read,
broadcast, scanned for and let go before the next; a document's hits are merged.
Windows are looked for in the text as it came, whichever part finds them. Defined
results: null text has no words and no hits; null or wordless items match
nothing; repeated rows give a row each; repeated items count by their distinct
item_id; other columns are left out by ``find_contamination`` and kept, whatever
their names, by ``remove_contamination``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, record, slices, written

#: Lower-cases A-Z and blanks every other ASCII character that is no digit or lower-case letter.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
_HITS_DDL = "doc_id long, n_words long, hit array<int>, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many codes."""
    h = np.zeros(len(codes) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * _BASE + codes[k : len(codes) - size + 1 + k]
    return h


class NgramSet:
    """The windows of the benchmark items: by size, sorted hashes, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            codes = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            size = min(n, len(codes))
            for at in range(len(codes) - size + 1 if size else 0):
                self.items[codes[at : at + size]].add(item_id)
        by_size = defaultdict(list)
        for window in self.items:
            by_size[len(window)].append(window)
        self.hashes = {size: np.unique(_rolled(np.array(found, np.uint64).ravel(), size)[::size]) for size, found in by_size.items()}

    def find(self, text: list[bytes]) -> tuple[list[int], set[str]]:
        """Positions of the words inside a window, ascending, and the items found."""
        get = self.vocabulary.get
        codes = np.fromiter((get(w, 0) for w in text), np.uint64, len(text))
        hit, items = np.zeros(len(text) + 1, np.int64), set()
        for size, hashes in self.hashes.items():
            if len(text) < size:
                continue
            found = _rolled(codes, size)
            at = np.searchsorted(hashes, found)
            at[at == len(hashes)] = 0
            for p in np.nonzero(hashes[at] == found)[0]:
                owners = self.items.get(tuple(codes[p : p + size].tolist()))
                if owners:
                    items |= owners
                    hit[p] += 1
                    hit[p + size] -= 1
        return np.nonzero(np.cumsum(hit[:-1]))[0].tolist(), items


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = shared.value
        for b in slices(batches, 1):
            counts, hits, items = [], [], []
            for text in encoded(b, 1):
                found = words(text)
                hit, owners = ngrams.find(found)
                counts.append(len(found))
                hits.append(hit)
                items.append(sorted(owners))
            yield record(_HITS, b.column(0), counts, hits, items)

    return run


def _without(text: bytes, hit: set[int]) -> str:
    """The text less its hit words and what stands between two of them."""
    plain, keep, number, at = text.translate(_NORMAL), [], 0, 0
    start, last_hit = 0, False
    for word in plain.split():
        begin = plain.index(word, at)
        at = begin + len(word)
        if number in hit:
            if not last_hit:
                keep.append(text[start:begin])
            start, last_hit = at, True
        else:
            last_hit = False
        number += 1
    return (b"".join(keep) + text[start:]).decode()


def benchmark_parts(benchmark: DataFrame, max_words: int) -> list[DataFrame]:
    """(item_id, text) of the items, in parts of about max_words words; an item lies in one part."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = rows.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    parts = max(1, -(-total // max_words))
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) for i in range(parts)]


def _shared(part: DataFrame, n: int):
    """The windows of a part's items, which are about max_words words, broadcast."""
    return part.sparkSession.sparkContext.broadcast(NgramSet([(item_id, text.encode()) for item_id, text in part.collect()], n))


def _hits(rows: DataFrame, parts: list[DataFrame], n: int) -> DataFrame:
    """_row, n_words, hit, items of rows (_row, text), over all parts, one after the other."""
    found = []
    for part in parts:
        shared = _shared(part, n)
        found.append(written(rows.select(F.col("_row").alias("doc_id"), "text").mapInArrow(_scan(shared), _HITS_DDL)))
        shared.unpersist()
    merged = found[0]
    for one in found[1:]:
        merged = merged.unionByName(one)
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return merged.groupBy(F.col("doc_id").alias("_row")).agg(F.first("n_words").alias("n_words"), flat("hit"), flat("items"))


def find_contamination(df: DataFrame, benchmark: DataFrame, *, text: str = "text", n: int = 10, max_words: int = 500_000) -> DataFrame:
    """doc_id, n_words, hit (word positions), items (sorted ids) for each row of df."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = benchmark_parts(benchmark, max_words)
    if len(parts) == 1:
        return rows.mapInArrow(_scan(_shared(parts[0], n)), _HITS_DDL)
    # Written first: a number that a lost task gave again might be another.
    keyed = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    return keyed.select("_row", "doc_id").join(_hits(keyed, parts, n), "_row").select("doc_id", "n_words", "hit", "items")


def _removed(at: int, width: int, hits_of):
    """The first width columns with the hit words taken out of column number at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            hits = hits_of(b)
            out = [_without(x, set(hit)) if hit else raw for raw, x, hit in zip(b.column(at).to_pylist(), encoded(b, at), hits, strict=True)]
            columns = [pa.array(out, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns[:width])]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:width])

    return run


def remove_contamination(df: DataFrame, benchmark: DataFrame, *, text: str = "text", n: int = 10, max_words: int = 500_000) -> DataFrame:
    """df, whatever its columns' names, with every word inside a benchmark window taken out of the text; each row stays."""
    at, width = df.columns.index(text), len(df.columns)
    plain = df.toDF(*(f"c{i}" for i in range(width)))
    parts = benchmark_parts(benchmark, max_words)
    if len(parts) == 1:
        shared = _shared(parts[0], n)
        return plain.mapInArrow(_removed(at, width, lambda b: [shared.value.find(words(x))[0] for x in encoded(b, at)]), plain.schema).toDF(*df.columns)
    keyed = written(plain.withColumn("_row", F.monotonically_increasing_id()))
    hits = _hits(keyed.select("_row", F.col(f"c{at}").alias("text")), parts, n).select("_row", "hit")
    joined = keyed.join(hits, "_row", "left").select(*plain.columns, "hit")
    return joined.mapInArrow(_removed(at, width, lambda b: b.column(width).to_pylist()), plain.schema).toDF(*df.columns)
