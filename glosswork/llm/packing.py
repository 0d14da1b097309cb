"""Best-fit packing of documents into sequences of a fixed capacity.

A document is its token ids and a closing id. One longer than the capacity is
cut into full pieces and a first piece that holds the rest, so each document
brings at most one piece that is not full; full pieces are sequences as they
are. Where the others go hangs only on how many there are of each length, at
most the capacity's number of counts: documents of a length are alike but for
their rank. So documents are sorted into ranges by Spark, which number them by
length, and the counts of each range and length give the ranks' offsets. The
sweep from the longest length to the shortest works on counts: a length gets the
smallest gaps it fits by rank, those beyond the gaps' number go on to the next
larger gaps or open sequences, and filled gaps return with their new size.
Its outcome are runs of ranks, few as the lengths are, which are broadcast; each
document finds its own by length and rank. It is the packing of one best fit
over all documents, in whatever ranges they lie; equal rows are spread out too.

Defined results: null or empty text is the closing id alone; repeated rows and
ids are packed one by one; a null id stays null; other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record, slices, written
from .tokens import Encoder

CAPACITY, CLOSING_ID, SHARD_DOCS = 2048, 0, 65_536
_CUT = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("crcs", pa.list_(pa.int64()))])
_RANKED = pa.schema([*_CUT, ("first", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("full_at", pa.int64())])
_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PACKED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each length (1 to capacity), and the number of sequences."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: dict[int, np.ndarray] = {}  # free places -> the sequences that have them
    sizes: list[int] = []  # of gaps, ascending
    opened = 0

    def keep(free: int, which: np.ndarray) -> None:
        if free and len(which):
            if free in gaps:
                gaps[free] = np.concatenate([gaps[free], which])
            else:
                gaps[free] = which
                insort(sizes, free)

    order = np.argsort(-lengths, kind="stable")
    values, starts = np.unique(-lengths[order], return_index=True)
    for value, rows in zip(-values, np.split(order, starts[1:]), strict=True):
        size = int(value)
        while len(rows):
            at = bisect_left(sizes, size)
            if at == len(sizes):  # no gap is left for this size
                each = capacity // size
                count = -(-len(rows) // each)
                rank = np.arange(len(rows))
                sequence[rows], offset[rows] = opened + rank // each, rank % each * size
                full, rest = divmod(len(rows), each)
                keep(capacity - each * size, opened + np.arange(full))
                if rest:
                    keep(capacity - rest * size, np.array([opened + full]))
                opened += count
                break
            free = sizes[at]
            which = gaps[free]
            taken = which[: len(rows)]
            now, rows = rows[: len(taken)], rows[len(taken) :]
            sequence[now], offset[now] = taken, capacity - free
            if len(taken) == len(which):
                del gaps[free]
                sizes.pop(at)
            else:
                gaps[free] = which[len(taken) :]
            keep(free - size, taken)
    return sequence, offset, opened


def fit_counts(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """``best_fit`` of so many of each length: runs of ranks (length, first rank, first sequence, pieces in a sequence, offset), and the number of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, deque[tuple[int, int]]] = {}  # free places -> runs of sequences (first, number) that have them
    sizes: list[int] = []  # of gaps, ascending
    opened = 0

    def keep(free: int, first: int, number: int) -> None:
        if free and number:
            if free not in gaps:
                gaps[free] = deque()
                insort(sizes, free)
            gaps[free].append((first, number))

    for size, count in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        rank = 0
        while rank < count:
            at = bisect_left(sizes, size)
            if at == len(sizes):  # no gap is left for this size
                each = capacity // size
                runs.append((size, rank, opened, each, 0))
                full, rest = divmod(count - rank, each)
                keep(capacity - each * size, opened, full)
                keep(capacity - rest * size, opened + full, int(rest > 0))
                opened += full + (rest > 0)
                break
            free = sizes[at]
            first, number = gaps[free].popleft()
            taken = min(number, count - rank)
            if taken < number:
                gaps[free].appendleft((first + taken, number - taken))
            elif not gaps[free]:
                del gaps[free]
                sizes.pop(at)
            runs.append((size, rank, first, 1, capacity - free))
            rank += taken
            keep(free - size, first, taken)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), opened


def _cut(path: str, capacity: int):
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in slices(batches, 1):
            sizes, crcs = [], []
            for text in b.column(1).to_pylist():
                ids = encoder.ids(text or "").astype("<u4").tobytes() + closing
                n = len(ids) // 4
                first = 4 * (n % capacity or capacity)
                ends = range(first, len(ids) + 1, 4 * capacity)
                view = memoryview(ids)
                sizes.append(n)
                crcs.append([zlib.crc32(view[(e - 4 * capacity if e > first else 0) : e]) for e in ends])
            yield record(_CUT, b.column(0), sizes, crcs)

    return run


def _rank(capacity: int):
    """Numbers the rows (doc_id, n_ids, crcs, first; in order of first) of a range by length, and their full pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, full = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            values, starts, sizes = np.unique(b.column(3).to_numpy(), return_index=True, return_counts=True)
            at = np.arange(b.num_rows) - np.repeat(starts, sizes)
            if values[0] == last:
                at[: sizes[0]] += seen
            last, seen = values[-1], at[-1] + 1
            later = (b.column(1).to_numpy() - 1) // capacity
            yield record(_RANKED, *b.columns, np.full(b.num_rows, part), at, full + np.cumsum(later) - later)
            full += int(later.sum())

    return run


def _place(shared, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, opened, ranges, before, full_before = shared.value
        keys = runs[:, 0] << 44 | runs[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            n, first, part, at, full_at = (b.column(c).to_numpy() for c in ("n_ids", "first", "part", "at", "full_at"))
            rank = before[np.searchsorted(ranges, part * (capacity + 1) + first)] + at
            hit = runs[np.searchsorted(keys, first << 44 | rank, side="right") - 1]
            sequence, offset = hit[:, 2] + (rank - hit[:, 1]) // hit[:, 3], hit[:, 4] + (rank - hit[:, 1]) % hit[:, 3] * first
            pieces = (n - 1) // capacity + 1
            owner = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            later, full = piece > 0, opened + full_before[part] + full_at
            yield record(
                _PACKED, b.column("doc_id").take(pa.array(owner)), piece, np.where(later, first[owner] + (piece - 1) * capacity, 0), np.where(later, capacity, first[owner]),
                b.column("crcs").flatten(), np.where(later, full[owner] + piece - 1, sequence[owner]), np.where(later, 0, offset[owner]),
            )

    return run


def pack_documents(df: DataFrame, tokenizer: str, *, text: str = "text", capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of df (doc_id, text); a range has about shard_docs rows."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = written(rows.mapInArrow(_cut(tokenizer, capacity), "doc_id long, n_ids long, crcs array<long>"))
    ranges = max(1, -(-cut.count() // shard_docs))
    # Equal rows are interchangeable: a number of their own spreads them over ranges.
    order = ["first", "n_ids", "doc_id", "_crcs", "_own"]
    keyed = cut.withColumn("first", (F.col("n_ids") - 1) % capacity + 1).withColumn("_crcs", F.xxhash64("crcs")).withColumn("_own", F.monotonically_increasing_id())
    in_ranges = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "n_ids", "crcs", "first")
    ranked = written(in_ranges.mapInArrow(_rank(capacity), "doc_id long, n_ids long, crcs array<long>, first long, part long, at long, full_at long"))
    full = F.sum(F.expr(f"(n_ids - 1) div {capacity}")).alias("full")
    found = ranked.groupBy("part", "first").agg(F.count(F.lit(1)).alias("c"), full).orderBy("part", "first").toPandas()
    part, first, count = (found[c].to_numpy(np.int64) for c in ("part", "first", "c"))
    before = found.groupby("first")["c"].cumsum().to_numpy(np.int64) - count
    lengths, back = np.unique(first, return_inverse=True)
    runs, opened = fit_counts(lengths, np.bincount(back, count, len(lengths)).astype(np.int64), capacity)
    full_of = np.bincount(part, found["full"].to_numpy(np.int64)).astype(np.int64)
    shared = df.sparkSession.sparkContext.broadcast((runs, opened, part * (capacity + 1) + first, before, np.cumsum(full_of) - full_of))
    return ranked.mapInArrow(_place(shared, capacity), _PACKED_DDL)
