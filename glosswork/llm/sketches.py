"""Count-min sketches of 64-bit keys, made by partition and merged by ranges of counters.

A partition sends, for each row of the sketch and each range of counters, the
counters it has raised, sorted, as compressed differences, and how often. Tasks
read these range by range and hold one range's counters at a time, however many
partitions sent them. What goes to the driver is a bit for each counter (has it
been raised twice?), two bits (its level: once or never, up to 3, up to 31, more)
or a byte (how often, as a power of two): a size set by the sketch's width, never
by the keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record
from .hashing import mix

_BLOBS = pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("counters", pa.binary()), ("amounts", pa.binary())])
_BLOBS_DDL = "row int, shard int, counters binary, amounts binary"
_MERGED = pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("data", pa.binary())])
_SALTS = (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5, 0x4B33A62ED433D4A3)
#: Keys that a partition gathers before it sends them on.
FLUSH_KEYS = 1_000_000
#: Least count of each level beyond the first.
LEVELS = (2, 4, 32)


def counters(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(_SALTS[row])) & np.uint64(width - 1)).astype(np.int64)


def _blobs(keys: np.ndarray, rows: int, width: int, shards: int) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[], [], [], []]
    for row in range(rows):
        found, times = np.unique(counters(keys, row, width), return_counts=True)
        times = np.minimum(times, 2**32 - 1).astype("<u4")
        cuts = np.searchsorted(found, np.arange(shards + 1) * (width // shards))
        for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                steps = np.diff(found[a:b], prepend=shard * (width // shards)).astype("<u4")  # from the range's start
                for column, x in zip(out, (row, shard, zlib.compress(steps.tobytes(), 1), zlib.compress(times[a:b].tobytes(), 1)), strict=True):
                    column.append(x)
    yield record(_BLOBS, *out)


def sketch(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], *, rows: int, width: int, powers: bool = False, levels: bool = False) -> list[np.ndarray]:
    """The merged sketch over the keys of df's batches: for each row, counters raised twice or more as bits, or (levels) each counter's level as two bits, or (powers) its bit length as bytes.

    width: a power of two, 8 at least.
    """
    shards = min(512, max(1, width >> 16))
    part = width // shards

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(keys(b))
            n += len(held[-1])
            if n >= FLUSH_KEYS:
                yield from _blobs(np.concatenate(held), rows, width, shards)
                held, n = [], 0
        if n:
            yield from _blobs(np.concatenate(held), rows, width, shards)

    def packed(total: np.ndarray) -> bytes:
        if powers:
            bits = np.zeros(part, np.uint8)
            some = total > 0
            bits[some] = np.floor(np.log2(total[some].astype(float))).astype(np.uint8) + 1
            return bits.tobytes()
        if levels:
            x = sum((total >= least).astype(np.uint8) for least in LEVELS).reshape(-1, 4)
            return (x[:, 0] | x[:, 1] << 2 | x[:, 2] << 4 | x[:, 3] << 6).tobytes()
        return np.packbits(total >= 2, bitorder="little").tobytes()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(part, np.uint64), None
        for b in batches:
            for row, shard, steps, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != (row, shard):
                    if own:
                        yield record(_MERGED, [own[0]], [own[1]], [zlib.compress(packed(total), 1)])
                    own = (row, shard)
                    total[:] = 0
                at = np.cumsum(np.frombuffer(zlib.decompress(steps), "<u4"), dtype=np.int64)
                total[at] += np.frombuffer(zlib.decompress(times), "<u4")
        if own:
            yield record(_MERGED, [own[0]], [own[1]], [zlib.compress(packed(total), 1)])

    blobs = df.mapInArrow(gather, _BLOBS_DDL).repartition("row", "shard").sortWithinPartitions("row", "shard")
    merged = blobs.mapInArrow(merge, "row int, shard int, data binary")
    size = part if powers else part // 4 if levels else part // 8
    out = [np.zeros(size * shards, np.uint8) for _ in range(rows)]
    for row, shard, data in merged.collect():
        out[row][shard * size : (shard + 1) * size] = np.frombuffer(zlib.decompress(bytes(data)), np.uint8)
    return out


def level_of(packed: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """The level of each key's counter; 0 only for a key that was added once at most."""
    at = counters(keys, 0, width)
    return packed[at >> 2] >> ((at & 3) << 1).astype(np.uint8) & 3


def repeated(bits: list[np.ndarray], keys: np.ndarray, width: int) -> np.ndarray:
    """Whether each key's count may be two or more: never False for a key that was added twice."""
    out = np.ones(len(keys), bool)
    for row, held in enumerate(bits):
        at = counters(keys, row, width)
        out &= (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out
