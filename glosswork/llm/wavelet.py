"""Wavelet matrices: one compressed file of token ids that answers without being unpacked.

A shard's ids lie in bit planes, the highest bit first. Behind each plane the ids
are parted by its bit, zeros before ones, each in their order; so a position goes
down by ``rank`` (how many equal bits come before it) and comes up by ``select``
(where the k-th such bit is). An id is read off one bit a plane; an id's count is the
width of its run behind the last plane; its occurrences are that run's positions
brought up. Planes are held in blocks, each a zstd frame by itself; the directory
at the end of the file says where each begins and how many ones come before it, so
that an answer opens one block or two in each plane. A table of the shard's
documents, or the pieces of them, is one more frame.

    magic | blocks of the planes | documents (Arrow) | directory (JSON) | its length (8 bytes)
"""

from __future__ import annotations

import io
import json
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard

MAGIC, BLOCK_BITS, HELD_BLOCKS = b"GWTOKENS1", 1 << 19, 256


def build(ids: np.ndarray, bits: int, documents: pa.RecordBatch) -> bytes:
    """The file of ids below 2**bits."""
    packer, out = zstandard.ZstdCompressor(level=3), io.BytesIO()
    out.write(MAGIC)

    def frame(data: bytes) -> list[int]:
        packed = packer.compress(data)
        out.write(packed)
        return [out.tell() - len(packed), len(packed)]

    planes, left = [], ids
    for level in range(bits):
        ones = (left >> left.dtype.type(bits - 1 - level)) & 1 > 0
        packed = np.packbits(ones, bitorder="little")
        blocks = [packed[i : i + BLOCK_BITS // 8] for i in range(0, len(packed), BLOCK_BITS // 8)]
        before = np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in blocks)])
        planes.append({"zeros": len(left) - int(before[-1]), "ones_before": before.tolist(), "blocks": [frame(b.tobytes()) for b in blocks]})
        left = np.concatenate([left[~ones], left[ones]])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema) as stream:
        stream.write_batch(documents)
    head = json.dumps({"n": len(ids), "bits": bits, "planes": planes, "documents": frame(sink.getvalue())}).encode()
    out.write(head + len(head).to_bytes(8, "little"))
    return out.getvalue()


class Plane:
    """One plane's bits, block by block."""

    def __init__(self, shard: Shard, level: int, head: dict):
        self.shard, self.level, self.zeros, self.blocks = shard, level, head["zeros"], head["blocks"]
        self.before = np.array(head["ones_before"], np.int64)

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of 64 bits, and the ones before each in the block."""
        return self.shard.block(self.level, k, self.blocks[k])

    def bits(self) -> np.ndarray:
        words = np.concatenate([self.block(k)[0] for k in range(len(self.blocks))]) if self.blocks else np.empty(0, np.uint64)
        return np.unpackbits(words.view(np.uint8), count=self.shard.n, bitorder="little").view(bool)

    def _by_block(self, blocks: np.ndarray, answer) -> np.ndarray:
        out = np.empty(len(blocks), np.int64)
        for k in np.unique(blocks):
            at = np.flatnonzero(blocks == k)
            out[at] = answer(at, int(k))
        return out

    def get(self, positions: np.ndarray) -> np.ndarray:
        def answer(at: np.ndarray, k: int) -> np.ndarray:
            inside = (positions[at] - k * BLOCK_BITS).astype(np.uint64)
            return (self.block(k)[0][inside >> np.uint64(6)] >> (inside & np.uint64(63))) & np.uint64(1)

        return self._by_block(positions // BLOCK_BITS, answer)

    def ones(self, positions: np.ndarray) -> np.ndarray:
        """rank: the ones before each position, which may be the plane's end."""

        def answer(at: np.ndarray, k: int) -> np.ndarray:
            words, sums = self.block(k)
            inside = (positions[at] - k * BLOCK_BITS).astype(np.uint64)
            word, rest = inside >> np.uint64(6), inside & np.uint64(63)
            # The plane's end may be the end of its last word: no bit of a next one counts.
            low = np.append(words, np.uint64(0))[word] & ((np.uint64(1) << rest) - np.uint64(1))
            return self.before[k] + sums[word] + np.bitwise_count(low)

        return self._by_block(np.minimum(positions // BLOCK_BITS, max(0, len(self.blocks) - 1)), answer) if self.blocks else np.zeros(len(positions), np.int64)

    def select(self, bit: int, ranks: np.ndarray) -> np.ndarray:
        """The position of the rank-th (from 0) such bit."""
        starts = np.minimum(np.arange(len(self.before)) * BLOCK_BITS, self.shard.n)
        before = self.before if bit else starts - self.before

        def answer(at: np.ndarray, k: int) -> np.ndarray:
            words, sums = self.block(k)
            sums = sums if bit else np.arange(len(sums)) * 64 - sums
            inside = ranks[at] - before[k]
            word = np.searchsorted(sums, inside, side="right") - 1
            # The bit within its word: halves that hold too few such bits are passed over.
            left, rest, place = words[word] if bit else ~words[word], inside - sums[word], np.zeros(len(at), np.int64)
            for width in (32, 16, 8, 4, 2, 1):
                low = np.bitwise_count(left & np.uint64((1 << width) - 1)).astype(np.int64)
                over = rest >= low
                rest, place, left = rest - low * over, place + width * over, np.where(over, left >> np.uint64(width), left)
            return k * BLOCK_BITS + word * 64 + place

        return self._by_block(np.searchsorted(before, ranks, side="right") - 1, answer)


class Shard:
    """The file read at random places: only the directory is held, and the blocks used last."""

    def __init__(self, file, held: int = HELD_BLOCKS):
        self.file, self.held, self._blocks = file, held, OrderedDict()
        size = file.seek(0, 2)
        head = json.loads(self._at(size - 8 - (length := int.from_bytes(self._at(size - 8, 8), "little")), length))
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids")
        self.n, self.width, self._documents = head["n"], head["bits"], head["documents"]
        self.planes = [Plane(self, level, x) for level, x in enumerate(head["planes"])]

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def block(self, level: int, k: int, place: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if (level, k) in self._blocks:
            self._blocks.move_to_end((level, k))
            return self._blocks[level, k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(*place))
        words = np.frombuffer(raw + bytes(-len(raw) % 8), np.uint64)
        found = self._blocks[level, k] = words, np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        if len(self._blocks) > self.held:
            self._blocks.popitem(last=False)
        return found

    def documents(self) -> pa.RecordBatch:
        raw = zstandard.ZstdDecompressor().decompress(self._at(*self._documents))
        return pa.ipc.open_stream(raw).read_next_batch()

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up: each plane puts zeros and ones back among each other."""
        values = np.zeros(self.n, np.uint32)
        for plane in reversed(self.planes):
            ones, out = plane.bits(), np.empty(self.n, np.uint32)
            out[~ones], out[ones] = values[: plane.zeros], values[plane.zeros :] | np.uint32(1 << (self.width - 1 - plane.level))
            values = out
        return values

    def access(self, positions: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at, values = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        for plane in self.planes:
            bit, ones = plane.get(at), plane.ones(at)
            at, values = np.where(bit, plane.zeros + ones, at - ones), values << 1 | bit
        return values

    def run(self, token: int, start: int = 0, stop: int | None = None) -> tuple[int, int]:
        """Where the id's occurrences between two positions lie behind the last plane."""
        ends = np.array([start, self.n if stop is None else stop], np.int64)
        if token < 0 or token >> self.width:
            return 0, 0
        for plane in self.planes:
            ones = plane.ones(ends)
            ends = plane.zeros + ones if token >> (self.width - 1 - plane.level) & 1 else ends - ones
            if ends[0] >= ends[1]:
                return 0, 0
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        first, last = self.run(token, start, stop)
        return last - first

    def occurrences(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Positions of the id, ascending."""
        at = np.arange(*self.run(token, start, stop), dtype=np.int64)
        for plane in reversed(self.planes) if len(at) else ():
            bit = token >> (self.width - 1 - plane.level) & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at
