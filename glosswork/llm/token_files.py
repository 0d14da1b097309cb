"""Documents as token ids in files, one wavelet matrix a shard, in ascending order of ids.

Texts are range-sorted by document id, encoded, and written by each task as shards
of ``shard_tokens`` ids: where a shard is full the next one begins, be it amid a
document, so no text is too long. A task's files have names of their own, and the
manifest lists those of the tasks that came through: what a lost executor left behind is
never read. Tasks' numbers of ids, summed up in order, place each shard among all
ids. Documents are read back shard by shard; the checksum of one that lies in
several shards is put together from those of its pieces.

Files lie in a folder that all executors share, which pyarrow's file systems reach.

Defined results: null or empty text is the end id alone; null ids come first, rows of
an equal id by their text's hash; repeated rows are written one by one; no rows give no
files; other columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoded, new_folder, record, slices, written
from .wavelet import Shard, build
from .word_tokens import word_encoder

END_ID, SHARD_TOKENS = 2, 1 << 22
_MANIFEST = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("n_tokens", pa.int64()), ("n_pieces", pa.int64()), ("n_bytes", pa.int64())])
_MANIFEST_DDL = "part long, number long, file string, n_tokens long, n_pieces long, n_bytes long"
_FOUND = pa.schema([("token", pa.int64()), ("position", pa.int64())])
_COUNTED = pa.schema([("token", pa.int64()), ("n", pa.int64())])


def place(name: str) -> tuple[FileSystem, str]:
    """The file system and path of a folder's or file's name."""
    return FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)


class _Builder:
    """Collects a task's ids and writes a shard whenever one is full."""

    def __init__(self, folder: str, kind: pa.DataType, bits: int, shard_tokens: int):
        self.folder, self.bits, self.full = folder, bits, shard_tokens
        self.schema = pa.schema([("doc_id", kind), ("before", pa.int64()), ("length", pa.int64()), ("last", pa.bool_())])
        self.part, self.number, self.ids, self.n, self.pieces = TaskContext.get().partitionId(), 0, [], 0, []

    def add(self, doc_id: object, parts: Iterable[np.ndarray]) -> Iterator[list]:
        """Takes a document's ids; yields the manifest's row of each shard that they fill."""
        before, begun = 0, self.n
        for ids in parts:
            while self.n + len(ids) > self.full:
                now, ids = np.split(ids, [self.full - self.n])
                self._take(now)
                if self.n > begun:
                    self.pieces.append((doc_id, before, self.n - begun, False))
                before, begun = before + self.n - begun, 0
                yield self.flush()
            self._take(ids)
        self.pieces.append((doc_id, before, self.n - begun, True))

    def _take(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.n += len(ids)

    def flush(self) -> list:
        ids = np.concatenate(self.ids)
        data = build(ids, self.bits, record(self.schema, *zip(*self.pieces, strict=True)))
        name = f"{self.folder}/{self.part:06d}-{self.number:06d}-{uuid.uuid4().hex}.tokens"
        system, path = place(name)
        with system.open_output_stream(path, compression=None) as f:
            f.write(data)
        row = [self.part, self.number, name, len(ids), len(self.pieces), len(data)]
        self.number, self.ids, self.n, self.pieces = self.number + 1, [], 0, []
        return row


def write_tokens(df: DataFrame, tokenizer: str, folder: str | None = None, *, text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the rows of df (doc_id, text); the manifest: file, start (ids before it), n_tokens, n_pieces, n_bytes of each shard."""
    folder = folder or new_folder(df.sparkSession)
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    order = ["doc_id", F.xxhash64("_text")]
    rows = df.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("_text"))
    # The range's keys are worked out once more for its bounds; texts move once.
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, builder = word_encoder(tokenizer), None
        end = np.array([end_id], encoder.dtype)
        bits = max(encoder.bits, end_id.bit_length())
        for b in slices(batches, 1):
            builder = builder or _Builder(folder, b.schema.field(0).type, bits, shard_tokens)
            for doc_id, data in zip(b.column(0).to_pylist(), encoded(b, 1), strict=True):
                for row in builder.add(doc_id, (ids for part in (encoder.parts(data), (end,)) for ids in part)):
                    yield record(_MANIFEST, *([x] for x in row))
        if builder and builder.n:
            yield record(_MANIFEST, *([x] for x in builder.flush()))

    manifest = written(rows.mapInArrow(run, _MANIFEST_DDL))
    # A row a task: few, and summed in order.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.orderBy("part"))).select("part", (F.col("_upto") - F.col("_n")).alias("_before"))
    upto = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number"))
    return manifest.withColumn("_upto", upto).join(parts, "part").select("file", (F.col("_before") + F.col("_upto") - F.col("n_tokens")).alias("start"), "n_tokens", "n_pieces", "n_bytes")


def _spread(manifest: DataFrame) -> DataFrame:
    """A few shards in each task: the manifest itself is small and would be one."""
    return manifest.select("file", "start").repartition(max(1, manifest.count() // 4), "file")


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Shard, int]]:
    for b in batches:
        for name, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
            system, path = place(name)
            with system.open_input_file(path) as f:
                yield Shard(f), start


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """crc32 of documents in pieces: what zeros of a piece's length do to the sum before it, and the piece's own sum."""
    for b in batches:
        sums = []
        for pieces in b.column(3).to_pylist():
            crc = 0
            for x in pieces:
                zeros = bytes(4 * x["length"])
                crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ x["crc"]
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame, doc_id: str = "long") -> DataFrame:
    """doc_id (of the type that was written), start, n_tokens, ids_crc32 of each document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, start in _opened(batches):
            pieces, data = shard.documents(), shard.ids().astype("<u4").tobytes()
            before, length = (pieces.column(c).to_numpy() for c in (1, 2))
            ends, view = np.cumsum(length), memoryview(data)
            crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            columns = [pieces.column(0), pa.array(start + ends - length - before), pa.array(before), pa.array(length), pieces.column(3), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "before", "length", "last", "crc"])

    found = _spread(manifest).mapInArrow(run, f"doc_id {doc_id}, start long, before long, length long, last boolean, crc long")
    whole = F.col("last") & (F.col("before") == 0)
    cut = found.where(~whole).groupBy("start").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("before", "length", "crc"))).alias("_pieces"))
    joined = cut.select("doc_id", "start", "n_tokens", "_pieces").mapInArrow(_joined, f"doc_id {doc_id}, start long, n_tokens long, ids_crc32 long")
    return found.where(whole).select("doc_id", "start", F.col("length").alias("n_tokens"), F.col("crc").alias("ids_crc32")).unionByName(joined)


def token_counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often the files hold each of these ids; no id is unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _ in _opened(batches):
            yield record(_COUNTED, tokens, [shard.count(t) for t in tokens])

    return _spread(manifest).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_positions(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, position (among all ids) of each occurrence of these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, start in _opened(batches):
            for t in tokens:
                found = shard.occurrences(t)
                for i in range(0, len(found), 100_000):
                    part = found[i : i + 100_000]
                    yield record(_FOUND, np.full(len(part), t), start + part)

    return _spread(manifest).mapInArrow(run, "token long, position long")


def tokens_at(manifest: DataFrame, start: int, stop: int) -> DataFrame:
    """position, token of a range of all ids: only the shards that hold some are opened, and of these the blocks of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, first in _opened(batches):
            for at in range(max(0, start - first), min(shard.n, stop - first), 100_000):
                places = np.arange(at, min(at + 100_000, shard.n, stop - first))
                yield record(_FOUND, shard.access(places), first + places)

    held = manifest.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    return _spread(held).mapInArrow(run, "token long, position long").select("position", "token")
