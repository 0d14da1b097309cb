"""Line deduplication over levelled sorted runs of line hashes.

A *run* is a Parquet table of (key, n_docs, keeper), a row for each line key, in
files dealt and sorted by key. Batches of documents come by descending id. Each
batch is merge-joined with the runs: keys that no run has (the anti-join) are added with
the batch's largest id as keeper; known keys add their counts, until they are
in ``min_docs`` documents, and from then on nothing, so that a frequent line isn't
written again in each batch. When a level holds ``fanout`` runs they are compacted
into one of the next level, so a key is rewritten a logarithmic number of times.
A line whose key is in ``min_docs`` documents stays in its keeper alone.

Keys are lines stripped of ASCII white space and lower-cased (A-Z); those of
fewer than ``min_chars`` code points are never dropped. Runs hold the first 128
bits of the key's BLAKE2b hash. Defined results: null or empty text is one
empty line; lines repeated in one document count once for it and stay or go
together; rows that share an id count as one document; null ids stay as they
are and neither count nor lose lines; other columns are kept by ``drop_lines``,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, new_folder, record, slices, written

_SPACE = b" \t\n\r\x0b\x0c"
_LINES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])
_LINES_DDL = "k1 long, k2 long, doc_id long"
_RUN_DDL = "k1 long, k2 long, n_docs long, keeper long"


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128 bits of a line's key, or None if it is too short."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode(errors="replace")) < min_chars):
        return None
    found = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            k1, k2, ids = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), encoded(b, 1), strict=True):
                for key in {line_key(line, min_chars) for line in text.split(b"\n")} - {None}:
                    k1.append(key[0])
                    k2.append(key[1])
                    ids.append(doc_id)
            yield record(_LINES, k1, k2, ids)

    return run


class LineRuns:
    """Levelled runs of lines, Parquet tables in the shared folder; a folder that is given keeps them from one call to the next.

    A run is named by its level and the batches that it covers. It is sorted by
    key in files dealt by key, and is there once its _SUCCESS is; a run that another
    one covers is left out, so a compaction that was lost is done again.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, *, min_docs: int = 3, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = folder or new_folder(spark)

    def runs(self) -> list[tuple[int, int, int]]:
        """(level, first batch, last batch) of the runs that count, by batch."""
        fs, path = self._files("")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        found = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("run-") and fs.exists(self._files(f"{n}/_SUCCESS")[1])]
        return sorted((r for r in found if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)), key=lambda r: r[1])

    def _files(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _name(self, run: tuple[int, int, int]) -> str:
        return "run-{}-{}-{}".format(*run)

    def read(self, run: tuple[int, int, int]) -> DataFrame:
        return self.spark.read.schema(_RUN_DDL).parquet(f"{self.folder}/{self._name(run)}")

    def add(self, batch: DataFrame) -> None:
        """batch: (k1, k2, doc_id), a row for each line key of each document, of smaller ids than the batches before.

        Keys that no run has (the anti-join) go into the batch's run with their
        keeper. Of keys that runs have, those in fewer than min_docs documents add
        their count; those in enough add nothing, as no later batch changes them.
        """
        own = batch.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        known = self.runs()
        if known:
            seen = self.keys().select("k1", "k2", F.col("n_docs").alias("_seen"))
            found = own.join(seen, ["k1", "k2"], "left").where(F.coalesce("_seen", F.lit(0)) < self.min_docs)
            own = found.select("k1", "k2", "n_docs", F.when(F.col("_seen").isNull(), F.col("keeper")).alias("keeper"))
        number = 1 + max((r[2] for r in known), default=-1)
        self._write(own, (0, number, number))
        self.compact()

    def compact(self) -> None:
        """Runs of a level, once there are fanout of them, become one of the next."""
        while True:
            live = self.runs()
            full = next((level for level in sorted({r[0] for r in live}) if sum(r[0] == level for r in live) >= self.fanout), None)
            if full is None:
                return
            own = [r for r in live if r[0] == full]
            self._write(self._merged(own), (full + 1, own[0][1], own[-1][2]))
            for run in own:
                fs, path = self._files(self._name(run))
                fs.delete(path, True)

    def _write(self, run: DataFrame, name: tuple[int, int, int]) -> None:
        run.sortWithinPartitions("k1", "k2").write.mode("overwrite").parquet(f"{self.folder}/{self._name(name)}")

    def _merged(self, runs: list[tuple[int, int, int]]) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.read, runs)).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def keys(self) -> DataFrame:
        """(k1, k2, n_docs, keeper) over all batches; from min_docs documents on, n_docs may fall short."""
        return self._merged(self.runs())


def id_batches(lines: DataFrame, batches: int) -> list[DataFrame]:
    """The rows by descending ranges of doc_id, about equally many in each."""
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted({int(x) for x in lines.approxQuantile("doc_id", shares, 0.01)}, reverse=True) if shares else []
    doc, upper, out = F.col("doc_id"), None, []
    for cut in [*cuts, None]:
        bound = (doc > cut if cut is not None else F.lit(True)) & (doc <= upper if upper is not None else F.lit(True))
        out.append(lines.where(bound))
        upper = cut
    return out


def _drop(at: int, width: int, min_chars: int, schema: pa.Schema):
    """The first width columns with the lines named in the next one (or null) taken out of column number at, and, where the schema has them, the numbers of lines before and dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            texts, n_lines, n_dropped = [], [], []
            for raw, x, drop in zip(b.column(at).to_pylist(), encoded(b, at), b.column(width).to_pylist(), strict=True):
                found = x.split(b"\n")
                n_lines.append(len(found))
                if drop:
                    gone = {(d["k1"], d["k2"]) for d in drop}
                    kept = [line for line in found if line_key(line, min_chars) not in gone]
                    n_dropped.append(len(found) - len(kept))
                    texts.append(b"\n".join(kept).decode())
                else:
                    n_dropped.append(0)
                    texts.append(raw)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:width])]
            yield record(schema, *columns, *([n_lines, n_dropped] if len(schema) > width else []))

    return run


def drop_lines(df: DataFrame, *, text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, counts: bool = True) -> DataFrame:
    """df, whatever its columns' names, with repeated lines taken out of the text; counts: with n_lines (before) and n_dropped of each row at the end, in place of columns so named."""
    from pyspark.sql.pandas.types import to_arrow_schema

    df = df.drop("n_lines", "n_dropped") if counts else df
    at, width = df.columns.index(text), len(df.columns)
    rows = df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = written(rows.mapInArrow(_keys(min_chars), _LINES_DDL))
    runs = LineRuns(df.sparkSession, min_docs=min_docs, fanout=fanout)
    for batch in id_batches(lines, batches):
        runs.add(batch)
    repeated = runs.keys().where(F.col("n_docs") >= min_docs).select("k1", "k2", "keeper", "n_docs")
    repeated = written(repeated)
    # Lines of which each makes up at least one in 1,000 of all rows are fewer than 1,000: they are broadcast, so that none of them makes a task of its own.
    many = F.col("n_docs") * 1000 >= lines.count()
    hot, rest = F.broadcast(repeated.where(many)), repeated.where(~many)
    met = lines.join(hot, ["k1", "k2"]).unionByName(lines.join(hot, ["k1", "k2"], "left_anti").join(rest, ["k1", "k2"]))
    gone = met.where(F.col("doc_id") != F.col("keeper")).groupBy(F.col("doc_id").alias("own")).agg(F.collect_set(F.struct("k1", "k2")).alias("drop"))
    # Columns go by their places: no name of theirs can clash.
    plain = df.toDF(*(f"c{i}" for i in range(width)))
    joined = plain.join(gone, F.col(f"c{df.columns.index('doc_id')}").cast("long") == F.col("own"), "left").select(*plain.columns, "drop")
    out = plain.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")} if counts else {}).schema
    found = joined.mapInArrow(_drop(at, width, min_chars, to_arrow_schema(out)), out)
    return found.toDF(*df.columns, *(["n_lines", "n_dropped"] if counts else []))
