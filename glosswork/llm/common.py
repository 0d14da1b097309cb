"""Helpers shared by the training-data operators.

Words are runs of anything but the six ASCII white-space characters, which is
what ``bytes.split()`` returns on UTF-8 text, and ``bytes.lower()`` lower-cases
A-Z alone; both are used on encoded text throughout.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to Python code in groups of about so many bytes.
SLICE_BYTES = 2_000_000
#: Spark's setting by which a job's shuffles go when it ends; by itself it keeps them until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def crc_mod_py(doc_id: object, n: int) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own is set only where the session names none (local runs)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glosswork-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the cluster's shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A place for a new table in the cluster's shared folder."""
    return f"{_shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the cluster's shared folder, and read again."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Removes what written() wrote for df, once nothing is to read it again, and lets Spark clear the shuffles that led to it."""
    spark = df.sparkSession
    jvm, root = spark.sparkContext._jvm, _shared_folder(spark)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if root.rsplit("/", 1)[-1] in name:  # nothing outside our own folder
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffles of a job are removed when the job ends; the session's setting is put back."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Lets Spark clear the shuffles of jobs that are over: it does so for plans that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column number ``text`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def encoded(batch: pa.RecordBatch, text: int) -> list[bytes]:
    """Column number ``text`` as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
