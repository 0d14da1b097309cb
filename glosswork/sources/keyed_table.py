"""A table dealt into buckets by a hash of its keys, of which a batch writes anew only those that its keys fall into.

A bucket's rows lie in ``bucket=b/version=n``. A batch numbered n reads the newest
version of the buckets that it touches, and writes each as version n; then it
leaves the mark ``_done/n``. Readers take the newest version below the last mark, so they never
see half a batch, and a batch that failed is run again under its number, over what
it had written. Of older versions the last one stays, for readers that have begun.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """buckets is fixed for the life of a table: some hundred rows or some hundred MB each, as the table will be in the end."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], *, buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join((folder, *names)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _numbers(self, folder, prefix: str = "") -> list[int]:
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())

    def done(self) -> int:
        """The number of the last batch that was written to its end, -1 before the first."""
        return max(self._numbers(self._path("_done")), default=-1)

    def _newest(self, below: int, buckets: list[int]) -> list[str]:
        found = []
        for b in buckets:
            versions = [v for v in self._numbers(self._path(f"bucket={b}"), "version=") if v < below]
            found += [f"{self.folder}/bucket={b}/version={versions[-1]}"] if versions else []
        return found

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """All rows, as the last whole batch left them."""
        return self._read(self._newest(self.done() + 1, self._numbers(self._path(), "bucket=")))

    def merge(self, rows: DataFrame, number: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts combine(old rows, rows) in the place of the buckets that the keys of rows fall into; these buckets. A batch that was done is left out.

        combine gets all old rows of those buckets, and must leave a row's keys as they are.
        """
        if number <= self.done():
            return []
        rows = rows.persist()  # read twice; a stream's batch would run its state twice
        # At most as many numbers as there are buckets.
        touched = sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())
        if touched:
            old = self._read(self._newest(number, touched))
            new = combine(old, rows).select(*self.schema.names).withColumns({"bucket": self.bucket(), "version": F.lit(number)})
            new.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket", "version").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.folder)
        rows.unpersist()
        self._fs.mkdirs(self._path("_done"))
        self._fs.create(self._path("_done", str(number)), True).close()
        for b in touched:
            folder = f"bucket={b}"
            for version in [v for v in self._numbers(self._path(folder), "version=") if v < number][:-1]:
                self._fs.delete(self._path(folder, f"version={version}"), True)
        for mark in [n for n in self._numbers(self._path("_done")) if n < number][:-1]:
            self._fs.delete(self._path("_done", str(mark)), False)
        return touched


def newest_of(keys: list[str], order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """combine() that keeps each key's last row in order."""

    def combine(old: DataFrame, rows: DataFrame) -> DataFrame:
        return old.unionByName(rows).groupBy(*keys).agg(F.max_by(F.struct(*old.columns), order).alias("_x")).select("_x.*")

    return combine
