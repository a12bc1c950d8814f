"""Keyed tables of Parquet files that loads are merged into: a merge writes only the buckets that its keys fall into.

A table is a folder. Rows are dealt into buckets by a hash of the key; each version is a small file that says which folder holds
each bucket, so a new version shares the files of all buckets it has not touched. Data is written first and the version file is put
in place last, under a name that must not exist yet: a failed or concurrent load leaves the last version as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.operators.joins import first_per_key, upsert

_BUCKET = "__bucket"


class StoredTable:
    """The table in the folder ``path``; ``create`` makes one. Every change returns the number of the version that it made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64, bucket_by: str | None = None) -> StoredTable:
        """An empty table with one row for each ``key``; ``bucket_by`` is the column whose hash deals the rows (the key unless given)."""
        table = cls(spark, path)
        table._put(Version(0, key, bucket_by or key, buckets, json.loads(schema.json()), {}, []))
        return table

    # files

    def _fs(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _put(self, version: Version) -> None:
        fs, target = self._fs(), self._place(f"versions/{version.number:010d}.json")
        staged = self._place(f"staged/{uuid.uuid4().hex}.json")
        stream = fs.create(staged, False)
        stream.write(bytearray(json.dumps(version.__dict__).encode()))
        stream.close()
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(staged, target):
            raise RuntimeError(f"version {version.number} of {self.path} was written by another load")

    def version(self, number: int | None = None) -> Version:
        """The last version, or the one of that number."""
        fs, folder = self._fs(), self._place("versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        wanted = names[-1] if names and number is None else f"{number or 0:010d}.json"
        if wanted not in names:
            raise FileNotFoundError(f"no such version of {self.path}: {number}")
        stream = fs.open(self._place(f"versions/{wanted}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    # reading

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), of all buckets or of those given."""
        found = self.version(number)
        schema = T.StructType.fromJson(found.schema)
        folders = [f"{self.path}/{folder}" for bucket, folder in sorted(found.folders.items(), key=lambda x: int(x[0])) if buckets is None or int(bucket) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """The rows whose bucketing column is in ``keys`` (one column of that name), from the buckets of those only."""
        found = self.version()
        keys = keys.select(F.col(found.bucket_by)).distinct()
        return self.read(found.number, self._buckets_of(keys, found)).join(keys, found.bucket_by, "left_semi")

    def _buckets_of(self, rows: DataFrame, version: Version) -> list[int]:
        return [r[0] for r in rows.select(version.bucket(F.col(version.bucket_by))).distinct().collect()]  # as many as there are buckets at most

    # changes

    def _write(self, rows: DataFrame, before: Version, touched: list[int], batch: str | None) -> int:
        """The next version: ``rows`` in place of all rows of the ``touched`` buckets."""
        folder = f"data/{before.number + 1:010d}-{uuid.uuid4().hex}"
        columns = [f.name for f in T.StructType.fromJson(before.schema)]
        dealt = rows.select(*columns).withColumn(_BUCKET, before.bucket(F.col(before.bucket_by)))
        # a bucket may be written by several tasks, so a common value of the bucketing column is no hot key
        dealt = dealt.repartition(_BUCKET, F.pmod(F.xxhash64(before.key), F.lit(4))).sortWithinPartitions(_BUCKET, before.key)
        # sorted by key, with a bloom filter of it, so that a look-up skips row groups of the files that it does read
        dealt.write.option(f"parquet.bloom.filter.enabled#{before.key}", "true").partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        fs = self._fs()
        written = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(self._place(folder)) if "=" in s.getPath().getName()}
        folders = {b: f for b, f in before.folders.items() if int(b) not in set(touched)} | {b: f"{folder}/{_BUCKET}={b}" for b in written}
        batches = before.batches + ([batch] if batch is not None else [])
        self._put(Version(before.number + 1, before.key, before.bucket_by, before.buckets, before.schema, folders, batches[-1000:]))
        return before.number + 1

    def merge(self, new: DataFrame, updated: list[str] | None = None, batch: str | None = None) -> int:
        """Add the keys that the table lacks, and take ``updated`` columns (all unless given) from ``new`` where it has the key.

        Of several new rows of a key the first by all columns counts, null keys are left out. A ``batch`` that was merged
        before changes nothing. For tables whose rows are dealt by their key.
        """
        before = self.version()
        if batch is not None and batch in before.batches:
            return before.number
        if before.bucket_by != before.key:
            raise ValueError("only a table whose rows are dealt by their key can be merged by it")
        columns = [f.name for f in T.StructType.fromJson(before.schema)]
        new = new.select(*columns).where(F.col(before.key).isNotNull())
        new = first_per_key(new, [before.key], *[F.col(c).asc_nulls_last() for c in columns if c != before.key])
        touched = self._buckets_of(new, before)
        old = self.read(before.number, touched)
        return self._write(upsert(old, new, before.key, [c for c in columns if c != before.key] if updated is None else updated), before, touched, batch)

    def delete(self, condition: Column) -> int:
        """Without the rows that meet a condition; only buckets that hold such rows are written."""
        before = self.version()
        rows = self.read(before.number)
        touched = self._buckets_of(rows.where(condition), before)
        return self._write(self.read(before.number, touched).where(~F.coalesce(condition, F.lit(False))), before, touched, None) if touched else before.number

    def insert(self, rows: DataFrame) -> int:
        """With the rows of a query; a key that is there already raises, as does one that comes twice."""
        before = self.version()
        rows = rows.select(*[f.name for f in T.StructType.fromJson(before.schema)])
        touched = self._buckets_of(rows, before)
        both = self.read(before.number, touched).unionByName(rows)
        several = both.groupBy(before.key).count().where("count > 1").limit(1).collect()
        if several:
            raise ValueError(f"key {several[0][0]!r} is not unique")
        return self._write(both, before, touched, None)

    def replace(self, bucket_values: DataFrame, rows: DataFrame, batch: str | None = None) -> int:
        """``rows`` in place of all rows whose bucketing column is in ``bucket_values``; other rows stay."""
        before = self.version()
        if batch is not None and batch in before.batches:
            return before.number
        gone = bucket_values.select(F.col(before.bucket_by)).distinct()
        touched = sorted({*self._buckets_of(gone, before), *self._buckets_of(rows, before)})
        kept = self.read(before.number, touched).join(gone, before.bucket_by, "left_anti")
        return self._write(kept.unionByName(rows.select(*kept.columns)), before, touched, batch)


@dataclass(frozen=True)
class Version:
    """What a version file holds: for each bucket its folder, and the batches that have been merged (the last thousand)."""

    number: int
    key: str
    bucket_by: str
    buckets: int
    schema: dict
    folders: dict[str, str]
    batches: list[str]

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")
