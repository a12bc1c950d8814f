"""Reading and writing ledger tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType([
    T.StructField("transaction", T.StringType(), False), T.StructField("from_address", T.StringType(), False), T.StructField("to_address", T.StringType()),
    T.StructField("value", T.DecimalType(38, 0)), T.StructField("block_timestamp", T.TimestampType(), False), T.StructField("block_number", T.LongType(), False),
])
POOL_TX = T.StructType([
    T.StructField("hash", T.StringType(), False), T.StructField("transaction_index", T.LongType()), T.StructField("from_address", T.StringType(), False), T.StructField("to_address", T.StringType()),
    T.StructField("gas", T.LongType()), T.StructField("gas_price", T.LongType()), T.StructField("block_number", T.LongType(), False), T.StructField("block_hash", T.StringType(), False),
    T.StructField("block_timestamp", T.TimestampType(), False), T.StructField("pool", T.StringType(), False), T.StructField("recipient_address", T.StringType()),
])
CALL_TABLE = T.StructType([T.StructField("address", T.StringType(), False), T.StructField("abi", T.StringType(), False)])


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, header: bool = True, sep: str = ",") -> DataFrame:
    """One or many CSV files or folders under one schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(paths)


def read_piped(spark: SparkSession, paths: str | list[str], schema: T.StructType = CALL_TABLE) -> DataFrame:
    """Tables without header whose columns are divided by a bar."""
    return read_csv(spark, paths, schema, header=False, sep="|")


def read_json(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def table_names(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def write_sorted(df: DataFrame, path: str, *columns: str, partitions: int | None = None, fmt: str = "parquet") -> None:
    """Files in global order of the columns: ranges by file, sorted within; Spark spills where a merge would."""
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *columns).sortWithinPartitions(*columns)
    ranged.write.mode("overwrite").format(fmt).save(path)


def write_for_look_up(df: DataFrame, path: str, key: str, partitions: int | None = None, rows_per_group: int | None = None) -> None:
    """Parquet files in ranges of ``key``, sorted within, with a bloom filter of it: ``look_up`` reads the row groups that can hold a value, and no others."""
    ranged = df.repartitionByRange(*([partitions] if partitions else []), key).sortWithinPartitions(key)
    writer = ranged.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true")
    (writer.option("parquet.block.row.count.limit", rows_per_group) if rows_per_group else writer).parquet(path)


def look_up(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The rows of a few values of ``key``; the condition reaches the scan, so bounds and bloom filters of row groups are used."""
    return spark.read.parquet(path).where(F.col(key).isin(values))


def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", **options: str) -> None:
    """Append to or replace a table of files; CSV gets a header in each file."""
    writer = df.write.mode(mode).format(fmt).options(**options)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def save_bucketed(df: DataFrame, name: str, by: list[str], order: list[str] | None = None, buckets: int = 64, path: str | None = None) -> DataFrame:
    """A catalog table bucketed ``by`` columns and sorted within (by ``order`` after them): later joins, groups and windows by these columns need no shuffle.

    Rows are dealt as the buckets are, so each bucket is one file. ``path`` keeps the files outside the warehouse.
    """
    writer = df.repartition(buckets, *by).write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*by, *(order or []))
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)
