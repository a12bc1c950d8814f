"""Deposit-address reuse as a stream, and loads above a high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import round_half_even
from lodeweave.operators import heuristics as H
from lodeweave.operators import joins as J
from lodeweave.operators.materialize import remove

#: Where a watermark is asked for, blocks are put on a time axis a day each, from this day on, so that none is before the first watermark.
DAY_0 = 100_000
MATCH = "user_address string, deposit string, exchange string, forward_tx string, receipt_tx string, t_diff bigint"
SIDES = "deposit string, round_value double, block bigint, side int, tx string, other string, value double"
MARK = "high bigint, passed bigint, live array<struct<batch: bigint, top: bigint>>"


def above_mark(df: DataFrame, loaded: DataFrame, column: str) -> DataFrame:
    """Rows above the highest value loaded so far; all of them when nothing is loaded."""
    mark = loaded.agg(F.max(column)).first()[0]
    return df if mark is None else df.where(F.col(column) > mark)


def in_order_of_arrival(transfers: DataFrame, pieces: int, late: int | None = None) -> tuple[list[DataFrame], int, int]:
    """``transfers`` as ``pieces`` loads in order of block, the one numbered ``late`` one place too late; the loads, the blocks that one
    load spans and the last block."""
    low, high = transfers.agg(F.min("block"), F.max("block")).first()
    span = max(1, -(-((high or 0) - (low or 0) + 1) // pieces))
    order = list(range(pieces))
    if late is not None and late + 1 < pieces:
        order[late], order[late + 1] = late + 1, late
    return [transfers.where(F.col("block").between((low or 0) + k * span, (low or 0) + (k + 1) * span - 1)) for k in order], span, high or 0


def _sides(transfers: DataFrame, exchanges: DataFrame, known: DataFrame, miners: DataFrame, delay: str | None = None) -> DataFrame:
    """``deposit, round_value, block, side, tx, other, value`` of transfers: each as a receipt of its target (side 0) and, if it goes to an exchange, as a forward of its sender (side 1).
    What a listed address sends never counts, so its receipts match nothing and are left out. With ``delay`` the rows also have a time ``at``, with that watermark."""
    at = []
    if delay is not None:
        transfers, at = transfers.withColumn("at", F.timestamp_seconds((F.col("block") + DAY_0) * 86_400)).withWatermark("at", delay), ["at"]
    listed = H._few(miners.select("address").unionByName(known.select("address")).distinct())
    own = transfers.join(listed.withColumnRenamed("address", "from_address"), "from_address", "left_anti")
    own = own.join(H._few(exchanges.select(F.col("address").alias("to_address"), F.lit(True).alias("exchange")).distinct()), "to_address", "left")
    side = lambda n, deposit, other: F.struct(F.col(deposit).alias("deposit"), F.lit(n).alias("side"), F.col(other).alias("other"))
    own = own.join(listed.select(F.col("address").alias("to_address"), F.lit(True).alias("listed")), "to_address", "left")
    sides = F.array_compact(F.array(F.when(F.col("listed").isNull(), side(0, "to_address", "from_address")), F.when(F.col("exchange"), side(1, "from_address", "to_address"))))
    rows = own.select(F.explode(sides).alias("s"), round_half_even(F.col("value"), 1).alias("round_value"), "block", F.col("transaction").alias("tx"), "value", *at)
    return rows.select("s.deposit", "round_value", "block", "s.side", "tx", "s.other", "value", *at).where("deposit IS NOT NULL AND round_value IS NOT NULL")


def matches_of(spark: SparkSession, out: str) -> DataFrame:
    """The matches that the runs of ``run_matches`` have put into ``out``, those of the batch operator once all is closed."""
    return spark.read.schema(MATCH).parquet(out).select(*[x.split()[0] for x in MATCH.split(", ")])


def run_matches(spark: SparkSession, source: str, schema, exchanges: DataFrame, known: DataFrame, miners: DataFrame, t_max: int, a_max: float, lateness: int, out: str, state: str) -> None:
    """The stream over the files of ``source`` that have come since the last run with this ``state``, in one micro-batch; matches are added to ``out``.

    ``lateness`` is by how many blocks a row may come late: blocks so far behind the last one have passed, and rows of theirs that come
    later are dropped. What has not passed (``close_loads``) waits in the state for the next run.
    """
    spark.createDataFrame([], MATCH).write.mode("ignore").parquet(f"{out}/batch=-1")  # so that there is a table before the first file comes
    rows = spark.readStream.schema(schema).parquet(source)
    step = lambda batch, number: add_transfers(spark, batch, number, exchanges, known, miners, t_max, a_max, lateness, out, state)
    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()


def add_transfers(spark: SparkSession, batch: DataFrame, number: int, exchanges: DataFrame, known: DataFrame, miners: DataFrame, t_max: int, a_max: float, lateness: int, out: str, state: str) -> None:
    """Take micro-batch ``number`` into the state and put out the matches of the blocks that have passed with it, which are final.

    The state is three tables for each micro-batch: its rows, once (``rows``), the last receipt of each deposit and rounded value that a
    later forward may still match (``last``), and one row that says what has passed and which ``rows`` some block has not (``marks``).
    Only rows of blocks that pass now are shuffled. A micro-batch that runs again writes the same folders anew.
    """
    before = spark.read.schema(MARK).parquet(f"{state}/marks/{number - 1}").first() if number else Row(high=None, passed=None, live=[])
    fresh = _sides(batch, exchanges, known, miners).where("block IS NOT NULL")
    if before.passed is not None:
        fresh = fresh.where(F.col("block") > before.passed)
    fresh.write.mode("overwrite").parquet(f"{state}/rows/{number}")
    # what is left out above counts here, too
    high = max([x for x in (before.high, batch.agg(F.max("block")).first()[0]) if x is not None], default=None)
    passed = None if high is None else high - lateness
    top = spark.read.schema(SIDES).parquet(f"{state}/rows/{number}").agg(F.max("block")).first()[0]
    live = [tuple(x) for x in before.live if x.top > before.passed] + ([] if top is None else [(number, top)])

    due = spark.createDataFrame([], SIDES) if not live else spark.read.schema(SIDES).parquet(*[f"{state}/rows/{k}" for k, _ in live]).where(F.col("block") <= F.lit(passed))
    if before.passed is not None:
        due = due.where(F.col("block") > before.passed)
    forwards = due.where("side = 1").select("deposit", "round_value", F.col("other").alias("exchange"), "value", "block", "tx")
    receipts = due.where("side = 0").select("deposit", "round_value", F.col("other").alias("user_address"), "value", "block", "tx")
    if number:
        receipts = receipts.unionByName(spark.read.schema(receipts.schema).parquet(f"{state}/last/{number - 1}"))
    found = H.reuse_matches_of(J.as_of_sequence(forwards, receipts, H.REUSE_KEYS, "block", ["tx"]), a_max, t_max)
    found.select(*[x.split()[0] for x in MATCH.split(", ")]).write.mode("overwrite").parquet(f"{out}/batch={number}")
    near = receipts.where(F.col("block") >= F.lit(passed) - t_max).groupBy(*H.REUSE_KEYS).agg(F.max(F.struct("block", "tx", "user_address", "value")).alias("r"))
    near.select(*H.REUSE_KEYS, "r.user_address", "r.value", "r.block", "r.tx").write.mode("overwrite").parquet(f"{state}/last/{number}")
    spark.createDataFrame([(high, passed, live)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{state}/marks/{number}")
    # what neither this micro-batch nor a later one reads
    gone = {x.batch for x in before.live} - {k for k, _ in live}
    remove(spark, *[f"{state}/rows/{k}" for k in gone], *[f"{state}/{name}/{number - 2}" for name in ("last", "marks")])


def close_loads(spark: SparkSession, source: str, schema, block: int) -> None:
    """Say that nothing before ``block`` will come any more: a load with one row of that block between empty addresses, which matches nothing.

    Its columns are not null, as Spark would filter null ones before it reads the time.
    """
    values = [F.lit(block if f.name == "block" else "" if f.dataType.typeName() == "string" else 0).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1, numPartitions=1).select(*values).write.mode("append").parquet(source)


def windowed_counts(events: DataFrame, ts: str, key: str, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by key and tumbling window of a stream (or batch) of events; rows later than ``delay`` are dropped in a stream."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
