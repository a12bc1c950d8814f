"""The ledger tables as views over the driver's tables, once as DataFrames and once as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pools in order of their number, by amount and currency (fixed values).
POOLS = [
    "100 DAI", "1000 DAI", "10000 DAI", "100000 DAI", "0.1 ETH", "1 ETH", "10 ETH", "100 ETH", "100 USDC", "1000 USDC", "100 USDT", "1000 USDT",
    "0.1 WBTC", "1 WBTC", "10 WBTC", "5000 cDAI", "50000 cDAI", "500000 cDAI", "5000000 cDAI",
]
#: Reward points per block by pool (fixed values).
RATES = {
    "0.1 ETH": 4, "1 ETH": 20, "10 ETH": 50, "100 ETH": 400, "100 DAI": 2, "1000 DAI": 10, "10000 DAI": 40, "100000 DAI": 250,
    "5000 cDAI": 2, "50000 cDAI": 10, "500000 cDAI": 40, "5000000 cDAI": 250, "0.1 WBTC": 15, "1 WBTC": 120, "10 WBTC": 1000,
}
#: The numbers of the pools that have a rate.
RATED = [i for i, label in enumerate(POOLS) if label in RATES]
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _hours(ts: str) -> Column:
    return F.timestamp_diff("HOUR", F.lit(EPOCH).cast("timestamp_ntz"), F.col(ts))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", _k())


def _pool_txs(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select(
        F.col("event_id").alias("hash"), F.col("user_id").alias("from_address"), F.col("value").alias("gas_price"), F.col("ts").alias("block_timestamp"),
        (F.col("k") % 19).alias("pool"), _hours("ts").alias("block_number"), "k",
    )


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool_txs(events(spark, sf_dir), "purchase").drop("k")


def withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir)
    # one row, so the broadcast has a fixed size
    users = table(spark, sf_dir, "events").agg((F.max("user_id") + 1).alias("users"))
    recipient = F.when(F.col("k") % 2 == 0, F.col("from_address")).otherwise((F.col("from_address") * 7 + 3) % F.col("users"))
    return _pool_txs(found, "signup").crossJoin(F.broadcast(users)).withColumn("recipient_address", recipient).drop("k", "users")


def pools(spark: SparkSession) -> DataFrame:
    rows = [(i, label, RATES.get(label)) for i, label in enumerate(POOLS)]
    return spark.createDataFrame(rows, "pool int, label string, rate int")


def external_txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).select(F.col("event_id").alias("hash"), F.col("user_id").alias("from_address"), F.col("k").cast("long").alias("to_address"), "ts")
    return found.where("from_address <> to_address")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward claims: points are delta_blocks times the rate of one of the rated pools, by k."""
    found = events(spark, sf_dir).where("event_type = 'error'")
    at = F.col("k") % len(RATED)
    pool, rate = (F.get(F.array(*map(F.lit, values)), at) for values in (RATED, [RATES[POOLS[i]] for i in RATED]))
    return found.select(F.col("event_id").alias("hash"), F.col("user_id").alias("recipient"), pool.alias("pool"), (F.col("k") * rate).cast("long").alias("points"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger transfers: returned items go from a supplier to an exchange, others from a part to a supplier."""
    back = F.col("l_returnflag") == "R"
    supplier = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction"),
        F.when(back, supplier).otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("from_address"),
        F.when(back, F.concat(F.lit("x"), (F.col("l_suppkey") % 25).cast("string"))).otherwise(supplier).alias("to_address"),
        (F.col("l_quantity") + F.col("l_discount") / 10).alias("value"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("block"),
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known addresses: the nations are exchanges, parts of size 1 are something else, of some of which type or entity is missing."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("address"), F.col("n_name").alias("name"), F.lit("eoa").alias("account_type"), F.lit("exchange").alias("entity"))
    kind, entity = F.when(F.col("p_partkey") % 2 == 0, "eoa"), F.when(F.col("p_partkey") % 3 > 0, "dex")
    part = table(spark, sf_dir, "part").where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("address"), F.col("p_name").alias("name"), kind.alias("account_type"), entity.alias("entity"))
    return nation.unionByName(part)


def miners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that mined a block: the parts of one brand."""
    return table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.concat(F.lit("p"), "p_partkey").alias("address")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


VIEWS = {
    "ev": "SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events",
    "deposits": f"SELECT event_id AS hash, user_id AS from_address, value AS gas_price, ts AS block_timestamp, (k % 19)::INT AS pool, date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) // 3600000000 AS block_number FROM ev WHERE event_type = 'purchase'",
    "withdrawals": f"SELECT event_id AS hash, user_id AS from_address, value AS gas_price, ts AS block_timestamp, (k % 19)::INT AS pool, date_diff('microsecond', TIMESTAMP '{EPOCH}', ts) // 3600000000 AS block_number, CASE WHEN k % 2 = 0 THEN user_id ELSE (user_id * 7 + 3) % (SELECT max(user_id) + 1 FROM events) END AS recipient_address FROM ev WHERE event_type = 'signup'",
    "pools": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}', {RATES.get(x, 'NULL')})" for i, x in enumerate(POOLS)) + ") AS t(pool, label, rate)",
    "external_txs": "SELECT event_id AS hash, user_id AS from_address, k::BIGINT AS to_address, ts FROM ev WHERE user_id <> k",
    "claims": f"SELECT event_id AS hash, user_id AS recipient, ({RATED})[k % {len(RATED)} + 1]::INT AS pool, (k * ({[RATES[POOLS[i]] for i in RATED]})[k % {len(RATED)} + 1])::BIGINT AS points FROM ev WHERE event_type = 'error'",
    "transfers": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction, CASE WHEN l_returnflag = 'R' THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS from_address, CASE WHEN l_returnflag = 'R' THEN 'x' || (l_suppkey % 25) ELSE 's' || l_suppkey END AS to_address, l_quantity + l_discount / 10 AS value, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS block FROM lineitem",
    "known": "SELECT 'x' || n_nationkey AS address, n_name AS name, 'eoa' AS account_type, 'exchange' AS entity FROM nation UNION ALL SELECT 'p' || p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'eoa' END, CASE WHEN p_partkey % 3 > 0 THEN 'dex' END FROM part WHERE p_size = 1",
    "miners": "SELECT DISTINCT 'p' || p_partkey AS address FROM part WHERE p_brand = 'Brand#11'",
    "edges": "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem",
}


def sql(body: str, *views: str, **more: str) -> str:
    """A statement with the named views, and further ones, before its body."""
    wanted = list(dict.fromkeys((["ev"] if {"deposits", "withdrawals", "external_txs", "claims"} & set(views) else []) + list(views)))
    parts = [f"{v} AS ({VIEWS[v]})" for v in wanted] + [f"{k} AS ({v})" for k, v in more.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
