"""Queries over deposits and withdrawals of the pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.scalars import HEURISTICS, name_of
from lodeweave.operators import heuristics as H
from lodeweave.operators import joins as J
from lodeweave.operators.components import connected_components
from lodeweave.sources import fixtures as X
from lodeweave.sources.fixtures import sql

DAYS, KINDS = 3, 3


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return X.deposits(spark, d), X.withdrawals(spark, d)


def exact_match_links(spark, d):
    return H.exact_match_links(*_links(spark, d))


def exact_match_clusters(spark, d):
    return H.exact_match_clusters(*_links(spark, d))


def unique_gas_by_pool(spark, d):
    return H.unique_gas_links(*_links(spark, d))


def unique_gas_global(spark, d):
    return H.unique_gas_links(*_links(spark, d), by_pool=False)


def _coarse(df: DataFrame) -> DataFrame:
    return df.withColumn("pool", F.col("pool") % KINDS)


def _portfolios(spark, d):
    pools = list(range(KINDS))
    return H.deposit_portfolios(_coarse(X.deposits(spark, d)), pools, DAYS), H.withdraw_portfolios(_coarse(X.withdrawals(spark, d)), pools, DAYS)


def _text(df: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform("portfolio", lambda x: F.concat_ws(":", x["category"], x["n"])), ",")
    return df.select("hash", "address", shown.alias("portfolio"))


def deposit_portfolio(spark, d):
    return _text(_portfolios(spark, d)[0])


def withdraw_portfolio(spark, d):
    return _text(_portfolios(spark, d)[1])


def multi_denom_matches(spark, d):
    return H.multi_denomination_matches(*_portfolios(spark, d))


def multi_denom_clusters(spark, d):
    # the windows of a match take in all withdrawals, also those whose own window is too small to match
    every = H.withdraw_portfolios(_coarse(X.withdrawals(spark, d)), list(range(KINDS)), DAYS, least=0, kinds=0)
    return H.multi_denomination_clusters(*_portfolios(spark, d), every, DAYS)


def external_pairs(spark, d):
    return H.external_pairs(X.external_txs(spark, d))


def linked_pairs_roles(spark, d):
    deposits, withdrawals = _links(spark, d)
    pairs = J.unordered_pairs(external_pairs(spark, d), "from_address", "to_address")
    return J.typed_pairs(pairs, deposits.select(F.col("from_address").alias("address")), withdrawals.select(F.col("recipient_address").alias("address")))


def linked_address_links(spark, d):
    return H.linked_address_links(external_pairs(spark, d), *_links(spark, d))


def linked_address_stars(spark, d) -> DataFrame:
    return H.linked_address_stars(external_pairs(spark, d), *_links(spark, d))


def linked_address_members(spark, d) -> DataFrame:
    return H.linked_address_members(external_pairs(spark, d), *_links(spark, d))


def external_between(spark, d):
    deposits, withdrawals = _links(spark, d)
    found = J.either_direction(X.external_txs(spark, d), deposits.select(F.col("from_address").alias("address")), withdrawals.select(F.col("recipient_address").alias("address")))
    return found.select("hash", "from_address", "to_address")


def reward_claim_links(spark, d):
    return H.reward_claim_links(X.claims(spark, d), *_links(spark, d), X.pools(spark))


def reward_claim_stars(spark, d) -> DataFrame:
    return H.reward_claim_stars(X.claims(spark, d), *_links(spark, d), X.pools(spark))


def reward_claim_members(spark, d) -> DataFrame:
    return H.reward_claim_members(X.claims(spark, d), *_links(spark, d), X.pools(spark))


def reward_claim_last(spark, d):
    return H.reward_claim_links(X.claims(spark, d), *_links(spark, d), X.pools(spark), last_claim_only=True)


def heuristic_output(spark, d):
    deposits, withdrawals = _links(spark, d)
    txs = deposits.select("hash", F.col("from_address").alias("address"), "block_number", "block_timestamp").unionByName(withdrawals.select("hash", F.col("recipient_address").alias("address"), "block_number", "block_timestamp"))
    links = H.unique_gas_links(deposits, withdrawals, by_pool=False)
    return H.heuristic_output(links, txs, "deposit_hash").withColumn("heuristic", name_of(F.lit(2), HEURISTICS))


def components_linked(spark, d):
    pairs = H.external_pairs(X.external_txs(spark, d), least=4)
    return connected_components(pairs, "from_address", "to_address")


def cluster_address_pairs(spark, d):
    links = linked_address_links(spark, d)
    members = links.select(F.col("deposit_hash").alias("cluster"), F.explode(F.array("deposit_address", "withdraw_address")).alias("address"))
    return H.cluster_pairs(members, "cluster", "address")


QUERIES = {f.__name__: f for f in (
    exact_match_links, exact_match_clusters, unique_gas_by_pool, unique_gas_global, deposit_portfolio, withdraw_portfolio, multi_denom_matches, multi_denom_clusters,
    external_pairs, linked_pairs_roles, linked_address_links, external_between, reward_claim_links, reward_claim_last, heuristic_output, components_linked, cluster_address_pairs,
)}

_EXACT = "SELECT w.hash AS withdraw_hash, d.hash AS deposit_hash, d.from_address AS address, w.pool FROM withdrawals w JOIN deposits d ON w.recipient_address = d.from_address AND w.pool = d.pool AND d.block_timestamp < w.block_timestamp"
_GAS = "SELECT w.hash AS withdraw_hash, d.hash AS deposit_hash, d.gas_price FROM withdrawals w JOIN (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM deposits) d ON d.n = 1 AND w.gas_price = d.gas_price {pool} AND d.block_timestamp < w.block_timestamp WHERE w.from_address = w.recipient_address"
_PAIRS = "SELECT from_address, to_address, count(*) AS n FROM external_txs GROUP BY ALL HAVING count(*) >= {least}"
_TYPED = "SELECT a, b FROM (SELECT DISTINCT from_address AS a, to_address AS b FROM pairs UNION SELECT to_address, from_address FROM pairs) WHERE a IN (SELECT from_address FROM deposits) AND b IN (SELECT recipient_address FROM withdrawals)"
_LINKED = "SELECT w.hash AS withdraw_hash, d.hash AS deposit_hash, t.a AS deposit_address, t.b AS withdraw_address FROM typed t JOIN deposits d ON d.from_address = t.a JOIN withdrawals w ON w.recipient_address = t.b AND w.pool = d.pool AND d.block_timestamp < w.block_timestamp"

#: Points over the rate are the blocks between deposit and withdrawal; either the depositor or the recipient is the claimant.
_REWARD = " UNION ALL ".join(
    f"SELECT '{side}' AS side, c.recipient, c.hash AS claim_hash, d.hash AS deposit_hash, w.hash AS withdraw_hash, d.pool FROM claims c JOIN deposits d ON {d} JOIN withdrawals w ON {w} "
    "JOIN pools p ON p.pool = d.pool AND p.rate IS NOT NULL AND d.block_number + c.points / p.rate = w.block_number"
    for side, d, w in (("D", "d.from_address = c.recipient", "w.pool = d.pool"), ("W", "true", "w.recipient_address = c.recipient AND w.pool = d.pool"))
)


def _counts(view: str, address: str, self_minus: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE pool % {KINDS} = {i}) OVER w - {self_minus.format(i=i)} AS c{i}" for i in range(KINDS))
    return f"SELECT hash, {address} AS address, block_timestamp AS ts, {counts} FROM {view} WINDOW w AS (PARTITION BY {address} ORDER BY block_timestamp RANGE BETWEEN INTERVAL {DAYS} DAY PRECEDING AND CURRENT ROW)"


_SHOWN = "concat_ws(',', " + ", ".join(f"CASE WHEN c{i} > 0 THEN '{i}:' || c{i} END" for i in range(KINDS)) + ")"
_PORTFOLIOS = {
    "dp": _counts("deposits", "from_address", f"(pool % {KINDS} = {{i}})::INT"),
    "wq": _counts("withdrawals", "recipient_address", "0"),
    "wp": "SELECT * FROM wq WHERE " + " + ".join(f"(c{i} > 0)::INT" for i in range(KINDS)) + " > 1 AND " + " + ".join(f"c{i}" for i in range(KINDS)) + " >= 5",
    "mm": "SELECT wp.hash AS withdraw_hash, dp.hash AS deposit_hash FROM wp JOIN dp ON " + " AND ".join(f"wp.c{i} = dp.c{i}" for i in range(KINDS)),
}
MULTI_CLUSTERS = (
    f"SELECT transaction, max(cluster) AS cluster FROM (SELECT w.hash AS transaction, a.hash AS cluster FROM wp a JOIN wq w ON w.address = a.address AND w.ts BETWEEN a.ts - INTERVAL {DAYS} DAY AND a.ts WHERE a.hash IN (SELECT withdraw_hash FROM mm) "
        f"UNION ALL SELECT d.hash, mm.withdraw_hash FROM mm JOIN dp a ON a.hash = mm.deposit_hash JOIN dp d ON d.address = a.address AND d.ts BETWEEN a.ts - INTERVAL {DAYS} DAY AND a.ts) GROUP BY transaction"
)
ORACLE_SQL = {
    "exact_match_links": sql(_EXACT, "deposits", "withdrawals"),
    "exact_match_clusters": sql("SELECT DISTINCT withdraw_hash AS transaction, 'withdraw' AS role, address, pool FROM links UNION ALL SELECT DISTINCT deposit_hash, 'deposit', address, pool FROM links", "deposits", "withdrawals", links=_EXACT),
    "unique_gas_by_pool": sql(_GAS.format(keys="gas_price, pool", pool="AND w.pool = d.pool"), "deposits", "withdrawals"),
    "unique_gas_global": sql(_GAS.format(keys="gas_price", pool=""), "deposits", "withdrawals"),
    "deposit_portfolio": sql(f"SELECT hash, address, {_SHOWN} AS portfolio FROM dp", "deposits", dp=_PORTFOLIOS["dp"]),
    "withdraw_portfolio": sql(f"SELECT hash, address, {_SHOWN} AS portfolio FROM wp", "withdrawals", wq=_PORTFOLIOS["wq"], wp=_PORTFOLIOS["wp"]),
    "multi_denom_matches": sql("SELECT * FROM mm", "deposits", "withdrawals", **_PORTFOLIOS),
    "multi_denom_clusters": sql(MULTI_CLUSTERS, "deposits", "withdrawals", **_PORTFOLIOS),
    "external_pairs": sql(_PAIRS.format(least=3), "external_txs"),
    "linked_pairs_roles": sql(_TYPED, "deposits", "withdrawals", "external_txs", pairs=_PAIRS.format(least=3)),
    "linked_address_links": sql(_LINKED, "deposits", "withdrawals", "external_txs", pairs=_PAIRS.format(least=3), typed=_TYPED),
    "external_between": sql("SELECT hash, from_address, to_address FROM external_txs WHERE (from_address IN (SELECT from_address FROM deposits) AND to_address IN (SELECT recipient_address FROM withdrawals)) OR (from_address IN (SELECT recipient_address FROM withdrawals) AND to_address IN (SELECT from_address FROM deposits))", "deposits", "withdrawals", "external_txs"),
    "reward_claim_links": sql("SELECT DISTINCT claim_hash, deposit_hash, withdraw_hash, pool FROM rl", "deposits", "withdrawals", "claims", "pools", rl=_REWARD),
    "reward_claim_last": sql("SELECT DISTINCT claim_hash, deposit_hash, withdraw_hash, pool FROM rl JOIN (SELECT side, recipient, max(claim_hash) AS claim_hash FROM rl GROUP BY ALL) USING (side, recipient, claim_hash)", "deposits", "withdrawals", "claims", "pools", rl=_REWARD),
    "heuristic_output": sql("SELECT t.address, t.hash AS transaction, t.block_number, t.block_timestamp AS block_ts, m.deposit_hash AS cluster, 'unique_gas_price' AS heuristic FROM (SELECT deposit_hash, withdraw_hash AS hash FROM links UNION SELECT deposit_hash, deposit_hash FROM links) m JOIN txs t ON t.hash = m.hash",
                            "deposits", "withdrawals", links=_GAS.format(keys="gas_price", pool=""), txs="SELECT hash, from_address AS address, block_number, block_timestamp FROM deposits UNION ALL SELECT hash, recipient_address, block_number, block_timestamp FROM withdrawals"),
    "components_linked": sql("SELECT a AS node, min(b) AS component FROM reach GROUP BY a", "external_txs", pairs=_PAIRS.format(least=4), e="SELECT from_address AS a, to_address AS b FROM pairs UNION SELECT to_address, from_address FROM pairs", reach="SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b"),
    "cluster_address_pairs": sql("SELECT cluster, address AS x, y FROM (SELECT cluster, address, lead(address) OVER (PARTITION BY cluster ORDER BY address) AS y FROM (SELECT DISTINCT deposit_hash AS cluster, deposit_address AS address FROM linked UNION SELECT deposit_hash, withdraw_address FROM linked)) WHERE y IS NOT NULL", "deposits", "withdrawals", "external_txs", pairs=_PAIRS.format(least=3), typed=_TYPED, linked=_LINKED),
}
