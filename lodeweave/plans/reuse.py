"""Queries over ledger transfers: reuse of deposit addresses, its metadata and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.scalars import round_half_even
from lodeweave.operators import clusters as C
from lodeweave.operators import heuristics as H
from lodeweave.operators import joins as J
from lodeweave.operators import reports as R
from lodeweave.operators.components import connected_components
from lodeweave.operators.materialize import materialize
from lodeweave.plans import pools as P
from lodeweave.sources import fixtures as X
from lodeweave.sources.fixtures import sql

T_MAX, A_MAX = 100, 0.01
#: Matches of less confidence take no part in clusters over time.
LEAST_CONF = 0.5


def _matches(spark, d) -> DataFrame:
    known = X.known(spark, d)
    exchanges, _ = H.split_known(known)
    found = H.reuse_matches(X.transfers(spark, d), exchanges, known, X.miners(spark, d), A_MAX, T_MAX)
    return found.withColumn("conf", H.reuse_confidence(F.col("t_diff"), F.col("a_diff"), A_MAX, T_MAX))


def _pruned(spark, d) -> DataFrame:
    return H.prune_matches(materialize(_matches(spark, d), "matches"))


def clusters_of(pruned: DataFrame) -> DataFrame:
    """``node, component`` of users and the deposit addresses that they share."""
    return connected_components(pruned, "user_address", "deposit")


def dar_matches(spark, d):
    return _matches(spark, d).select("user_address", "deposit", "exchange", "forward_tx", "receipt_tx", "t_diff")


def dar_confidence(spark, d):
    found = _matches(spark, d).select("user_address", "deposit", "exchange", "t_diff", F.round("a_diff", 6).alias("a_diff"), F.round("conf", 6).alias("conf"))
    return found.distinct()


def dar_transactions(spark, d):
    return _matches(spark, d).select("user_address", "deposit", F.col("receipt_tx").alias("transaction"), F.col("receipt_block").alias("block_number")).distinct()


def dar_metadata(spark, d):
    return H.reuse_metadata(_matches(spark, d)).select("address", "entity", F.round("conf", 6).alias("conf"))


def dar_attributes(spark, d):
    return H.reuse_attributes(_matches(spark, d), X.known(spark, d).select("address", "name"))


def known_split(spark, d):
    exchanges, others = H.split_known(X.known(spark, d))
    return exchanges.withColumn("exchange", F.lit(True)).unionByName(others.withColumn("exchange", F.lit(False)))


def dar_pruned(spark, d):
    return _pruned(spark, d).select("user_address", "deposit", "exchange", "forward_tx")


def metadata_argmax(spark, d):
    """The best row of each address over the reuse metadata and, from a second source, senders by mean value."""
    first = H.reuse_metadata(_matches(spark, d)).withColumn("source", F.lit(0))
    second = X.transfers(spark, d).groupBy(F.col("from_address").alias("address")).agg(F.sum(F.rint(F.col("value") * 1000).cast("long")).alias("s"), F.count("value").alias("n"))
    second = second.select("address", F.lit(0).alias("entity"), round_half_even(F.col("s") / F.col("n") / 100_000, 6).alias("conf"), F.lit(1).alias("source"))  # whole thousandths, so no order of sums matters
    rows = first.unionByName(second).withColumn("conf", F.round("conf", 6))
    return J.first_per_key(rows, ["address"], F.col("conf").desc_nulls_last(), F.col("source"), F.col("entity"))


def _edges(spark, d) -> DataFrame:
    found = _pruned(spark, d)
    return found.select(F.col("user_address").alias("a"), F.col("deposit").alias("b")).distinct()


def components_dar(spark, d):
    return connected_components(_edges(spark, d), "a", "b")


def exchange_components(spark, d):
    return connected_components(_pruned(spark, d), "deposit", "exchange")


def components_users(spark, d):
    """Users by shared deposit addresses and by the pool heuristics' pairs of addresses (user n of the pools is ``p`` n here)."""
    pairs = P.cluster_address_pairs(spark, d).select(*[F.concat(F.lit("p"), F.col(c).cast("string")).alias(c2) for c, c2 in (("x", "a"), ("y", "b"))])
    return connected_components(_edges(spark, d).unionByName(pairs), "a", "b")


def _responses(spark, d) -> DataFrame:
    pruned = materialize(_pruned(spark, d), "pruned")
    named = lambda rows: rows.select(F.col("node").alias("address"), F.col("component").alias("cluster"))
    meta = J.first_per_key(H.reuse_metadata(pruned).withColumn("conf", F.round("conf", 6)), ["address"], F.col("entity").desc())
    return C.responses(named(clusters_of(pruned)), named(connected_components(pruned, "deposit", "exchange")), meta)


def address_responses(spark, d):
    return _responses(spark, d)


def address_mates(spark, d):
    """The others of the clusters of those addresses that external transactions go to (user n of the pools is ``p`` n) and of all exchanges."""
    asked = X.external_txs(spark, d).select(F.concat(F.lit("p"), F.col("to_address").cast("string")).alias("address")).unionByName(H.split_known(X.known(spark, d))[0])
    return C.cluster_mates(materialize(_responses(spark, d), "addresses"), asked)


def known_attributes(spark, d):
    return R.known_attributes(X.known(spark, d))


def pair_metadata(spark, d):
    pairs = _matches(spark, d).select(F.col("user_address").alias("x"), F.col("deposit").alias("y"), "conf")
    return H.pair_metadata(pairs).withColumn("conf", F.round("conf", 6))


def cluster_merge(spark, d):
    """Components of today merged into those of the first half of the blocks; both from confident matches only."""
    found = materialize(_pruned(spark, d).where(F.col("conf") >= LEAST_CONF), "confident")
    named = lambda rows: clusters_of(rows).select(F.col("node").alias("address"), F.col("component").alias("cluster"))
    return C.merge_clusters(named(found), named(found.where("receipt_block < 400")))


def _loads(spark, d) -> tuple[DataFrame, DataFrame]:
    """Metadata of users and deposits as an old load, of deposits and exchanges as a new one."""
    meta = H.reuse_metadata(_matches(spark, d)).select("address", "entity", F.round("conf", 6).alias("conf"))
    old = J.first_per_key(meta.where("entity <> 2"), ["address"], "entity").withColumn("user_cluster", F.lit("old"))
    return old, J.first_per_key(meta.where("entity <> 0"), ["address"], "entity").withColumn("user_cluster", F.concat(F.lit("new-"), "address"))


def upsert_address(spark, d):
    return J.upsert(*_loads(spark, d), "address", ["user_cluster"])


def append_new_pools(spark, d):
    old = X.deposits(spark, d).where("pool < 7").groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    new = X.withdrawals(spark, d).where("pool < 12").groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    return J.append_new(old, new, "pool")


def known_address_precedence(spark, d):
    """Labels of three sources; an earlier source wins an address."""
    supplier = X.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("address"), F.col("s_name").alias("name"))
    part = X.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("address"), F.col("p_name").alias("name"))
    ledger = X.transfers(spark, d).select(F.col("to_address").alias("address"), F.lit("ledger").alias("name")).distinct()
    kept = J.merge_by_precedence([supplier.where("address <> 's7'"), part, ledger], "address")
    return kept


QUERIES = {f.__name__: f for f in (
    dar_matches, dar_confidence, dar_transactions, dar_metadata, dar_attributes, known_split, dar_pruned, metadata_argmax, components_dar, components_users, address_responses, address_mates, known_attributes, pair_metadata, exchange_components, cluster_merge,
    upsert_address, append_new_pools, known_address_precedence,
)}

_VIEWS = {
    "tx": "SELECT *, round_even(value * 10, 0) / 10 AS rv FROM transfers WHERE from_address NOT IN (SELECT address FROM miners)",
    "fw": "SELECT * FROM tx WHERE to_address IN (SELECT address FROM known WHERE account_type = 'eoa' AND entity = 'exchange')",
    "rc": "SELECT * FROM tx WHERE to_address IN (SELECT from_address FROM fw WHERE from_address NOT IN (SELECT address FROM known)) AND from_address NOT IN (SELECT address FROM known)",
    "sq": "SELECT from_address AS deposit, rv, block, 1 AS side, transaction, value, to_address AS exchange, NULL::VARCHAR AS r FROM fw UNION ALL SELECT to_address, rv, block, 0, transaction, value, NULL, transaction || '|' || from_address || '|' || value || '|' || block FROM rc",
    "af": "SELECT *, split_part(l, '|', 1) AS lt, split_part(l, '|', 2) AS lu, split_part(l, '|', 3)::DOUBLE AS lv, split_part(l, '|', 4)::BIGINT AS lb FROM (SELECT *, last_value(r IGNORE NULLS) OVER (PARTITION BY deposit, rv ORDER BY block, side, transaction ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM sq) WHERE l IS NOT NULL",
    "m": f"SELECT lu AS user_address, deposit, exchange, transaction AS forward_tx, lt AS receipt_tx, lb AS receipt_block, block - lb AS t_diff, lv - value AS a_diff, "
         f"((1 - least(greatest(abs(block - lb) / {T_MAX}.0::DOUBLE, 0), 1)) + (1 - least(greatest(abs(lv - value) / {A_MAX}::DOUBLE, 0), 1))) / 2 AS conf "
         f"FROM af WHERE side = 1 AND l IS NOT NULL AND block - lb <= {T_MAX} AND round_even((lv - value) * 1000, 0) / 1000 BETWEEN 0 AND {A_MAX}",
    "meta": "SELECT user_address AS address, 0 AS entity, avg(conf) AS conf FROM m GROUP BY ALL UNION ALL SELECT deposit, 1, avg(conf) FROM m GROUP BY ALL UNION ALL SELECT exchange, 2, avg(conf) FROM m GROUP BY ALL",
    "p1": "SELECT * FROM m WHERE user_address NOT IN (SELECT exchange FROM m) AND deposit NOT IN (SELECT exchange FROM m)",
    "p2": "SELECT * FROM p1 WHERE deposit NOT IN (SELECT user_address FROM p1)",
}


def _sql(body: str, **more: str) -> str:
    return sql(body, "transfers", "known", "miners", **_VIEWS, **more)


def _reach(name: str, pairs: str) -> dict[str, str]:
    return {f"{name}_e": f"{pairs}", f"{name}_s": f"SELECT a, b FROM {name}_e UNION SELECT b, a FROM {name}_e", f"{name}_r": f"SELECT a, a AS b FROM {name}_s UNION SELECT r.a, e.b FROM {name}_r r JOIN {name}_s e ON e.a = r.b", name: f"SELECT a AS node, min(b) AS component FROM {name}_r GROUP BY a"}


USER_CLUSTERS = {
    **_reach("du", "SELECT DISTINCT user_address AS a, deposit AS b FROM p2"), **_reach("dx", "SELECT DISTINCT deposit AS a, exchange AS b FROM p2"),
    "us": "SELECT user_address AS node, avg(conf) AS conf FROM p2 GROUP BY user_address",
    "ue": "SELECT component, count(*) AS eoas FROM du JOIN us USING (node) GROUP BY component",
    "ux": "SELECT du.component, count(DISTINCT dx.component) AS exchanges FROM du JOIN (SELECT DISTINCT deposit AS node FROM p2) d ON d.node = du.node JOIN dx ON dx.node = du.node GROUP BY du.component",
    "uc": "SELECT us.node AS address, conf, eoas, coalesce(exchanges, 0) AS exchanges FROM us JOIN du USING (node) JOIN ue USING (component) LEFT JOIN ux USING (component)",
}
RESPONSES = (
    "SELECT a.address, a.entity, round(a.conf, 6) AS conf, du.component AS user_cluster, dx.component AS exchange_cluster FROM (SELECT address, max(entity) AS entity, arg_max(conf, entity) AS conf FROM "
    "(SELECT user_address AS address, 0 AS entity, avg(conf) AS conf FROM p2 GROUP BY ALL UNION ALL SELECT deposit, 1, avg(conf) FROM p2 GROUP BY ALL UNION ALL SELECT exchange, 2, avg(conf) FROM p2 GROUP BY ALL) GROUP BY address) a "
    "LEFT JOIN du ON du.node = a.address LEFT JOIN dx ON dx.node = a.address"
)
ORACLE_SQL = {
    "dar_matches": _sql("SELECT user_address, deposit, exchange, forward_tx, receipt_tx, t_diff FROM m"),
    "dar_confidence": _sql("SELECT DISTINCT user_address, deposit, exchange, t_diff, round(a_diff, 6) AS a_diff, round(conf, 6) AS conf FROM m"),
    "dar_transactions": _sql("SELECT DISTINCT user_address, deposit, receipt_tx AS transaction, receipt_block AS block_number FROM m"),
    "dar_metadata": _sql("SELECT address, entity, round(conf, 6) AS conf FROM meta"),
    "dar_pruned": _sql("SELECT user_address, deposit, exchange, forward_tx FROM p2"),
    "metadata_argmax": _sql(
        "SELECT address, entity, conf, source FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY conf DESC NULLS LAST, source, entity) AS k FROM "
        "(SELECT address, entity, round(conf, 6) AS conf, 0 AS source FROM meta UNION ALL SELECT from_address, 0, round_even(sum(round_even(value * 1000, 0)::BIGINT)::DOUBLE / count(*) / 100000 * 1000000, 0) / 1000000, 1 FROM transfers GROUP BY from_address)) WHERE k = 1"),
    "components_dar": _sql("SELECT * FROM c", **_reach("c", "SELECT DISTINCT user_address AS a, deposit AS b FROM p2")),
    "exchange_components": _sql("SELECT * FROM c", **_reach("c", "SELECT DISTINCT deposit AS a, exchange AS b FROM p2")),
    "components_users": sql("SELECT * FROM c", "transfers", "known", "miners", "deposits", "withdrawals", "external_txs", **_VIEWS, pairs=P._PAIRS.format(least=3), typed=P._TYPED, linked=P._LINKED,
        cap="SELECT cluster, address AS x, lead(address) OVER (PARTITION BY cluster ORDER BY address) AS y FROM (SELECT DISTINCT deposit_hash AS cluster, deposit_address AS address FROM linked UNION SELECT deposit_hash, withdraw_address FROM linked)",
        **_reach("c", "SELECT DISTINCT user_address AS a, deposit AS b FROM p2 UNION SELECT 'p' || x, 'p' || y FROM cap WHERE y IS NOT NULL")),
    "dar_attributes": _sql(
        "SELECT DISTINCT user_address AS address, 0 AS entity, '{}' AS meta_data FROM m UNION ALL SELECT DISTINCT exchange, 2, '{\"name\":' || coalesce('\"' || name || '\"', 'null') || '}' FROM m LEFT JOIN known k ON k.address = exchange "
        "UNION ALL SELECT deposit, 1, '{\"exchange_address\":\"' || exchange || '\",\"exchange_name\":' || coalesce('\"' || name || '\"', 'null') || ',\"name\":' || coalesce('\"Deposit for ' || name || '\"', 'null') || '}' "
        "FROM (SELECT deposit, arg_min(exchange, (forward_tx, exchange)) AS exchange FROM m GROUP BY deposit) f LEFT JOIN known k ON k.address = exchange"),
    "address_responses": _sql("SELECT * FROM ar", **USER_CLUSTERS, ar=RESPONSES),
    "address_mates": sql(
        "SELECT DISTINCT o.address AS asked, m.address, m.entity, m.conf FROM ar o JOIN ar m ON m.address <> o.address AND CASE WHEN o.entity = 2 THEN m.exchange_cluster = o.exchange_cluster ELSE m.user_cluster = o.user_cluster END "
        "WHERE o.address IN (SELECT 'p' || to_address FROM external_txs UNION SELECT address FROM known WHERE account_type = 'eoa' AND entity = 'exchange')",
        "transfers", "known", "miners", "external_txs", **_VIEWS, **USER_CLUSTERS, ar=RESPONSES),
    "known_attributes": sql("SELECT address, coalesce(name, '') AS name, coalesce(account_type, '') AS account_type, coalesce(entity, '') AS entity FROM known WHERE coalesce(name, '') || coalesce(account_type, '') || coalesce(entity, '') <> ''", "known"),
    "pair_metadata": _sql("SELECT address, 0 AS entity, round(max(conf), 6) AS conf FROM (SELECT user_address AS address, conf FROM m UNION ALL SELECT deposit, conf FROM m) GROUP BY address"),
    "known_split": sql("SELECT address, coalesce(account_type = 'eoa', false) AND coalesce(entity = 'exchange', false) AS exchange FROM known", "known"),
    "cluster_merge": _sql(
        "SELECT address, cluster FROM merged",
        **_reach("n", f"SELECT DISTINCT user_address AS a, deposit AS b FROM p2 WHERE conf >= {LEAST_CONF}"), **_reach("o", f"SELECT DISTINCT user_address AS a, deposit AS b FROM p2 WHERE conf >= {LEAST_CONF} AND receipt_block < 400"),
        votes="SELECT n.component AS new, o.component AS old, count(*) AS k FROM n JOIN o ON o.node = n.node GROUP BY ALL",
        chosen="SELECT new, old FROM (SELECT *, row_number() OVER (PARTITION BY new ORDER BY k DESC, old) AS r FROM votes) WHERE r = 1",
        merged="SELECT n.node AS address, coalesce(c.old, n.component) AS cluster FROM n LEFT JOIN chosen c ON c.new = n.component"),
    "upsert_address": _sql(
        "SELECT coalesce(o.address, n.address) AS address, CASE WHEN o.address IS NULL THEN n.entity ELSE o.entity END AS entity, CASE WHEN o.address IS NULL THEN n.conf ELSE o.conf END AS conf, CASE WHEN n.address IS NULL THEN 'old' ELSE 'new-' || n.address END AS user_cluster FROM o FULL JOIN n ON o.address = n.address",
        o="SELECT address, min(entity) AS entity, arg_min(round(conf, 6), entity) AS conf FROM meta WHERE entity <> 2 GROUP BY address", n="SELECT address, min(entity) AS entity, arg_min(round(conf, 6), entity) AS conf FROM meta WHERE entity <> 0 GROUP BY address"),
    "append_new_pools": sql("SELECT pool, count(*) AS n FROM deposits WHERE pool < 7 GROUP BY pool UNION ALL SELECT pool, count(*) FROM withdrawals WHERE pool < 12 AND pool NOT IN (SELECT pool FROM deposits WHERE pool < 7) GROUP BY pool", "deposits", "withdrawals"),
    "known_address_precedence": sql("SELECT 's' || s_suppkey AS address, s_name AS name FROM supplier WHERE s_suppkey <> 7 UNION ALL SELECT 'p' || p_partkey, p_name FROM part UNION ALL SELECT DISTINCT to_address, 'ledger' FROM transfers WHERE to_address = 's7' OR to_address LIKE 'x%' OR to_address NOT IN (SELECT 's' || s_suppkey FROM supplier) AND to_address NOT IN (SELECT 'p' || p_partkey FROM part)", "transfers"),
}
