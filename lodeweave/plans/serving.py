"""Serving queries over all addresses and pools, and relational atoms of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import scalars as S
from lodeweave.operators import joins as J
from lodeweave.operators import reports as R
from lodeweave.operators.components import connected_components
from lodeweave.operators.materialize import materialize
from lodeweave.plans import pools as P
from lodeweave.plans import reuse as U
from lodeweave.sources import fixtures as X
from lodeweave.sources.fixtures import sql

START, END = "2024-01-05 00:00:00", "2024-02-03 00:00:00"


def _reveals(spark, d) -> DataFrame:
    """``heuristic, transaction`` of all five heuristics: address matches (1), unique gas prices (2), equal portfolios (3), linked addresses (4)
    and reward claims (5); written once, as the reports read it several times."""
    out = P.multi_denom_clusters(spark, d).select(F.lit(3).alias("heuristic"), "transaction")
    out = out.unionByName(P.exact_match_clusters(spark, d).select(F.lit(1).alias("heuristic"), "transaction"))
    gas = P.unique_gas_global(spark, d).select(F.explode(F.array("withdraw_hash", "deposit_hash")).alias("transaction")).distinct()
    for h, found in ((2, gas), (4, P.linked_address_members(spark, d)), (5, P.reward_claim_members(spark, d))):
        out = out.unionByName(found.select(F.lit(h).alias("heuristic"), "transaction"))
    return materialize(out, "reveals")


def _transactions(spark, d) -> DataFrame:
    deposits, withdrawals = X.deposits(spark, d), X.withdrawals(spark, d)
    rows = deposits.select(F.col("hash").alias("transaction"), F.col("from_address").alias("address"), F.col("block_timestamp").alias("ts"))
    return rows.unionByName(withdrawals.select(F.col("hash").alias("transaction"), F.col("recipient_address").alias("address"), F.col("block_timestamp").alias("ts")))


def pool_audit(spark, d):
    return R.pool_audit(X.deposits(spark, d), _reveals(spark, d))


def address_stats(spark, d):
    return R.address_stats(X.deposits(spark, d), X.withdrawals(spark, d), _reveals(spark, d))


def compromised_by_pool(spark, d):
    return R.compromised_deposits(X.deposits(spark, d), _reveals(spark, d))


def timeline(spark, d):
    return R.timeline(_reveals(spark, d), _transactions(spark, d), START, END)


def weekly_counts(spark, d):
    return R.weekly_counts(_transactions(spark, d), "ts", "2024-01-01", "2024-03-04")


HEURISTICS = [1, 2, 3, 4, 5]
#: How sure each heuristic is (fixed values of the score).
CONFIDENCE = {1: 1.0, 2: 1.0, 3: 0.5, 4: 0.25, 5: 0.25}


def _counts(spark, d) -> DataFrame:
    return _reveals(spark, d).join(_transactions(spark, d), "transaction").groupBy("address", "heuristic").agg(F.count(F.lit(1)).alias("n"))


def reveal_distribution(spark, d):
    return R.reveal_distribution(_transactions(spark, d).select("address"), _counts(spark, d), HEURISTICS)


def reveal_rank(spark, d):
    counts = materialize(_counts(spark, d), "counts")
    return R.reveal_rank(counts, R.reveal_distribution(_transactions(spark, d).select("address"), counts, HEURISTICS))


def overall_rank(spark, d):
    """The mean over all heuristics of each address's rank; without a reveal it has rank 0."""
    ranks = reveal_rank(spark, d).groupBy("address").agg((F.sum("rank") / len(HEURISTICS)).alias("mean"))
    every = _transactions(spark, d).select("address").distinct().join(ranks, "address", "left")
    mean = F.coalesce("mean", F.lit(0.0))
    return every.select("address", F.round(mean, 5).alias("rank"), F.floor(F.round(mean, 5) * 100).cast("int").alias("percent"))


def _user_clusters(spark, d) -> DataFrame:
    """``address, conf, eoas, exchanges`` of users that reuse deposit addresses: the users of a user's cluster and the exchange clusters of its deposits."""
    pruned = materialize(U._pruned(spark, d), "pruned")
    cluster = U.clusters_of(pruned)
    users = pruned.groupBy(F.col("user_address").alias("node")).agg(F.avg("conf").alias("conf"))
    deposits = pruned.select(F.col("deposit").alias("node")).distinct()
    reached = connected_components(pruned, "deposit", "exchange").select("node", F.col("component").alias("exchange_cluster"))
    eoas = cluster.join(users, "node").groupBy("component").agg(F.count(F.lit(1)).alias("eoas"))
    exchanges = cluster.join(deposits, "node").join(reached, "node").groupBy("component").agg(F.count_distinct("exchange_cluster").alias("exchanges"))
    return users.join(cluster, "node").join(eoas, "component").join(exchanges, "component", "left").select(F.col("node").alias("address"), "conf", "eoas", F.coalesce("exchanges", F.lit(0)).alias("exchanges"))


def exchange_reach(spark, d):
    """Users, the size of their cluster and how many exchange clusters it reaches through its deposits."""
    return _user_clusters(spark, d).select("address", "eoas", "exchanges")


def anonymity_score(spark, d):
    """Reveals by heuristic, each with its confidence, and a user cluster's size and exchanges where the address has one (number n is ``p`` n there)."""
    wide = _counts(spark, d).groupBy("address").agg(*[F.coalesce(F.max(F.when(F.col("heuristic") == h, F.col("n"))), F.lit(0)).alias(f"n{h}") for h in HEURISTICS])
    users = _user_clusters(spark, d).withColumnRenamed("address", "user")
    rows = wide.join(users, F.concat(F.lit("p"), wide["address"].cast("string")) == F.col("user"), "left")
    conf = F.coalesce("conf", F.lit(0.0))
    parts = [(F.lit(c), F.col(f"n{h}")) for h, c in CONFIDENCE.items()]
    parts += [(conf, R.capped(F.coalesce("eoas", F.lit(0)))), (conf * 0.1, F.coalesce("exchanges", F.lit(0)))]
    return rows.select("address", R.anonymity_score(parts).alias("score"))


def heuristic_metadata(spark, d):
    """The addresses that each heuristic finds, as users with full confidence, under the heuristic's own name."""
    rows = _reveals(spark, d).join(_transactions(spark, d), "transaction").select("address", "heuristic").distinct()
    return rows.select("address", F.lit(0).alias("entity"), F.lit(1.0).alias("conf"), F.lit("{}").alias("meta_data"), S.name_of(F.col("heuristic"), S.HEURISTICS).alias("heuristic"))


def components_links(spark, d):
    """Transactions that linked addresses join, by the smallest of them."""
    return connected_components(P.linked_address_stars(spark, d))


def address_scores(spark, d):
    """Scores of all addresses of the pools after overrides: a known address (part of size 1) has none, every seventh address a registered name."""
    scores = anonymity_score(spark, d)
    known = X.known(spark, d).select(F.col("address").alias("key"), F.lit(True).alias("known"))
    rows = scores.join(known, F.concat(F.lit("p"), scores["address"].cast("string")) == F.col("key"), "left")
    name = F.when(F.col("address") % 7 == 0, F.concat(F.col("address").cast("string"), F.lit(".eth")))
    return rows.select("address", R.overridden_score(F.col("score"), name, F.coalesce("known", F.lit(False))).alias("score"))


def deposit_map(spark, d):
    return R.deposit_map(X.deposits(spark, d)).select("address", "pool", F.array_join(F.array_sort(F.transform("transactions", lambda x: x.cast("string"))), ",").alias("transactions"), "span")


def listed_transactions(spark, d):
    return J.in_list(X.external_txs(spark, d).select("hash", "from_address"), "hash", X.claims(spark, d).unionByName(X.claims(spark, d)))


def cluster_page(spark, d):
    meta = U.dar_metadata(spark, d)
    found = R.address_filter(meta, min_conf=0.5, entity=0)
    return R.labelled(R.page(found, [F.col("conf").desc(), F.col("address")], number=1, limit=20))


def page_count(spark, d):
    return U.dar_metadata(spark, d).groupBy("entity").agg(R.pages_of(F.count(F.lit(1))).cast("long").alias("pages"))


def cluster_expansion(spark, d):
    table = P.linked_address_links(spark, d).select(F.col("deposit_hash").alias("cluster"), F.col("withdraw_address").alias("address"), F.col("withdraw_hash").alias("transaction"))
    asked = X.claims(spark, d).select(F.col("recipient").alias("address")).distinct()
    return R.cluster_members(table, asked)


def time_slice(spark, d):
    """Both days of the slice count; it is a range of times, so the scan skips row groups by it."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10", "2024-01-18"))
    return X.table(spark, d, "events").where((F.col("ts") >= low) & (F.col("ts") < high)).select("event_id", "user_id")


def block_slice(spark, d):
    return X.transfers(spark, d).where(F.col("block").between(100, 130)).select("transaction", "block")


def entity_labels(spark, d):
    rows = U.dar_metadata(spark, d)
    return rows.select("address", S.name_of(F.col("entity"), S.ENTITIES).alias("entity"), S.confidence_label(F.col("conf")).alias("label"))


def pool_helpers(spark, d):
    rows = X.deposits(spark, d).groupBy("pool").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(X.pools(spark)), "pool", "left")  # one row for each pool
    parts = F.split(F.coalesce("label", F.raise_error(F.concat(F.lit("no such pool: "), F.col("pool").cast("string")))), " ")
    return rows.select("pool", parts[0].cast("double").alias("amount"), parts[1].alias("currency"), "n")


def set_operations(spark, d):
    a = X.deposits(spark, d).select(F.col("from_address").alias("address")).distinct()
    b = X.withdrawals(spark, d).select(F.col("recipient_address").alias("address")).distinct()
    kinds = {"union": a.union(b).distinct(), "both": a.intersect(b), "only_deposits": a.join(b, "address", "left_anti"), "all": a.unionAll(b)}
    out = None
    for name, rows in kinds.items():
        own = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("address"), F.lit(0)).alias("checksum")).withColumn("kind", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def anonymity_entropy(spark, d):
    audit = pool_audit(spark, d)
    return audit.where("uncompromised > 0").select("pool", F.round(F.ln(F.col("total").cast("double")), 6).alias("entropy"), F.round(R.set_entropy(F.col("total"), F.col("uncompromised")), 6).alias("gain"))


def rounding(spark, d):
    rows = X.table(spark, d, "events")
    return rows.select("event_id", S.round_half_even(F.col("value"), 1).alias("r1"), S.clip(F.col("value"), 5.0, 20.0).alias("clipped"), S.safe_cast(F.get_json_object("props", "$.k"), "int", -1).alias("k"))


def abi_decode(spark, d):
    """Calls written from the events, and what the decoder reads from them."""
    rows = X.events(spark, d).where("event_type IN ('purchase', 'signup')")

    def hex_word(x: Column) -> Column:
        return F.lpad(F.lower(F.hex(x.cast("long"))), 64, "0")

    call = F.when(F.col("event_type") == "purchase", F.concat(F.lit(S.DEPOSIT_SELECTOR), hex_word(F.col("k")), hex_word(F.col("event_id")), hex_word(F.lit(96)))).otherwise(
        F.concat(F.lit(S.WITHDRAW_SELECTOR), hex_word(F.col("k")), hex_word(F.lit(256)), hex_word(F.lit(1)), hex_word(F.lit(2)), hex_word(F.col("user_id")), hex_word(F.lit(0)), hex_word(F.lit(0)), hex_word(F.lit(0)))
    )
    calls = rows.select("event_id", call.alias("input"))
    kind = F.when(S.selector(F.col("input")) == S.DEPOSIT_SELECTOR, "deposit").when(S.selector(F.col("input")) == S.WITHDRAW_SELECTOR, "withdraw")
    return calls.select("event_id", kind.alias("kind"), S.word_address(F.col("input"), 0).alias("pool_address"), S.word_address(F.col("input"), 4).alias("recipient"), S.word_number(F.col("input"), 1).alias("second"), S.is_address(S.word_address(F.col("input"), 0)).alias("valid"))


def unique_senders(spark, d):
    return J.unique_rows(X.transfers(spark, d), ["from_address", "block"]).select("transaction", "from_address")


def portfolio_key_counts(spark, d):
    """How often each portfolio of deposits occurs."""
    return P.deposit_portfolio(spark, d).groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    pool_audit, address_stats, compromised_by_pool, timeline, weekly_counts, reveal_distribution, reveal_rank, overall_rank, exchange_reach, anonymity_score, heuristic_metadata, components_links, address_scores, deposit_map, listed_transactions, cluster_page, page_count,
    cluster_expansion, time_slice, block_slice, entity_labels, pool_helpers, set_operations, anonymity_entropy, rounding, abi_decode, unique_senders, portfolio_key_counts,
)}

_REVEALS = {
    "xm": P._EXACT, "ug": P._GAS.format(keys="gas_price", pool=""), "pairs": P._PAIRS.format(least=3), "typed": P._TYPED, "linked": P._LINKED,
    **P._PORTFOLIOS, "mc": P.MULTI_CLUSTERS, "rl": P._REWARD,
    "reveals": " UNION ALL ".join(f"SELECT {h} AS heuristic, transaction FROM (SELECT withdraw_hash AS transaction FROM {t} UNION SELECT deposit_hash FROM {t})" for h, t in ((1, "xm"), (2, "ug"), (4, "linked"), (5, "rl"))) + " UNION ALL SELECT 3, transaction FROM mc",
    "txs": "SELECT hash AS transaction, from_address AS address, block_timestamp AS ts FROM deposits UNION ALL SELECT hash, recipient_address, block_timestamp FROM withdrawals",
    "cnt": "SELECT address, heuristic, count(*) AS n FROM reveals JOIN txs USING (transaction) GROUP BY ALL",
    "dist": "SELECT heuristic, reveals, count(*) AS frequency FROM (SELECT h.heuristic, coalesce(c.n, 0) AS reveals FROM (SELECT DISTINCT address FROM txs) a CROSS JOIN (VALUES (1), (2), (3), (4), (5)) h(heuristic) LEFT JOIN cnt c ON c.address = a.address AND c.heuristic = h.heuristic) GROUP BY ALL",
    "audit": "SELECT d.pool, count(*) AS total, count(f.transaction) AS compromised, count(*) - count(f.transaction) AS uncompromised, " + ", ".join(f"coalesce(sum(f.h{h}), 0)::BIGINT AS by_{h}" for h in range(1, 6))
             + " FROM deposits d LEFT JOIN (SELECT transaction, " + ", ".join(f"max((heuristic = {h})::INT) AS h{h}" for h in range(1, 6)) + " FROM reveals GROUP BY transaction) f ON f.transaction = d.hash GROUP BY d.pool",
}


def _sql(body: str) -> str:
    return sql(body, "deposits", "withdrawals", "external_txs", "claims", "pools", **_REVEALS)


_RANKS = "SELECT c.address, c.heuristic, c.n, round(b.below / b.total, 6) AS rank, floor(b.below / b.total * 100)::INT AS percent FROM cnt c JOIN (SELECT heuristic, reveals, coalesce(sum(frequency) OVER (PARTITION BY heuristic ORDER BY reveals ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below, sum(frequency) OVER (PARTITION BY heuristic)::DOUBLE AS total FROM dist) b ON b.heuristic = c.heuristic AND b.reveals = c.n"
_SCORE = "SELECT address, round(1 - tanh(0.1 * (n1 + n2 + 0.5 * n3 + 0.25 * n4 + 0.25 * n5 + coalesce(conf * least(eoas, 1000) + 0.1 * conf * exchanges, 0))), 3) AS score FROM (SELECT address, " + ", ".join(f"coalesce(max(n) FILTER (WHERE heuristic = {h}), 0)::DOUBLE AS n{h}" for h in HEURISTICS) + " FROM cnt GROUP BY address) s LEFT JOIN (SELECT address AS u, conf, eoas, exchanges FROM uc) ON u = 'p' || address"


def _scores(body: str) -> str:
    return sql(body, "deposits", "withdrawals", "external_txs", "claims", "pools", "transfers", "known", "miners", **_REVEALS, **U._VIEWS, **U.USER_CLUSTERS, sc=_SCORE)


_META = "SELECT address, entity, round(conf, 6) AS conf FROM meta"
ORACLE_SQL = {
    "pool_audit": _sql("SELECT * FROM audit"),
    "address_stats": _sql("SELECT address, sum(d)::BIGINT AS deposits, sum(w)::BIGINT AS withdrawals, coalesce(sum(seen), 0)::BIGINT AS compromised FROM (SELECT t.*, s.seen FROM (SELECT from_address AS address, hash, 1 AS d, 0 AS w FROM deposits UNION ALL SELECT recipient_address, hash, 0, 1 FROM withdrawals) t LEFT JOIN (SELECT DISTINCT transaction, 1 AS seen FROM reveals) s ON s.transaction = t.hash) GROUP BY address"),
    "compromised_by_pool": _sql("SELECT from_address AS address, pool, hash AS transaction, heuristic FROM deposits JOIN reveals ON transaction = hash"),
    "timeline": _sql(f"SELECT ts, heuristic, address, transaction FROM reveals JOIN txs USING (transaction) WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"),
    "weekly_counts": _sql("SELECT w.week::INT AS week, count(t.ts) AS n FROM range(9) w(week) LEFT JOIN txs t ON t.ts::DATE >= DATE '2024-01-01' AND t.ts::DATE < DATE '2024-03-04' AND date_diff('day', DATE '2024-01-01', t.ts::DATE) // 7 = w.week GROUP BY w.week"),
    "reveal_distribution": _sql("SELECT * FROM dist"),
    "reveal_rank": _sql(_RANKS),
    "overall_rank": _sql("SELECT address, round(r, 5) AS rank, floor(round(r, 5) * 100)::INT AS percent FROM (SELECT a.address, coalesce(sum(k.rank), 0) / 5 AS r FROM (SELECT DISTINCT address FROM txs) a LEFT JOIN (" + _RANKS + ") k ON k.address = a.address GROUP BY a.address)"),
    "exchange_reach": U._sql("SELECT address, eoas, exchanges FROM uc", **U.USER_CLUSTERS),
    "anonymity_score": _scores("SELECT * FROM sc"),
    "address_scores": _scores("SELECT address, CASE WHEN 'p' || address IN (SELECT address FROM known) THEN 0 WHEN address % 7 = 0 THEN least(score, 0.9) ELSE score END AS score FROM sc"),
    "heuristic_metadata": _sql("SELECT DISTINCT address, 0 AS entity, 1.0::DOUBLE AS conf, '{}' AS meta_data, ([" + ", ".join(f"'{h}'" for h in S.HEURISTICS) + "])[heuristic + 1] AS heuristic FROM reveals JOIN txs USING (transaction)"),
    "components_links": sql("SELECT * FROM cl", "deposits", "withdrawals", "external_txs", pairs=P._PAIRS.format(least=3), typed=P._TYPED, linked=P._LINKED, **U._reach("cl", "SELECT withdraw_hash AS a, deposit_hash AS b FROM linked")),
    "deposit_map": sql("SELECT from_address AS address, pool, string_agg(DISTINCT hash::VARCHAR, ',' ORDER BY hash::VARCHAR) AS transactions, (epoch_us(max(block_timestamp)) - epoch_us(min(block_timestamp))) // 1000000 AS span FROM deposits GROUP BY ALL", "deposits"),
    "listed_transactions": sql("SELECT hash, from_address FROM external_txs WHERE hash IN (SELECT hash FROM claims)", "external_txs", "claims"),
    "cluster_page": U._sql(f"SELECT address, entity, conf, CASE WHEN conf > 0.98 THEN 'high' WHEN conf > 0.95 THEN 'medium' ELSE 'low' END AS label FROM ({_META}) WHERE conf >= 0.5 AND entity = 0 ORDER BY conf DESC, address LIMIT 20 OFFSET 20"),
    "page_count": U._sql("SELECT entity, ceil(count(*) / 20)::BIGINT AS pages FROM meta GROUP BY entity"),
    "cluster_expansion": _sql("SELECT deposit_hash AS cluster, withdraw_address AS address, withdraw_hash AS transaction FROM linked WHERE deposit_hash IN (SELECT deposit_hash FROM linked WHERE withdraw_address IN (SELECT recipient FROM claims))"),
    "time_slice": "SELECT event_id, user_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-17'",
    "block_slice": sql("SELECT transaction, block FROM transfers WHERE block BETWEEN 100 AND 130", "transfers"),
    "entity_labels": U._sql(f"SELECT address, (['eoa', 'deposit', 'exchange'])[entity + 1] AS entity, CASE WHEN conf > 0.98 THEN 'high' WHEN conf > 0.95 THEN 'medium' ELSE 'low' END AS label FROM ({_META})"),
    "pool_helpers": sql("SELECT pool, split_part(label, ' ', 1)::DOUBLE AS amount, split_part(label, ' ', 2) AS currency, n FROM (SELECT pool, count(*) AS n FROM deposits GROUP BY pool) JOIN pools USING (pool)", "deposits", "pools"),
    "set_operations": sql("SELECT count(*) AS n, coalesce(sum(address), 0)::BIGINT AS checksum, 'union' AS kind FROM (SELECT address FROM a UNION SELECT address FROM b) UNION ALL SELECT count(*), coalesce(sum(address), 0)::BIGINT, 'both' FROM (SELECT address FROM a INTERSECT SELECT address FROM b) UNION ALL SELECT count(*), coalesce(sum(address), 0)::BIGINT, 'only_deposits' FROM (SELECT address FROM a EXCEPT SELECT address FROM b) UNION ALL SELECT count(*), coalesce(sum(address), 0)::BIGINT, 'all' FROM (SELECT address FROM a UNION ALL SELECT address FROM b)",
                          "deposits", "withdrawals", a="SELECT DISTINCT from_address AS address FROM deposits", b="SELECT DISTINCT recipient_address AS address FROM withdrawals"),
    "anonymity_entropy": _sql("SELECT pool, round(ln(total), 6) AS entropy, round(ln(total) - ln(uncompromised), 6) AS gain FROM audit WHERE uncompromised > 0"),
    "rounding": "SELECT event_id, round_even(value * 10, 0) / 10 AS r1, least(greatest(value, 5.0), 20.0) AS clipped, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), -1) AS k FROM events",
    "abi_decode": sql("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'deposit' ELSE 'withdraw' END AS kind, '0x' || lpad(lower(to_hex(k)), 40, '0') AS pool_address, CASE event_type WHEN 'signup' THEN '0x' || lpad(lower(to_hex(user_id)), 40, '0') END AS recipient, CASE event_type WHEN 'purchase' THEN event_id ELSE 256 END AS second, true AS valid FROM ev WHERE event_type IN ('purchase', 'signup')", "ev"),
    "unique_senders": sql("SELECT transaction, from_address FROM (SELECT *, count(*) OVER (PARTITION BY from_address, block) AS n FROM transfers) WHERE n = 1", "transfers"),
    "portfolio_key_counts": sql(f"SELECT portfolio, count(*) AS n FROM (SELECT {P._SHOWN} AS portfolio FROM dp) GROUP BY portfolio", "deposits", dp=P._PORTFOLIOS["dp"]),
}
