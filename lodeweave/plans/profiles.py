"""Reports on addresses over all six heuristics: reuse of deposit addresses (0) and the five of the pools (1 to 5).

User n of the pools, vector n and part n of the transfers are the address ``p`` n. Transfers have no time of day: block b is the day
b modulo 60 from the first day of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import scalars as S
from lodeweave.operators import graphs as G
from lodeweave.operators import heuristics as H
from lodeweave.operators import joins as J
from lodeweave.operators import known as K
from lodeweave.operators import reports as R
from lodeweave.operators import vector_index as V
from lodeweave.operators.components import connected_components
from lodeweave.operators.materialize import materialize
from lodeweave.plans import graph as GP
from lodeweave.plans import pools as P
from lodeweave.plans import reuse as U
from lodeweave.plans import serving as SV
from lodeweave.sources import fixtures as X
from lodeweave.sources.fixtures import sql

HEURISTICS = [0, *SV.HEURISTICS]
SAMPLE, SEED = 100, 42
TODAY, MONTHS = "2024-02-28", [1, 3, 6, 12, 36, 60]


def _user(column: str):
    return F.concat(F.lit("p"), F.col(column).cast("string"))


def _pool_transactions(spark, d) -> DataFrame:
    return SV._transactions(spark, d).withColumn("address", _user("address"))


def _all_reveals(spark, d) -> DataFrame:
    """``address, heuristic, transaction, ts`` of all six heuristics. Each report reads it once and in few columns, so it isn't written."""
    pool = SV._reveals(spark, d).join(_pool_transactions(spark, d), "transaction").select("address", "heuristic", F.col("transaction").cast("string").alias("transaction"), "ts")
    day = F.date_add(F.lit(X.EPOCH).cast("date"), F.pmod(F.col("block_number"), F.lit(60)).cast("int")).cast("timestamp_ntz")
    reuse = U.dar_transactions(spark, d).select(F.col("user_address").alias("address"), F.lit(0).alias("heuristic"), "transaction", day.alias("ts"))
    return pool.unionByName(reuse)


def _counts(spark, d) -> DataFrame:
    return materialize(_all_reveals(spark, d).groupBy("address", "heuristic").agg(F.count(F.lit(1)).alias("n")), "counts")


def _sampled(spark, d, counts: DataFrame) -> DataFrame:
    depositors = X.deposits(spark, d).select(_user("from_address").alias("address"))
    return R.reveal_distribution(R.hash_sample(depositors, SAMPLE, SEED), counts, HEURISTICS)


def reveal_counts_all(spark, d):
    return _counts(spark, d)


def reveal_distribution_sampled(spark, d):
    """How many of a seeded sample of depositors have so many reveals, by heuristic."""
    return _sampled(spark, d, _counts(spark, d))


def reveal_rank_all(spark, d):
    counts = _counts(spark, d)
    return R.rank_within(counts, _sampled(spark, d, counts))


def overall_rank_all(spark, d):
    """The mean of an address's six ranks, 0 where it has no reveal."""
    # ranks are whole millionths, so their sum and its rounding don't depend on an order
    total = F.sum(F.rint(F.col("rank") * 1_000_000).cast("long"))
    found = reveal_rank_all(spark, d).groupBy("address").agg(F.rint(total / (10 * len(HEURISTICS))).cast("long").alias("r"))
    return found.select("address", (F.col("r") / 100_000).alias("rank"), F.expr("r div 1000").cast("int").alias("percent"))


def _in_time(spark, d) -> DataFrame:
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (SV.START, SV.END))
    return _all_reveals(spark, d).where((F.col("ts") >= low) & (F.col("ts") < high)).select("ts", "heuristic", "address", "transaction")


def timeline_all(spark, d):
    return R.sorted_timeline(materialize(_in_time(spark, d), "in_time"))  # written, as a sort reads its rows twice


def timeline_counts(spark, d):
    return R.by_heuristic(_in_time(spark, d), ["address"], HEURISTICS)


def weekly_windows(spark, d):
    found = R.weekly_windows(_all_reveals(spark, d), "ts", TODAY, MONTHS, HEURISTICS)
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def address_stats_all(spark, d):
    """Own transactions, those that any of the pools' heuristics reveals, and by heuristic."""
    txs = _pool_transactions(spark, d)
    reveals = SV._reveals(spark, d)
    flags = reveals.groupBy("transaction").agg(*[F.max((F.col("heuristic") == h).cast("int")).alias(f"h{h}") for h in SV.HEURISTICS])
    rows = txs.join(flags, "transaction", "left")
    return rows.groupBy("address").agg(F.count(F.lit(1)).alias("transactions"), F.count("h1").alias("compromised"), *[F.coalesce(F.sum(f"h{h}"), F.lit(0)).alias(f"by_{h}") for h in SV.HEURISTICS])


def _neighbours(spark, d) -> DataFrame:
    vectors = X.vectors(spark, d)
    return materialize(V.nearest(vectors, vectors, 10).select(_user("query_id").alias("asked"), _user("vec_id").alias("address"), "distance"), "neighbours")


def profile_scores(spark, d):
    """Scores of all addresses of clusters and of the embedding: neighbours, reveals, the user cluster and its exchanges."""
    responses = materialize(U._responses(spark, d), "responses")
    near = R.neighbour_lists(_neighbours(spark, d)).groupBy(F.col("asked").alias("address")).agg(F.count(F.lit(1)).alias("near"), F.avg("conf").alias("near_conf"))
    reveals = _counts(spark, d).where("heuristic > 0").groupBy("address").pivot("heuristic", SV.HEURISTICS).agg(F.first("n"))
    reveals = reveals.select("address", *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"n{h}") for h in SV.HEURISTICS])
    eoas = responses.where("entity = 0 AND user_cluster IS NOT NULL").groupBy("user_cluster").agg(R.capped(F.count(F.lit(1))).alias("eoas"))
    exchanges = responses.where("entity = 1 AND user_cluster IS NOT NULL").groupBy("user_cluster").agg(F.count_distinct("exchange_cluster").alias("exchanges"))
    known = X.known(spark, d).select("address", F.lit(True).alias("known")).distinct()
    rows = responses.join(near, "address", "full").join(reveals, "address", "left").join(eoas, "user_cluster", "left").join(exchanges, "user_cluster", "left").join(known, "address", "left")
    none = lambda c, value=0.0: F.coalesce(c, F.lit(value))
    parts = [(none("near_conf"), none("near", 0))] + [(F.lit(c), none(f"n{h}", 0)) for h, c in SV.CONFIDENCE.items()] + [(none("conf"), none("eoas", 0)), (none("conf") * 0.1, none("exchanges", 0))]
    named = F.coalesce(S.name_of(F.col("entity"), S.ENTITIES), F.lit("node"))
    return rows.select("address", named.alias("entity"), R.profile_score(none("entity", 0), parts, none("known", False)).alias("score"))


def address_page(spark, d):
    """The first page of each depositor: embedding neighbours, then its cluster."""
    asked = X.deposits(spark, d).select(_user("from_address").alias("address"))
    return R.address_page(materialize(U._responses(spark, d), "responses"), _neighbours(spark, d), asked)


def shown_addresses(spark, d):
    found = R.shown(U._responses(spark, d))
    return found.withColumn("entity", S.name_of(F.col("entity"), S.ENTITIES))


def metadata_all(spark, d):
    """The surest row of each address over the reuse of deposit addresses and the five heuristics of the pools, the first heuristic of equals."""
    reuse = U.dar_metadata(spark, d).select("address", "entity", "conf", F.lit(0).alias("heuristic"))
    pool = _all_reveals(spark, d).where("heuristic > 0").select("address", F.lit(0).alias("entity"), F.lit(1.0).alias("conf"), "heuristic").distinct()
    best = J.first_per_key(reuse.unionByName(pool), ["address"], F.desc("conf"), F.col("heuristic"), F.col("entity"))
    return best.withColumn("heuristic", S.name_of(F.col("heuristic"), S.HEURISTICS))


SORTS = [("address", False), ("entity", True), ("conf", True), ("conf", False), ("heuristic", False), ("label", True)]


def sorted_pages(spark, d):
    """The second page of the metadata by each of the columns that a request may sort by."""
    rows = materialize(R.labelled(metadata_all(spark, d)), "metadata")
    out = None
    for column, descending in SORTS:
        own = R.page_by(rows, column, descending, number=1, limit=15).withColumn("sorted_by", F.lit(f"{column} {'desc' if descending else 'asc'}"))
        out = own if out is None else out.unionByName(own)
    return out


def _linked_addresses(spark, d) -> DataFrame:
    """Pairs of addresses with the components of all that the heuristics with two sides link: gas prices, portfolios, outside dealings and reward claims."""
    txs = materialize(_pool_transactions(spark, d).select("transaction", "address"), "transactions")
    gas, multi = P.unique_gas_global(spark, d), P.multi_denom_clusters(spark, d)
    edges = [(gas, "withdraw_hash", "deposit_hash"), (multi, "transaction", "cluster"), (P.linked_address_stars(spark, d), "src", "dst"), (P.reward_claim_stars(spark, d), "src", "dst")]
    out = None
    for links, a, b in edges:
        own = H.address_matches(links.select(F.col(a).alias("a"), F.col(b).alias("b")), txs, "a", "b")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def components_all(spark, d):
    """Users by shared deposit addresses and by the pairs of all heuristics."""
    pairs = _linked_addresses(spark, d).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return connected_components(U._edges(spark, d).unionByName(pairs), "a", "b")


def heuristic_outputs(spark, d):
    """The transactions that each heuristic of the pools links, each with the smallest one of its component as cluster."""
    deposits, withdrawals = P._links(spark, d)
    txs = deposits.select(F.col("hash").alias("transaction"), F.col("from_address").alias("address"), "block_number", F.col("block_timestamp").alias("block_ts")).unionByName(
        withdrawals.select(F.col("hash").alias("transaction"), F.col("recipient_address").alias("address"), "block_number", F.col("block_timestamp").alias("block_ts")))
    exact = P.exact_match_clusters(spark, d)
    first = exact.groupBy("address", "pool").agg(F.min("transaction").alias("cluster"))
    found = exact.join(first, ["address", "pool"]).select(F.lit(1).alias("heuristic"), "transaction", "cluster")
    found = found.unionByName(P.multi_denom_clusters(spark, d).select(F.lit(3).alias("heuristic"), "transaction", "cluster"))
    for h, links, a, b in ((2, P.unique_gas_global(spark, d), "withdraw_hash", "deposit_hash"), (4, P.linked_address_stars(spark, d), "src", "dst"), (5, P.reward_claim_stars(spark, d), "src", "dst")):
        found = found.unionByName(connected_components(links, a, b).select(F.lit(h).alias("heuristic"), F.col("node").alias("transaction"), F.col("component").alias("cluster")))
    named = S.name_of(F.col("heuristic"), S.HEURISTICS)
    return found.join(txs, "transaction").select("address", "transaction", "block_number", "block_ts", F.lit("{}").alias("meta_data"), "cluster", named.alias("heuristic"))


def privacy_scores(spark, d):
    """Matches of portfolios over all pools of at least two transactions."""
    pools = list(range(len(X.POOLS)))
    return H.privacy_scores(H.deposit_portfolios(X.deposits(spark, d), pools, P.DAYS), H.withdraw_portfolios(X.withdrawals(spark, d), pools, P.DAYS, least=2)).withColumn("privacy_score", F.round("privacy_score", 9))


def decoded_edges(spark, d):
    ids = materialize(GP.node_encode(spark, d), "ids")
    return G.decode_nodes(GP.encoded_edges(spark, d), ids, ["src_id", "dst_id"]).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight")


def components_by_size(spark, d):
    return G.components_by_size(connected_components(H.external_pairs(X.external_txs(spark, d)), "from_address", "to_address"))


def dealings_with_pools(spark, d):
    """External transactions by whether they go to a pool."""
    rows = S.with_pool_flag(X.external_txs(spark, d), X.pools(spark).select(F.col("pool").cast("long").alias("address")), "to_address")
    return rows.groupBy("is_pool").agg(F.count(F.lit(1)).alias("n"))


def known_addresses_built(spark, d):
    """Parts as a label list with words, suppliers and some parts as a cluster list, the pools by name."""
    part, supplier = X.table(spark, d, "part"), X.table(spark, d, "supplier")
    kind, label = F.when(F.col("p_size") % 3 == 0, "Smart Contract").when(F.col("p_size") % 3 == 1, "Wallet").otherwise("Other"), F.when(F.col("p_size") % 2 == 0, "Legit").when(F.col("p_size") % 5 > 0, "Dodgy")
    words = part.select(_user("p_partkey").alias("address"), F.col("p_name").alias("name"), kind.alias("account_type"), F.col("p_brand").alias("entity"), label.alias("label"), F.col("p_type").alias("tags"))
    header = words.limit(1).select(F.lit("Address").alias("address"), *[F.lit("x").alias(c) for c in words.columns[1:]])
    named = supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("address"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "Wallet").otherwise("Exchange").alias("type"))
    named = named.unionByName(part.where("p_size < 5").select(_user("p_partkey").alias("address"), F.lit("other").alias("name"), F.lit("Wallet").alias("type"))).withColumn("account_type", F.lit("eoa"))
    pools = X.pools(spark).select(F.concat(F.lit("t"), F.col("pool").cast("string")).alias("address"), F.concat(F.lit(K.POOL_PREFIX), "label").alias("name"), F.lit("contract").alias("account_type"), F.lit("Mixer").alias("type"), F.lit(1).alias("legitimacy"))
    found = K.known_addresses([K.label_list(words.unionByName(header)), K.cluster_list(named), K.pool_list(pools)])
    return found.withColumn("legitimacy", F.col("legitimacy").cast("string"))


def complete_attributes(spark, d):
    return R.complete(X.known(spark, d))


def merged_attributes(spark, d):
    """For each known address a map of what the label says, overridden by what its cluster says, as sorted ``key=value`` texts."""
    own = X.known(spark, d).select("address", F.create_map(F.lit("name"), F.col("name"), F.lit("kind"), F.coalesce("account_type", F.lit("none"))).alias("own"))
    other = U.dar_metadata(spark, d).where("entity <> 1").groupBy("address").agg(F.min("entity").alias("e")).select("address", F.create_map(F.lit("kind"), F.col("e").cast("string"), F.lit("source"), F.lit("reuse")).alias("other"))
    both = own.join(other, "address", "left").select("address", S.merged_maps(F.col("own"), F.col("other")).alias("m"))
    return both.select("address", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("attributes"))


def parsed_dates(spark, d):
    """The days of events from the text that a request has, with one that is no date."""
    day = S.shown_date(F.col("ts"))
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("13/"), day)).otherwise(day)
    return X.table(spark, d, "events").groupBy(S.parse_date(text).alias("day")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


QUERIES = {f.__name__: f for f in (
    reveal_counts_all, reveal_distribution_sampled, reveal_rank_all, overall_rank_all, timeline_all, timeline_counts, weekly_windows, address_stats_all, profile_scores, address_page, shown_addresses, metadata_all, sorted_pages,
    components_all, heuristic_outputs, privacy_scores, decoded_edges, components_by_size, dealings_with_pools, known_addresses_built, complete_attributes, merged_attributes, parsed_dates,
)}

_ALL = {
    "ar6": f"SELECT 'p' || address AS address, heuristic, transaction::VARCHAR AS transaction, ts FROM reveals JOIN txs USING (transaction) UNION ALL SELECT address, 0, transaction, TIMESTAMP '{X.EPOCH}' + to_days((((block % 60) + 60) % 60)::INT) FROM "
           "(SELECT DISTINCT user_address AS address, deposit, receipt_tx AS transaction, receipt_block AS block FROM m)",
    "cnt6": "SELECT address, heuristic, count(*) AS n FROM ar6 GROUP BY ALL",
    "smp": f"SELECT address FROM (SELECT DISTINCT 'p' || from_address AS address FROM deposits) ORDER BY md5('{SEED}:' || address), address LIMIT {SAMPLE}",
    "dist6": f"SELECT heuristic, reveals, count(*) AS frequency FROM (SELECT h.heuristic, coalesce(c.n, 0) AS reveals FROM smp a CROSS JOIN (SELECT unnest({HEURISTICS}) AS heuristic) h LEFT JOIN cnt6 c ON c.address = a.address AND c.heuristic = h.heuristic) GROUP BY ALL",
    "rank6": "SELECT c.address, c.heuristic, c.n, round(coalesce((SELECT sum(frequency) FROM dist6 b WHERE b.heuristic = c.heuristic AND b.reveals < c.n), 0) / (SELECT sum(frequency) FROM dist6 b WHERE b.heuristic = c.heuristic), 6) AS rank FROM cnt6 c",
}


def _sql(body: str, **more: str) -> str:
    return sql(body, "deposits", "withdrawals", "external_txs", "claims", "pools", "transfers", "known", "miners", **SV._REVEALS, **U._VIEWS, **more)


_BY = ", ".join(f"count(*) FILTER (WHERE heuristic = {h}) AS by_{h}" for h in HEURISTICS)
_IN_TIME = f"SELECT ts, heuristic, address, transaction FROM ar6 WHERE ts >= TIMESTAMP '{SV.START}' AND ts < TIMESTAMP '{SV.END}'"
_NEAR = {
    "nn": GP._nearest(1, 10),
    "near": "SELECT 'p' || query_id AS asked, 'p' || vec_id AS address, round_even(1 / abs(10 * distance + 1) * 1000, 0) / 1000 AS conf, row_number() OVER (PARTITION BY query_id ORDER BY distance, 'p' || vec_id) AS rank FROM nn WHERE query_id <> vec_id",
}
_LINKED = " UNION ".join([
    "SELECT w.address AS a, d.address AS b FROM {0} l JOIN pt w ON w.transaction = l.withdraw_hash JOIN pt d ON d.transaction = l.deposit_hash WHERE w.address <> d.address".format(t) for t in ("ug", "linked", "rl")
] + ["SELECT w.address, d.address FROM mc l JOIN pt w ON w.transaction = l.transaction JOIN pt d ON d.transaction = l.cluster WHERE w.address <> d.address"])


def _portfolio(view: str, address: str, own: bool) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE pool = {i}) OVER w{'' if own else f' - (pool = {i})::INT'} AS c{i}" for i in range(len(X.POOLS)))
    return f"SELECT hash, {counts} FROM {view} WINDOW w AS (PARTITION BY {address} ORDER BY block_timestamp RANGE BETWEEN INTERVAL {P.DAYS} DAY PRECEDING AND CURRENT ROW)"


_METADATA = (
    "SELECT address, entity, conf, (['deposit_address_reuse', 'address_match', 'unique_gas_price', 'multi_denomination', 'linked_transaction', 'torn_mine'])[heuristic + 1] AS heuristic FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY conf DESC, heuristic, entity) AS k FROM "
    "(SELECT address, entity, round(conf, 6) AS conf, 0 AS heuristic FROM meta UNION ALL SELECT DISTINCT address, 0, 1.0, heuristic FROM ar6 WHERE heuristic > 0)) WHERE k = 1"
)
_C = [f"c{i}" for i in range(len(X.POOLS))]
ORACLE_SQL = {
    "reveal_counts_all": _sql("SELECT * FROM cnt6", **_ALL),
    "reveal_distribution_sampled": _sql("SELECT * FROM dist6", **_ALL),
    "reveal_rank_all": _sql("SELECT *, floor(rank * 100)::INT AS percent FROM rank6", **_ALL),
    "overall_rank_all": _sql("SELECT address, r / 100000 AS rank, (r // 1000)::INT AS percent FROM (SELECT address, round_even(sum(round_even(rank * 1000000, 0)::BIGINT)::DOUBLE / 60, 0)::BIGINT AS r FROM rank6 GROUP BY address)", **_ALL),
    "timeline_all": _sql(_IN_TIME, **_ALL),
    "timeline_counts": _sql(f"SELECT address, count(*) AS total, {_BY} FROM ({_IN_TIME}) GROUP BY address", **_ALL),
    "weekly_windows": _sql(
        f"SELECT months::INT AS months, week::INT AS week, strftime(start, '%Y-%m-%d') AS start, {', '.join(f'count(*) FILTER (WHERE heuristic = {h}) AS by_{h}' for h in HEURISTICS)} FROM wk LEFT JOIN ar6 ON ts::DATE >= start AND ts::DATE < start + 7 GROUP BY ALL",
        **_ALL, win=f"SELECT months, (DATE '{TODAY}' - to_months(months::INT))::DATE AS first FROM (SELECT unnest({MONTHS}) AS months)",
        wk=f"SELECT months, week, (first + (week * 7)::INT)::DATE AS start FROM win, range(0, 300) r(week) WHERE first + (week * 7 + 7)::INT <= DATE '{TODAY}'"),
    "address_stats_all": _sql(
        "SELECT 'p' || t.address AS address, count(*) AS transactions, count(f.transaction) AS compromised, " + ", ".join(f"coalesce(sum(h{h}), 0)::BIGINT AS by_{h}" for h in SV.HEURISTICS)
        + " FROM txs t LEFT JOIN (SELECT transaction, " + ", ".join(f"max((heuristic = {h})::INT) AS h{h}" for h in SV.HEURISTICS) + " FROM reveals GROUP BY transaction) f ON f.transaction = t.transaction GROUP BY t.address"),
    "profile_scores": _sql(
        "SELECT address, coalesce((['eoa', 'deposit', 'exchange'])[entity + 1], 'node') AS entity, CASE WHEN address IN (SELECT address FROM known) THEN 0 WHEN entity = 1 THEN -1 WHEN entity = 2 THEN 0 ELSE round(1 - tanh(0.1 * (coalesce(nc * nn, 0) + coalesce(n1, 0) + coalesce(n2, 0) + 0.5 * coalesce(n3, 0) + 0.25 * coalesce(n4, 0) + 0.25 * coalesce(n5, 0) "
        "+ coalesce(conf * eoas, 0) + coalesce(0.1 * conf * exchanges, 0))), 3) END::DOUBLE AS score FROM (SELECT coalesce(r.address, n.address) AS address, entity, conf, user_cluster, nn, nc FROM rsp r FULL JOIN (SELECT asked AS address, count(*) AS nn, avg(conf) AS nc FROM near GROUP BY asked) n ON n.address = r.address) b "
        "LEFT JOIN (SELECT address AS x, " + ", ".join(f"max(n) FILTER (WHERE heuristic = {h}) AS n{h}" for h in SV.HEURISTICS) + " FROM cnt6 GROUP BY address) c ON c.x = b.address "
        "LEFT JOIN (SELECT user_cluster AS k, least(count(*), 1000) AS eoas FROM rsp WHERE entity = 0 GROUP BY user_cluster) e ON e.k = b.user_cluster LEFT JOIN (SELECT user_cluster AS k, count(DISTINCT exchange_cluster) AS exchanges FROM rsp WHERE entity = 1 GROUP BY user_cluster) x ON x.k = b.user_cluster",
        **_ALL, **U.USER_CLUSTERS, rsp=U.RESPONSES, **_NEAR),
    "address_page": _sql(
        "SELECT asked, place, address, entity, conf, heuristic, cluster_size, ceil(cluster_size / 20)::BIGINT AS pages FROM (SELECT n.asked, n.rank AS place, n.address, 'node' AS entity, n.conf, 'diff2vec' AS heuristic, cluster_size FROM near n JOIN sz ON sz.asked = n.asked "
        "UNION ALL SELECT sz.asked, sz.near + g.rank, g.address, (['eoa', 'deposit', 'exchange'])[g.entity + 1], round_even(g.conf * 1000, 0) / 1000, 'deposit_address_reuse', cluster_size FROM sz JOIN rk g ON g.key = sz.key WHERE g.rank <= 20)",
        **U.USER_CLUSTERS, rsp=U.RESPONSES, **_NEAR,
        mb="SELECT address, entity, conf, 'u' || user_cluster AS key FROM rsp WHERE user_cluster IS NOT NULL UNION ALL SELECT address, entity, conf, 'e' || exchange_cluster FROM rsp WHERE exchange_cluster IS NOT NULL",
        rk="SELECT *, row_number() OVER (PARTITION BY key ORDER BY conf DESC, address) AS rank FROM mb",
        sz="SELECT a.asked, k.key, coalesce(n.near, 0) AS near, coalesce(n.near, 0) + coalesce(m.members, 0) AS cluster_size FROM (SELECT DISTINCT 'p' || from_address AS asked FROM deposits) a "
           "LEFT JOIN (SELECT address, CASE WHEN entity = 2 THEN 'e' || exchange_cluster ELSE 'u' || user_cluster END AS key FROM rsp) k ON k.address = a.asked LEFT JOIN (SELECT key, least(count(*), 1000) AS members FROM mb GROUP BY key) m ON m.key = k.key LEFT JOIN (SELECT asked, count(*) AS near FROM near GROUP BY asked) n ON n.asked = a.asked"),
    "shown_addresses": _sql("SELECT address, (['eoa', 'deposit', 'exchange'])[entity + 1] AS entity, round_even(conf * 1000, 0) / 1000 AS conf FROM rsp", **U.USER_CLUSTERS, rsp=U.RESPONSES),
    "metadata_all": _sql(_METADATA, **_ALL),
    "sorted_pages": _sql(
        " UNION ALL ".join(f"SELECT * FROM (SELECT *, '{c} {'desc' if down else 'asc'}' AS sorted_by FROM lb ORDER BY {c} {'DESC' if down else 'ASC'} NULLS LAST, address LIMIT 15 OFFSET 15)" for c, down in SORTS),
        **_ALL, md=_METADATA, lb="SELECT *, CASE WHEN conf > 0.98 THEN 'high' WHEN conf > 0.95 THEN 'medium' ELSE 'low' END AS label FROM md"),
    "components_all": _sql("SELECT * FROM c", pt="SELECT transaction, 'p' || address AS address FROM txs", **U._reach("c", "SELECT DISTINCT user_address AS a, deposit AS b FROM p2 UNION " + _LINKED)),
    "heuristic_outputs": _sql(
        "SELECT t.address, f.transaction, t.block_number, t.ts AS block_ts, '{}' AS meta_data, f.cluster, (['', 'address_match', 'unique_gas_price', 'multi_denomination', 'linked_transaction', 'torn_mine'])[f.heuristic + 1] AS heuristic FROM f "
        "JOIN (SELECT hash AS transaction, from_address AS address, block_number, block_timestamp AS ts FROM deposits UNION ALL SELECT hash, recipient_address, block_number, block_timestamp FROM withdrawals) t ON t.transaction = f.transaction",
        **{k: v for n, t in (("g2", "ug"), ("g4", "linked"), ("g5", "rl")) for k, v in U._reach(n, f"SELECT withdraw_hash AS a, deposit_hash AS b FROM {t}").items()},
        xc="SELECT DISTINCT transaction, min(transaction) OVER (PARTITION BY address, pool) AS cluster FROM (SELECT withdraw_hash AS transaction, address, pool FROM xm UNION ALL SELECT deposit_hash, address, pool FROM xm)",
        f="SELECT 1 AS heuristic, transaction, cluster FROM xc UNION ALL SELECT 3, transaction, cluster FROM mc" + "".join(f" UNION ALL SELECT {h}, node, component FROM g{h}" for h in (2, 4, 5))),
    "privacy_scores": sql(
        f"SELECT w.hash AS withdraw_hash, n AS matched, round(1 - 1 / n, 9) AS privacy_score FROM pw w JOIN (SELECT {', '.join(_C)}, count(*) AS n FROM pd GROUP BY ALL) d ON {' AND '.join(f'w.{c} = d.{c}' for c in _C)} WHERE {' + '.join(f'(w.{c} > 0)::INT' for c in _C)} > 1",
        "deposits", "withdrawals", pd=_portfolio("deposits", "from_address", False), pw=_portfolio("withdrawals", "recipient_address", True)),
    "decoded_edges": GP.ORACLE_SQL["edge_weights"],
    "components_by_size": sql("SELECT component, count(*) AS size FROM (SELECT a, min(b) AS component FROM reach GROUP BY a) GROUP BY component", "external_txs",
                              p="SELECT from_address AS a, to_address AS b FROM external_txs GROUP BY ALL HAVING count(*) >= 3", e="SELECT a, b FROM p UNION SELECT b, a FROM p", reach="SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b"),
    "known_addresses_built": sql(
        "SELECT 'p' || p_partkey AS address, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'eoa' ELSE 'Other' END AS account_type, lower(p_brand) AS entity, CASE WHEN p_size % 2 = 0 THEN 'true' WHEN p_size % 5 > 0 THEN 'false' END AS legitimacy, lower(p_type) AS tags FROM part "
        "UNION ALL SELECT 's' || s_suppkey, s_name, 'eoa', CASE WHEN s_suppkey % 2 = 1 THEN 'exchange' END, 'true', NULL FROM supplier UNION ALL SELECT 't' || pool, 'Tornado Cash Pool ' || label, 'contract', 'mixer', 'true', lower(label) FROM pools", "pools"),
    "complete_attributes": sql("SELECT * FROM known WHERE name IS NOT NULL AND account_type IS NOT NULL AND entity IS NOT NULL", "known"),
    "merged_attributes": U._sql(
        "SELECT k.address, CASE WHEN m.address IS NULL THEN 'kind=' || coalesce(account_type, 'none') || ';name=' || name ELSE 'kind=' || m.e || ';name=' || name || ';source=reuse' END AS attributes FROM known k LEFT JOIN (SELECT address, min(entity) AS e FROM meta WHERE entity <> 1 GROUP BY address) m ON m.address = k.address"),
    "parsed_dates": "SELECT CASE WHEN event_id % 10 > 0 THEN strftime(ts, '%Y-%m-%d') END AS day, count(*) AS n FROM events GROUP BY ALL",
    "dealings_with_pools": sql("SELECT to_address < 19 AS is_pool, count(*) AS n FROM external_txs GROUP BY ALL", "external_txs"),
}
