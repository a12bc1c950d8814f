"""Links between deposits and withdrawals of fixed-amount pools, and the reuse of deposit addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.scalars import clip, micros, round_half_even
from lodeweave.operators.joins import as_of_last, as_of_sequence, before_join, portfolio_size, typed_pairs, unique_rows, unordered_pairs, window_counts
from lodeweave.operators.materialize import materialize


def exact_match_links(deposits: DataFrame, withdrawals: DataFrame, by_pool: bool = True) -> DataFrame:
    """Withdrawals to an address that deposited before: ``withdraw_hash, deposit_hash, address, pool``."""
    keys = [("recipient_address", "from_address"), *([("pool", "pool")] if by_pool else [])]
    joined = withdrawals.join(deposits, before_join(withdrawals, deposits, keys))
    return joined.select(withdrawals["hash"].alias("withdraw_hash"), deposits["hash"].alias("deposit_hash"), deposits["from_address"].alias("address"), withdrawals["pool"].alias("pool"))


def exact_match_clusters(deposits: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Components of the links in closed form: ``transaction, role, address, pool``.

    All transactions of one (address, pool) that have any link are one component: withdrawals after the first deposit
    and deposits before the last withdrawal.
    """
    d = deposits.select("hash", F.col("from_address").alias("address"), "pool", "block_timestamp", F.lit("deposit").alias("role"))
    w = withdrawals.select("hash", F.col("recipient_address").alias("address"), "pool", "block_timestamp", F.lit("withdraw").alias("role"))
    span = Window.partitionBy("address", "pool")
    rows = d.unionByName(w).where("address IS NOT NULL AND pool IS NOT NULL")
    rows = rows.withColumns({
        "first": F.min(F.when(F.col("role") == "deposit", F.col("block_timestamp"))).over(span),
        "last": F.max(F.when(F.col("role") == "withdraw", F.col("block_timestamp"))).over(span),
    })
    linked = ((F.col("role") == "withdraw") & (F.col("block_timestamp") > F.col("first"))) | ((F.col("role") == "deposit") & (F.col("block_timestamp") < F.col("last")))
    return rows.where(linked).select(F.col("hash").alias("transaction"), "role", "address", "pool")


def unique_gas_links(deposits: DataFrame, withdrawals: DataFrame, by_pool: bool = True) -> DataFrame:
    """Withdrawals without relayer at a gas price that exactly one deposit before has: ``withdraw_hash, deposit_hash, gas_price``."""
    once = unique_rows(deposits, ["gas_price", "pool"] if by_pool else ["gas_price"])
    own = withdrawals.where("from_address = recipient_address")
    keys = [("gas_price", "gas_price"), *([("pool", "pool")] if by_pool else [])]
    return own.join(once, before_join(own, once, keys)).select(own["hash"].alias("withdraw_hash"), once["hash"].alias("deposit_hash"), once["gas_price"].alias("gas_price"))


def deposit_portfolios(deposits: DataFrame, pools: list[int], days: int) -> DataFrame:
    """``hash, address, ts, portfolio``: counts by pool in the trailing window, the deposit itself left out."""
    rows = deposits.select("hash", F.col("from_address").alias("address"), micros(F.col("block_timestamp")).alias("ts"), "pool")
    return window_counts(rows, "address", "ts", "pool", pools, days, with_self=False)


def withdraw_portfolios(withdrawals: DataFrame, pools: list[int], days: int, least: int = 5, kinds: int = 2) -> DataFrame:
    """The same with the withdrawal itself; kept are those over at least ``kinds`` pools and ``least`` transactions."""
    rows = withdrawals.select("hash", F.col("recipient_address").alias("address"), micros(F.col("block_timestamp")).alias("ts"), "pool")
    found = window_counts(rows, "address", "ts", "pool", pools, days, with_self=True)
    return found.where((F.size("portfolio") >= kinds) & (portfolio_size(F.col("portfolio")) >= least))


def multi_denomination_matches(deposits: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Pairs of portfolios with equal counts in equal pools: ``withdraw_hash, deposit_hash``."""
    d = deposits.select(F.col("hash").alias("deposit_hash"), F.to_json("portfolio").alias("key"))
    w = withdrawals.select(F.col("hash").alias("withdraw_hash"), F.to_json("portfolio").alias("key"))
    return w.join(d, "key").select("withdraw_hash", "deposit_hash")


def multi_denomination_clusters(deposits: DataFrame, withdrawals: DataFrame, every: DataFrame, days: int) -> DataFrame:
    """``transaction, cluster``: members of both windows of each match; a transaction keeps its last cluster.

    ``deposits`` and ``withdrawals`` are portfolios; ``every`` has all withdrawals with the times of their windows. Of the
    withdrawals with equal portfolios only the last one can name the cluster of a deposit's window, so portfolios are
    compared as groups and no pairs are listed. Members are found by bucketing time into window lengths, so the theta
    part is an equi-join on two buckets.
    """
    length = days * 86_400_000_000

    def members(rows: DataFrame, anchors: DataFrame) -> DataFrame:
        spread = anchors.withColumn("b", F.explode(F.array(F.floor(F.col("ts") / length), F.floor(F.col("ts") / length) - 1)))
        own = rows.select(F.col("hash").alias("transaction"), "address", F.col("ts").alias("t"), F.floor(F.col("ts") / length).alias("b"))
        joined = spread.join(own, ["address", "b"])
        return joined.where((F.col("t") <= F.col("ts")) & (F.col("t") >= F.col("ts") - length)).select("transaction", "cluster")

    d, w = (rows.select("hash", "address", "ts", F.to_json("portfolio").alias("key")) for rows in (deposits, withdrawals))
    last = w.groupBy("key").agg(F.max("hash").alias("cluster"))
    deposit_anchor = d.join(last, "key").select("address", "ts", "cluster")
    withdraw_anchor = w.join(d.select("key").distinct(), "key", "left_semi").select("address", "ts", F.col("hash").alias("cluster"))
    found = members(every, withdraw_anchor).unionByName(members(deposits, deposit_anchor))
    return found.groupBy("transaction").agg(F.max("cluster").alias("cluster"))


def privacy_scores(deposits: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """``withdraw_hash, matched, privacy_score``: for each withdrawal with a matching portfolio, how many deposits match it, and 1 - 1 / that number.

    Portfolios are counted by content, so no pairs are listed.
    """
    counts = deposits.groupBy(F.to_json("portfolio").alias("key")).agg(F.count(F.lit(1)).alias("matched"))
    w = withdrawals.select(F.col("hash").alias("withdraw_hash"), F.to_json("portfolio").alias("key"))
    return w.join(counts, "key").select("withdraw_hash", "matched", (1 - 1 / F.col("matched")).alias("privacy_score"))


def address_matches(links: DataFrame, transactions: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of different addresses ``x, y`` whose transactions (``transaction, address``) are linked."""
    one, two = (transactions.select(F.col("transaction").alias(t), F.col("address").alias(n)) for t, n in ((a, "p"), (b, "q")))
    return unordered_pairs(links.select(a, b).join(one, a).join(two, b), "p", "q")


def external_pairs(txs: DataFrame, least: int = 3) -> DataFrame:
    """Directed pairs of addresses with at least so many transactions outside the pools."""
    return txs.groupBy("from_address", "to_address").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def linked_address_links(pairs: DataFrame, deposits: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Deposits of one address before withdrawals to another of the same pool, for addresses that deal with each other outside."""
    found = typed_pairs(unordered_pairs(pairs, "from_address", "to_address"), deposits.select(F.col("from_address").alias("address")), withdrawals.select(F.col("recipient_address").alias("address")))
    d = deposits.select(F.col("from_address").alias("a"), "pool", F.col("block_timestamp").alias("d_ts"), F.col("hash").alias("deposit_hash"))
    w = withdrawals.select(F.col("recipient_address").alias("b"), "pool", F.col("block_timestamp").alias("w_ts"), F.col("hash").alias("withdraw_hash"))
    return found.join(d, "a").join(w, ["b", "pool"]).where("d_ts < w_ts").select("withdraw_hash", "deposit_hash", F.col("a").alias("deposit_address"), F.col("b").alias("withdraw_address"))


def linked_address_stars(pairs: DataFrame, deposits: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Edges ``src, dst`` between transactions that have the components of ``linked_address_links``, and the same transactions, without its links.

    In a pool, the first deposit of an address has a link to the last withdrawal of another just when they have any, so
    these stand for their addresses. A further deposit hangs on its address's first one where some partner's last
    withdrawal comes later, and a withdrawal on its address's last one where some partner's first deposit comes earlier.
    That is an edge for each transaction and each pair of addresses and pool, however many links they have.
    """
    found = typed_pairs(unordered_pairs(pairs, "from_address", "to_address"), deposits.select(F.col("from_address").alias("address")), withdrawals.select(F.col("recipient_address").alias("address")))
    d = deposits.select(F.col("from_address").alias("a"), "pool", F.col("block_timestamp").alias("ts"), F.col("hash").alias("transaction"))
    w = withdrawals.select(F.col("recipient_address").alias("b"), "pool", F.col("block_timestamp").alias("ts"), F.col("hash").alias("transaction"))
    first = d.groupBy("a", "pool").agg(F.min(F.struct("ts", "transaction")).alias("first"))
    last = w.groupBy("b", "pool").agg(F.max(F.struct("ts", "transaction")).alias("last"))
    stars = found.join(first, "a").join(last, ["b", "pool"]).where(F.col("first.ts") < F.col("last.ts"))
    latest = stars.groupBy("a", "pool").agg(F.first("first.transaction").alias("hub"), F.max("last.ts").alias("until"))
    earliest = stars.groupBy("b", "pool").agg(F.first("last.transaction").alias("hub"), F.min("first.ts").alias("since"))
    edges = stars.select(F.col("first.transaction").alias("src"), F.col("last.transaction").alias("dst"))
    edges = edges.unionByName(d.join(latest, ["a", "pool"]).where("ts < until").select(F.col("transaction").alias("src"), F.col("hub").alias("dst")))
    return edges.unionByName(w.join(earliest, ["b", "pool"]).where("ts > since").select(F.col("transaction").alias("src"), F.col("hub").alias("dst")))


def linked_address_members(pairs: DataFrame, deposits: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """``transaction``: the deposits and withdrawals that ``linked_address_links`` links, each once, without its links: in a pool, deposits before the
    last withdrawal of any partner, and withdrawals after the first deposit of any."""
    found = typed_pairs(unordered_pairs(pairs, "from_address", "to_address"), deposits.select(F.col("from_address").alias("address")), withdrawals.select(F.col("recipient_address").alias("address")))
    d = deposits.select(F.col("from_address").alias("a"), "pool", F.col("block_timestamp").alias("ts"), F.col("hash").alias("transaction"))
    w = withdrawals.select(F.col("recipient_address").alias("b"), "pool", F.col("block_timestamp").alias("ts"), F.col("hash").alias("transaction"))
    until = found.join(w.groupBy("b", "pool").agg(F.max("ts").alias("ts")), "b").groupBy("a", "pool").agg(F.max("ts").alias("until"))
    since = found.join(d.groupBy("a", "pool").agg(F.min("ts").alias("ts")), "a").groupBy("b", "pool").agg(F.min("ts").alias("since"))
    out = d.join(until, ["a", "pool"]).where("ts < until").select("transaction")
    return out.unionByName(w.join(since, ["b", "pool"]).where("ts > since").select("transaction")).distinct()


class RewardSides:
    """The two sides from which ``reward_claim_links`` follows a claim, each as claims that ask for a pool and block (``asked``) and the transactions there (``other``).

    ``asked`` is ``claim_hash, recipient, mine, pool, block`` with the claimant's own deposit (side ``deposit``) or withdrawal (side
    ``withdraw``) as ``mine``; ``other`` is ``other, owner, pool, block``, which are withdrawals for the first side and deposits for the
    second. All are as long as the input and its claims: only a join of both lists the links, which grow with its square. In ``sides``
    rows are shuffled by pool and block once, for that join and for leaving out repeated rows; ``lists`` has them as they are.
    """

    def __init__(self, claims: DataFrame, deposits: DataFrame, withdrawals: DataFrame, rates: DataFrame) -> None:
        rates = F.broadcast(rates.where("rate IS NOT NULL").select("pool", "rate"))  # one row for each pool
        d = deposits.select("hash", F.col("from_address").alias("address"), "pool", "block_number")
        w = withdrawals.select("hash", F.col("recipient_address").alias("address"), "pool", "block_number")
        own = claims.select(F.col("hash").alias("claim_hash"), F.col("recipient").alias("address"), "points")
        blocks = F.expr("points div rate")

        def asked(mine: DataFrame, due: Column) -> DataFrame:
            found = own.join(mine, "address").join(rates, "pool").where("points % rate = 0")
            return found.select("claim_hash", F.col("address").alias("recipient"), F.col("hash").alias("mine"), "pool", due.alias("block"))

        def other(rows: DataFrame) -> DataFrame:
            return rows.select(F.col("hash").alias("other"), F.col("address").alias("owner"), "pool", F.col("block_number").alias("block"))

        self.lists = {"deposit": (asked(d, F.col("block_number") + blocks), other(w)), "withdraw": (asked(w, F.col("block_number") - blocks), other(d))}
        self.sides = {k: tuple(rows.repartition("pool", "block").distinct() for rows in both) for k, both in self.lists.items()}


def reward_claim_links(claims: DataFrame, deposits: DataFrame, withdrawals: DataFrame, rates: DataFrame, last_claim_only: bool = False) -> DataFrame:
    """Deposits and withdrawals of one pool that are as many blocks apart as a claim's points say: ``claim_hash, deposit_hash, withdraw_hash, pool``.

    The claimant made the deposit or received the withdrawal; one who did both is followed from both sides, and a link
    found twice counts once. The points are blocks times the pool's rate, so a claim gives one block number for each pool
    it divides, in whole numbers; the rest is an equi-join on pool and block. With ``last_claim_only`` the links of a
    claimant's last claim (by hash) that has any replace those of earlier ones, for each side by itself.

    A hash names one transaction. So a link is found twice only where one address claims, deposits and receives, and the second side
    leaves those out: the links themselves, which grow with the square of the input, are never shuffled.
    """
    sides = RewardSides(claims, deposits, withdrawals, rates).sides
    (asked, other), (asked_back, other_back) = sides["deposit"], sides["withdraw"]
    twice = F.col("owner").eqNullSafe(F.col("recipient"))
    if last_claim_only:
        last = {k: a.join(o, ["pool", "block"], "left_semi").groupBy("recipient").agg(F.max("claim_hash").alias("claim_hash")) for k, (a, o) in sides.items()}
        asked = asked.join(last["deposit"], ["recipient", "claim_hash"], "left_semi")
        first = last["deposit"].withColumn("first", F.lit(True))
        asked_back = asked_back.join(last["withdraw"], ["recipient", "claim_hash"], "left_semi").join(first, ["recipient", "claim_hash"], "left")
        twice = twice & F.col("first").isNotNull()
    found = asked.join(other, ["pool", "block"]).select("claim_hash", F.col("mine").alias("deposit_hash"), F.col("other").alias("withdraw_hash"), "pool")
    back = asked_back.join(other_back, ["pool", "block"]).where(~twice)
    return found.unionByName(back.select("claim_hash", F.col("other").alias("deposit_hash"), F.col("mine").alias("withdraw_hash"), "pool"))


def reward_claim_members(claims: DataFrame, deposits: DataFrame, withdrawals: DataFrame, rates: DataFrame) -> DataFrame:
    """``transaction``: the deposits and withdrawals that ``reward_claim_links`` links, each once, without its links: those of claimants that find any
    other, and the others that any claim asks for.

    What asks, several rows for each transaction, is compared with the distinct pools and blocks of the other side. These are written first, so
    that Spark knows their size: few blocks are broadcast and what asks is not shuffled by them, many are joined by key.
    """
    out = None
    for asked, other in RewardSides(claims, deposits, withdrawals, rates).lists.values():
        there = materialize(other.select("pool", "block").distinct(), "slots")
        slots = asked.select("pool", "block").distinct()
        for rows in (asked.join(there, ["pool", "block"], "left_semi").select(F.col("mine").alias("transaction")), other.join(slots, ["pool", "block"], "left_semi").select(F.col("other").alias("transaction"))):
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def reward_claim_stars(claims: DataFrame, deposits: DataFrame, withdrawals: DataFrame, rates: DataFrame) -> DataFrame:
    """Edges ``src, dst`` between transactions that have the components of ``reward_claim_links``, and the same transactions, without its links.

    A claim that asks for a pool and block is linked with every transaction there, so all of them hang on one of these: an edge for each
    claimant's transaction that asks, and for each transaction asked for. That one has an address if any has, so the edges
    also have the components of the addresses.
    """
    out = None
    for asked, other in RewardSides(claims, deposits, withdrawals, rates).sides.values():
        slots = asked.select("pool", "block").distinct()
        there = other.join(slots, ["pool", "block"], "left_semi")
        hubs = there.groupBy("pool", "block").agg(F.min(F.struct(F.col("owner").isNull(), F.col("other")))["other"].alias("dst"))
        mine = asked.select(F.col("mine").alias("src"), "pool", "block").distinct()
        for rows in (mine, there.select(F.col("other").alias("src"), "pool", "block")):
            own = rows.join(hubs, ["pool", "block"]).select("src", "dst")
            out = own if out is None else out.unionByName(own)
    return out


def heuristic_output(links: DataFrame, transactions: DataFrame, cluster: str) -> DataFrame:
    """Members of links in long form: ``address, transaction, block_number, block_ts, cluster``."""
    members = links.select(F.col(cluster).alias("cluster"), F.explode(F.array("withdraw_hash", "deposit_hash")).alias("transaction")).distinct()
    return members.join(transactions, members["transaction"] == transactions["hash"]).select("address", "transaction", "block_number", F.col("block_timestamp").alias("block_ts"), "cluster")


def cluster_pairs(clusters: DataFrame, cluster: str, member: str) -> DataFrame:
    """A chain of pairs through each cluster, which has the cluster's component; n - 1 pairs instead of all n (n - 1) / 2."""
    order = Window.partitionBy(cluster).orderBy(member)
    chained = clusters.select(cluster, member).distinct().withColumn("y", F.lead(member).over(order)).where("y IS NOT NULL")
    return chained.select(cluster, F.col(member).alias("x"), "y")


# reuse of deposit addresses


REUSE_KEYS = ["deposit", "round_value"]
#: So many addresses are broadcast; more are joined by key.
FEW = 1_000_000


def _few(addresses: DataFrame, most: int = FEW) -> DataFrame:
    """``addresses``, broadcast where they are at most so many, however low Spark's own threshold is: joined by key they'd have all transfers shuffled."""
    return F.broadcast(addresses) if addresses.count() <= most else addresses


def reuse_sequence(transfers: DataFrame, exchanges: DataFrame, blacklist: DataFrame, miners: DataFrame) -> DataFrame:
    """Forwards to exchanges and receipts of the addresses that forward, in one table by ``deposit, round_value``, which ``reuse_matches_of`` reads."""
    tx = transfers.join(_few(miners.select(F.col("address").alias("from_address"))), "from_address", "left_anti")
    tx = tx.withColumn("round_value", F.rint(F.col("value") * 10).cast("long"))  # tenths: a whole number is a key that Spark need not normalise
    forwards = tx.join(_few(exchanges.select(F.col("address").alias("to_address"))), "to_address", "left_semi")
    listed = _few(blacklist.select(F.col("address").alias("from_address")))
    # written first, so that their number is known: few are broadcast and the transfers are not shuffled by receiver
    deposits = materialize(forwards.join(listed, "from_address", "left_anti").select(F.col("from_address").alias("to_address")).distinct(), "forwarding")
    receipts = tx.join(_few(deposits), "to_address", "left_semi").join(listed, "from_address", "left_anti")
    left = forwards.select(F.col("from_address").alias("deposit"), "round_value", F.col("to_address").alias("exchange"), "value", "block", F.col("transaction").alias("tx"))
    right = receipts.select(F.col("to_address").alias("deposit"), "round_value", F.col("from_address").alias("user_address"), "value", "block", F.col("transaction").alias("tx"))
    return as_of_sequence(left, right, REUSE_KEYS, "block", ["tx"])


def reuse_matches_of(sequence: DataFrame, a_max: float = 0.01, t_max: int = 3200) -> DataFrame:
    """The matches of a ``reuse_sequence``: the last receipt before each forward, whose amount is judged after it has been picked."""
    found = as_of_last(sequence, REUSE_KEYS, "block", t_max)
    a_diff = F.col("r_value") - F.col("value")
    near = found.where((round_half_even(a_diff, 3) >= 0) & (round_half_even(a_diff, 3) <= a_max))
    return near.select(F.col("r_user_address").alias("user_address"), "deposit", "exchange", F.col("tx").alias("forward_tx"), F.col("r_tx").alias("receipt_tx"), F.col("r_block").alias("receipt_block"), (F.col("block") - F.col("r_block")).alias("t_diff"), a_diff.alias("a_diff"))


def reuse_matches(transfers: DataFrame, exchanges: DataFrame, blacklist: DataFrame, miners: DataFrame, a_max: float = 0.01, t_max: int = 3200) -> DataFrame:
    """Forwards of deposit addresses to exchanges with the receipt they pass on.

    Columns ``user_address, deposit, exchange, forward_tx, receipt_tx, receipt_block, t_diff, a_diff``. Only the last receipt
    before a forward counts, and its amount is judged after it has been picked.
    """
    return reuse_matches_of(reuse_sequence(transfers, exchanges, blacklist, miners), a_max, t_max)


def reuse_confidence(t_diff: Column, a_diff: Column, a_max: float = 0.01, t_max: int = 3200) -> Column:
    """Mean closeness in time and amount, in [0, 1]."""
    return ((1 - clip(F.abs(t_diff) / float(t_max), 0.0, 1.0)) + (1 - clip(F.abs(a_diff) / a_max, 0.0, 1.0))) / 2


def reuse_metadata(matches: DataFrame) -> DataFrame:
    """``address, entity, conf``: mean confidence of each user (0), deposit (1) and exchange (2)."""
    roles = F.array(*[F.struct(F.col(c).alias("address"), F.lit(e).alias("entity")) for c, e in (("user_address", 0), ("deposit", 1), ("exchange", 2))])
    return matches.select(F.explode(roles).alias("r"), "conf").groupBy("r.address", "r.entity").agg(F.avg("conf").alias("conf"))


def reuse_attributes(matches: DataFrame, names: DataFrame) -> DataFrame:
    """``address, entity, meta_data`` (JSON): nothing for users, an exchange's ``name`` (null if unknown), and for a deposit the exchange
    of its first forward, with that one's name. ``names`` is ``address, name``; of several exchanges in the first forward the smallest counts."""
    named = names.select(F.col("address").alias("exchange"), "name")
    keep = {"ignoreNullFields": "false"}
    users = matches.select(F.col("user_address").alias("address")).distinct().select("address", F.lit(0).alias("entity"), F.lit("{}").alias("meta_data"))
    exchanges = matches.select("exchange").distinct().join(named, "exchange", "left").select(F.col("exchange").alias("address"), F.lit(2).alias("entity"), F.to_json(F.struct("name"), keep).alias("meta_data"))
    first = matches.groupBy("deposit").agg(F.min(F.struct("forward_tx", "exchange"))["exchange"].alias("exchange")).join(named, "exchange", "left")
    shown = F.struct(F.col("exchange").alias("exchange_address"), F.col("name").alias("exchange_name"), F.concat(F.lit("Deposit for "), "name").alias("name"))
    return users.unionByName(exchanges).unionByName(first.select(F.col("deposit").alias("address"), F.lit(1).alias("entity"), F.to_json(shown, keep).alias("meta_data")))


def split_known(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exchanges, and all other known addresses, which are neither users nor deposits; a missing type or entity is another one."""
    exchange = F.col("account_type").eqNullSafe("eoa") & F.col("entity").eqNullSafe("exchange")
    return known.where(exchange).select("address"), known.where(~exchange).select("address")


def prune_matches(matches: DataFrame) -> DataFrame:
    """Without users and deposits that are exchanges, then without deposits that are still users."""
    exchanges = matches.select(F.col("exchange").alias("address")).distinct()
    left = matches.join(exchanges.withColumnRenamed("address", "user_address"), "user_address", "left_anti").join(exchanges.withColumnRenamed("address", "deposit"), "deposit", "left_anti")
    users = left.select(F.col("user_address").alias("deposit")).distinct()
    return left.join(users, "deposit", "left_anti").select(*matches.columns)


def pair_metadata(pairs: DataFrame, entity: int = 0) -> DataFrame:
    """``address, entity, conf``: each address of ``x, y, conf`` pairs with the highest confidence of its pairs."""
    return pairs.select(F.explode(F.array("x", "y")).alias("address"), "conf").groupBy("address").agg(F.max("conf").alias("conf")).select("address", F.lit(entity).alias("entity"), "conf")
