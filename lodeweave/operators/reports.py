"""Serving queries: reports by address and pool, timelines, histograms, ranks and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.scalars import ENTITIES, confidence_label, name_of, round_half_even


def pool_audit(deposits: DataFrame, reveals: DataFrame) -> DataFrame:
    """``pool, total, compromised, uncompromised, ...``: deposits of each pool, and those that a heuristic reveals.

    ``reveals`` is ``heuristic, transaction``; flags are made once for each transaction and then added up by pool.
    """
    flags = reveals.groupBy("transaction").agg(*[F.max(F.when(F.col("heuristic") == h, 1).otherwise(0)).alias(f"h{h}") for h in range(1, 6)])
    rows = deposits.select("pool", F.col("hash").alias("transaction")).join(flags, "transaction", "left")
    total = F.count(F.lit(1))
    caught = F.count_if(F.col("h1").isNotNull())
    return rows.groupBy("pool").agg(total.alias("total"), caught.alias("compromised"), (total - caught).alias("uncompromised"), *[F.coalesce(F.sum(f"h{h}"), F.lit(0)).alias(f"by_{h}") for h in range(1, 6)])


def address_stats(deposits: DataFrame, withdrawals: DataFrame, reveals: DataFrame) -> DataFrame:
    """``address, deposits, withdrawals, compromised``: own transactions and how many of them any heuristic reveals."""
    own = deposits.select(F.col("from_address").alias("address"), F.col("hash").alias("transaction"), F.lit(1).alias("d"), F.lit(0).alias("w")).unionByName(
        withdrawals.select(F.col("recipient_address").alias("address"), F.col("hash").alias("transaction"), F.lit(0).alias("d"), F.lit(1).alias("w"))
    )
    seen = reveals.select("transaction", F.lit(1).alias("seen")).distinct()
    rows = own.join(seen, "transaction", "left")
    return rows.groupBy("address").agg(F.sum("d").alias("deposits"), F.sum("w").alias("withdrawals"), F.coalesce(F.sum("seen"), F.lit(0)).alias("compromised"))


def compromised_deposits(deposits: DataFrame, reveals: DataFrame) -> DataFrame:
    """``address, pool, transaction, heuristic`` of the deposits that a heuristic reveals."""
    own = deposits.select(F.col("from_address").alias("address"), "pool", F.col("hash").alias("transaction"))
    return own.join(reveals.distinct(), "transaction").select("address", "pool", "transaction", "heuristic")


def timeline(reveals: DataFrame, transactions: DataFrame, start: str, end: str) -> DataFrame:
    """Revealed transactions in ``[start, end)``: ``ts, heuristic, address, transaction``; sort by these columns to show it."""
    rows = reveals.join(transactions, "transaction")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    return rows.where((F.col("ts") >= low) & (F.col("ts") < high)).select("ts", "heuristic", "address", "transaction")


def sorted_timeline(rows: DataFrame) -> DataFrame:
    """A timeline in order of time, then heuristic, then transaction."""
    return rows.orderBy("ts", "heuristic", "transaction", "address")


def complete(rows: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return rows.dropna("any")


def weekly_counts(rows: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """``week, n`` for each whole week from ``start``; weeks without rows count 0 and a last part of a week is left out."""
    spark = rows.sparkSession
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    weeks = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.floor(F.datediff(high, low) / 7).cast("int") - 1)).alias("week"))
    day = F.col(ts).cast("date")
    counts = rows.where((day >= low) & (day < high)).groupBy(F.floor(F.datediff(day, low) / 7).cast("int").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.join(counts, "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))


def reveal_distribution(addresses: DataFrame, counts: DataFrame, heuristics: list[int]) -> DataFrame:
    """``heuristic, reveals, frequency``: how many addresses have so many reveals, zeros included."""
    every = addresses.select("address").distinct().withColumn("heuristic", F.explode(F.array(*map(F.lit, heuristics))))
    rows = every.join(counts, ["address", "heuristic"], "left").select("heuristic", F.coalesce("n", F.lit(0)).alias("reveals"))
    return rows.groupBy("heuristic", "reveals").agg(F.count(F.lit(1)).alias("frequency"))


def reveal_rank(counts: DataFrame, distribution: DataFrame) -> DataFrame:
    """``counts`` with ``rank``, the share of addresses with fewer reveals, and ``percent``, cut to a whole number."""
    order = Window.partitionBy("heuristic").orderBy("reveals").rowsBetween(Window.unboundedPreceding, -1)
    below = distribution.select("heuristic", "reveals", F.coalesce(F.sum("frequency").over(order), F.lit(0)).alias("below"), F.sum("frequency").over(Window.partitionBy("heuristic")).alias("all"))
    joined = counts.join(below, (counts["heuristic"] == below["heuristic"]) & (counts["n"] == below["reveals"]))
    rank = F.col("below") / F.col("all")
    return joined.select(counts["address"], counts["heuristic"], "n", F.round(rank, 6).alias("rank"), F.floor(rank * 100).cast("int").alias("percent"))


def anonymity_score(parts: list[tuple[Column, Column]], slope: float = 0.1) -> Column:
    """``1 - tanh(slope * sum(conf * size))``, rounded to three digits."""
    total = F.lit(0.0)
    for conf, size in parts:
        total = total + conf * size
    return F.round(1 - F.tanh(slope * total), 3)


def capped(count: Column, most: int = 1000) -> Column:
    return F.least(count, F.lit(most))


def page(df: DataFrame, order: list[Column], number: int = 0, limit: int = 20) -> DataFrame:
    """One page of a sorted table; the limit is held between 1 and 50 and the page at 0 or more."""
    limit = min(max(limit, 1), 50)
    return df.orderBy(*order).offset(max(number, 0) * limit).limit(limit)


def page_by(df: DataFrame, sort_by: str, descending: bool = True, number: int = 0, limit: int = 20, tie: str = "address") -> DataFrame:
    """One page of a table by any of its columns, equal ones by ``tie``; nulls come last either way, an unknown column raises."""
    if sort_by not in df.columns:
        raise ValueError(f"cannot sort by {sort_by!r}")
    column = F.col(sort_by)
    return page(df, [column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col(tie)], number, limit)


def pages_of(count: Column, limit: int = 20) -> Column:
    return F.ceil(count / limit)


def address_filter(df: DataFrame, min_conf: float | None = None, max_conf: float | None = None, entity: int | None = None, name: str | None = None) -> DataFrame:
    """Rows that meet all given conditions; the name matches without regard to case."""
    if min_conf is not None:
        df = df.where(F.col("conf") >= min_conf)
    if max_conf is not None:
        df = df.where(F.col("conf") <= max_conf)
    if entity is not None:
        df = df.where(F.col("entity") == entity)
    if name is not None:
        df = df.where(F.lower("address") == name.lower())
    return df


def cluster_members(table: DataFrame, addresses: DataFrame, cluster: str = "cluster") -> DataFrame:
    """All rows of the clusters that one of the ``addresses`` is in."""
    own = table.join(addresses.select("address"), "address", "left_semi").select(cluster).where(F.col(cluster).isNotNull()).distinct()
    return table.join(own, cluster, "left_semi").select(*table.columns)


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", confidence_label(F.col("conf")))


def set_entropy(candidates: Column, kept: Column) -> Column:
    """Information gained by narrowing a set down: the difference of the logarithms of the sizes."""
    return F.ln(candidates.cast("double")) - F.ln(kept.cast("double"))


def deposit_map(deposits: DataFrame) -> DataFrame:
    """``address, pool, transactions, span``: an address's deposits in a pool, sorted, and the seconds from the first to the last."""
    seconds = F.timestamp_diff("SECOND", F.min("block_timestamp"), F.max("block_timestamp"))
    return deposits.groupBy(F.col("from_address").alias("address"), "pool").agg(F.array_sort(F.collect_set("hash")).alias("transactions"), seconds.alias("span"))


def known_attributes(known: DataFrame) -> DataFrame:
    """``address, name, account_type, entity`` with empty strings for missing values, without rows that say nothing."""
    filled = known.select("address", "name", "account_type", "entity").fillna("", ["name", "account_type", "entity"])
    return filled.where("name <> '' OR account_type <> '' OR entity <> ''")


def overridden_score(score: Column, name: Column, known: Column, most: float = 0.9) -> Column:
    """A known address has no anonymity, and one with a registered name ``most`` at best."""
    return F.when(known, 0.0).when(F.contains(F.coalesce(name, F.lit("")), F.lit(".eth")), F.least(score, F.lit(most))).otherwise(score)


def hash_sample(addresses: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """``address, h``: the ``size`` distinct addresses with the smallest hashes of seed and address; all of them where there are fewer.

    A sample of several loads is that of their samples (``merge_samples``). Addresses are counted by the first four digits of the hash, so only those
    of one such group, about a 65536th of all, are sorted.
    """
    hashed = addresses.select("address").where("address IS NOT NULL").distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("address").cast("string"))))
    group = F.substring("h", 1, 4)
    below, last = 0, None
    for name, n in sorted(hashed.groupBy(group.alias("g")).agg(F.count(F.lit(1))).collect()):  # 65536 rows at most
        if below + n > size:
            last = name
            break
        below += n
    if last is None:
        return hashed
    return hashed.where(group < last).unionByName(hashed.where(group == last).orderBy("h", "address").limit(size - below))


def merge_samples(samples: list[DataFrame], size: int, seed: int = 42) -> DataFrame:
    """The sample of all addresses that several samples of at least this size, with this seed, were drawn from."""
    both = samples[0]
    for sample in samples[1:]:
        both = both.unionByName(sample)
    return hash_sample(both, size, seed)


def sample_error(size: int, risk: float = 0.01) -> float:
    """Ranks within a sample of so many are within this of the true ones, but for a probability of ``risk`` (Dvoretzky, Kiefer and Wolfowitz)."""
    return math.sqrt(math.log(2 / risk) / (2 * size))


def rank_within(counts: DataFrame, distribution: DataFrame) -> DataFrame:
    """``counts`` (``address, heuristic, n``) with ``rank``, the share of the distribution's addresses with fewer reveals, and ``percent``, cut to a whole number.

    A count need not occur in the distribution. The values of each heuristic are put into one sequence with it, so what is joined back
    are distinct numbers of reveals, not addresses.
    """
    asked = counts.select("heuristic", F.col("n").alias("reveals"), F.lit(0).cast("long").alias("frequency")).distinct()
    order = Window.partitionBy("heuristic").orderBy("reveals").rangeBetween(Window.unboundedPreceding, -1)
    every = distribution.select("heuristic", "reveals", F.col("frequency").cast("long").alias("frequency")).unionByName(asked).groupBy("heuristic", "reveals").agg(F.sum("frequency").alias("f"))
    below = every.select("heuristic", "reveals", (F.coalesce(F.sum("f").over(order), F.lit(0)) / F.sum("f").over(Window.partitionBy("heuristic"))).alias("share"))
    joined = counts.join(below, (counts["heuristic"] == below["heuristic"]) & (counts["n"] == below["reveals"]))
    share = F.coalesce("share", F.lit(0.0))
    return joined.select(counts["address"], counts["heuristic"], "n", F.round(share, 6).alias("rank"), F.floor(F.round(share, 6) * 100).cast("int").alias("percent"))


def by_heuristic(rows: DataFrame, keys: list[str], heuristics: list[int]) -> DataFrame:
    """Counts by key, in all and for each heuristic."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("heuristic") == h).alias(f"by_{h}") for h in heuristics])


def weekly_windows(rows: DataFrame, ts: str, today: str, months: list[int], heuristics: list[int]) -> DataFrame:
    """``months, week, start, by_...``: for windows that end ``today`` and go back so many months, counts by heuristic of each whole week from their beginning.

    Rows are counted by day once; windows and weeks are made of days, so the join is between days and weeks, not rows.
    """
    spark = rows.sparkSession
    end = F.lit(today).cast("date")
    windows = spark.createDataFrame([(m,) for m in months], "months int").withColumn("first", F.add_months(end, -F.col("months")))
    weeks = windows.withColumn("week", F.explode(F.when(F.datediff(end, "first") >= 7, F.sequence(F.lit(0), F.floor(F.datediff(end, "first") / 7).cast("int") - 1)).otherwise(F.array())))
    weeks = weeks.select("months", "week", F.date_add("first", F.col("week") * 7).alias("start"))
    daily = by_heuristic(rows.select(F.col(ts).cast("date").alias("day"), "heuristic"), ["day"], heuristics)
    days = weeks.withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add("start", i))))
    return days.join(daily, "day", "left").groupBy("months", "week", "start").agg(*[F.coalesce(F.sum(f"by_{h}"), F.lit(0)).alias(f"by_{h}") for h in heuristics])


def shown(rows: DataFrame) -> DataFrame:
    """What a result list shows of addresses: no columns of clusters or metadata, confidence to three digits."""
    kept = [c for c in rows.columns if "cluster" not in c and c != "meta_data"]
    return rows.select(*[round_half_even(F.col("conf"), 3).alias("conf") if c == "conf" else F.col(c) for c in kept])


def neighbour_lists(neighbours: DataFrame) -> DataFrame:
    """``asked, address, conf, rank`` of embedding neighbours ``asked, address, distance``, nearest first, without the address itself."""
    order = Window.partitionBy("asked").orderBy("distance", "address")
    return neighbours.where("asked <> address").select("asked", "address", round_half_even(1 / F.abs(10 * F.col("distance") + 1), 3).alias("conf"), F.row_number().over(order).alias("rank"))


def address_page(responses: DataFrame, neighbours: DataFrame, asked: DataFrame, number: int = 0, limit: int = 20, most: int = 1000) -> DataFrame:
    """``asked, place, address, entity, conf, heuristic, cluster_size, pages``: a page for each asked address, its embedding neighbours first, then its cluster.

    An exchange (entity 2) has the cluster of its exchanges, others that of their users; members are shown by falling confidence, then
    address. Members are ranked once for each cluster, and only those of the page are joined to the asked addresses, so a
    cluster that many ask for is not listed for each as a whole. Sizes count ``most`` members at most.
    """
    limit, number = min(max(limit, 1), 50), max(number, 0)
    key = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(kind), F.col(c)))
    kinds = F.array_compact(F.array(key("u", "user_cluster"), key("e", "exchange_cluster")))
    members = responses.select("address", "entity", "conf", F.explode(kinds).alias("key"))
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("conf"), "address")))
    sizes = members.groupBy("key").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("members"))
    on_page = ranked.where((F.col("rank") > number * limit) & (F.col("rank") <= (number + 1) * limit))
    own = asked.select(F.col("address").alias("asked")).distinct().join(responses.select(F.col("address").alias("asked"), F.when(F.col("entity") == 2, key("e", "exchange_cluster")).otherwise(key("u", "user_cluster")).alias("key")), "asked", "left")
    near = neighbour_lists(neighbours).join(own.select("asked"), "asked", "left_semi")
    count = near.groupBy("asked").agg(F.count(F.lit(1)).alias("near"))
    sized = own.join(sizes, "key", "left").join(count, "asked", "left").select("asked", "key", F.coalesce("near", F.lit(0)).alias("near"), (F.coalesce("members", F.lit(0)) + F.coalesce("near", F.lit(0))).alias("cluster_size"))
    listed = sized.join(on_page, "key").select("asked", (F.col("near") + F.col("rank") - number * limit).alias("place"), "address", name_of(F.col("entity"), ENTITIES).alias("entity"), round_half_even(F.col("conf"), 3).alias("conf"), F.lit("deposit_address_reuse").alias("heuristic"), "cluster_size")
    first = near.join(sized, "asked").select("asked", F.col("rank").alias("place"), "address", F.lit("node").alias("entity"), "conf", F.lit("diff2vec").alias("heuristic"), "cluster_size")
    return first.unionByName(listed).withColumn("pages", F.ceil(F.col("cluster_size") / limit))


def profile_score(entity: Column, parts: list[tuple[Column, Column]], known: Column, slope: float = 0.1) -> Column:
    """The score of an address: known ones and exchanges have no anonymity, a deposit address has no score (-1), others that of their parts."""
    return F.when(known, 0.0).when(entity == 1, -1.0).when(entity == 2, 0.0).otherwise(anonymity_score(parts, slope))
