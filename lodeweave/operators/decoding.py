"""Pool calls and reward claims out of raw transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import scalars as S
from lodeweave.functions.words import word_decimal, word_long


def _checked(ok: Column, value: Column, message: str, key: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), F.col(key).cast("string"))))


def pool_calls(transactions: DataFrame, traces: DataFrame, pools: DataFrame, proxies: list[str] = S.PROXIES) -> DataFrame:
    """Transactions that deposit into or withdraw from a pool, without ``input``; plus ``kind, pool_address, recipient_address``.

    ``traces`` (``transaction_hash, input``) are the calls that reached a pool, and their selectors tell what a
    transaction does; another selector, or a transaction with no or both kinds, raises. A call goes to one of the
    ``pools`` (``address``) itself, or to a proxy, whose first argument is the pool; other targets are left out. Addresses and
    selectors match in any case and come out in lower case. The
    recipient of a withdrawal is its fourth argument, behind a proxy the fifth; a deposit has none.
    """
    transactions, pools = transactions.withColumn("to_address", F.lower("to_address")), pools.withColumn("address", F.lower("address"))
    named = F.lower(S.selector(F.col("input")))
    kind = F.when(named == S.DEPOSIT_SELECTOR, "deposit").when(named == S.WITHDRAW_SELECTOR, "withdraw")
    kinds = traces.select(F.col("transaction_hash").alias("hash"), _checked(kind.isNotNull(), kind, "neither deposit nor withdrawal", "transaction_hash").alias("kind"))
    kinds = kinds.groupBy("hash").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"))
    own = transactions.join(kinds, "hash", "left")
    own = own.withColumn("kind", _checked(F.coalesce(F.col("kind") == F.col("other"), F.lit(False)), F.col("kind"), "not just one kind of call", "hash")).drop("other")
    direct = own.join(pools.select(F.col("address").alias("to_address")).distinct(), "to_address", "left_semi").withColumn("pool_address", F.col("to_address"))
    passed = own.where(F.col("to_address").isin([x.lower() for x in proxies])).withColumn("pool_address", S.word_address(F.col("input"), 0))

    def shown(rows: DataFrame, word: int) -> DataFrame:
        recipient = F.when(F.col("kind") == "withdraw", S.word_address(F.col("input"), word))
        return rows.withColumn("recipient_address", recipient).select(*[c for c in transactions.columns if c != "input"], "kind", "pool_address", "recipient_address")

    return shown(direct, 3).unionByName(shown(passed, 4))


def claim_calls(calls: DataFrame, selectors: list[str]) -> DataFrame:
    """``points, points_text, recipient`` of reward claims in ``input``, with the other columns; calls of other ``selectors`` are left out.

    The second argument is a tuple and begins where its word says; in it the first word is the number of points and the
    third says where, from the tuple's beginning, another tuple stands, whose second word is the recipient. ``points_text`` is
    the number in full; ``points`` is null where it doesn't fit into a long, as no rate makes blocks of so many.
    """
    call = F.col("input")
    own = calls.where(F.lower(S.selector(call)).isin([x.lower() for x in selectors]))
    tuple_at = S.word_number(call, 1)
    inner_at = tuple_at + S.as_number(S.word_at(call, tuple_at + 64))
    points = F.lower(S.word_at(call, tuple_at))
    return own.withColumns({"points": word_long(points, strict=False), "points_text": word_decimal(points), "recipient": S.as_address(S.word_at(call, inner_at + 32))}).drop("input")
