"""Queries that decode calls; the calls are written from the events, as the tables hold none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import scalars as S
from lodeweave.functions import words as W
from lodeweave.operators import decoding as D
from lodeweave.operators import heuristics as H
from lodeweave.plans import pools as P
from lodeweave.sources import fixtures as X
from lodeweave.sources.fixtures import sql


def _word(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("long"))), 64, "0")


def _address(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x.cast("long"))), 40, "0"))


def _call(selector: str, *words: Column) -> Column:
    return F.concat(F.lit(selector), *map(_word, words))


def _transactions(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = X.events(spark, d).where("event_type IN ('purchase', 'signup')")
    pool, user, deposit = F.lit(1000) + F.col("k") % 19, F.col("user_id"), F.col("event_type") == "purchase"
    proof = [F.lit(x) for x in (224, 1, 2)]
    straight = F.when(deposit, _call(S.DEPOSIT_SELECTOR, F.col("event_id"))).otherwise(_call(S.WITHDRAW_SELECTOR, *proof, user, F.lit(0), F.lit(0), F.lit(0)))
    passed = F.when(deposit, _call("0x13d98d13", pool, F.col("event_id"), F.lit(96))).otherwise(_call("0xb438689f", pool, *proof, user, F.lit(0), F.lit(0), F.lit(0)))
    by = F.col("k") % 3
    target = F.when(by == 0, _address(pool)).when(by == 1, S.PROXIES[0]).otherwise(S.PROXIES[1])
    txs = rows.select(F.col("event_id").alias("hash"), target.alias("to_address"), F.when(by == 0, straight).otherwise(passed).alias("input"))
    traces = rows.select(F.col("event_id").alias("transaction_hash"), straight.alias("input"))
    pools = spark.range(19).select(_address(F.col("id") + 1000).alias("address"))
    return txs, traces, pools


def pool_calls(spark, d):
    return D.pool_calls(*_transactions(spark, d))


CLAIM = "0x6a4b3d2c"


def _claims(spark, d) -> DataFrame:
    """Claims as calls, and the same words under another selector, which are none; a third of the recipients in capitals."""
    rows = X.claims(spark, d)
    words = [F.lit(0), F.lit(96), F.lit(7), F.col("points"), F.lit(5), F.lit(128), F.lit(9), F.lit(3), F.col("recipient"), F.lit(0)]
    calls = rows.select("hash", F.when(F.col("hash") % 3 == 0, F.upper(_call("", *words))).otherwise(_call("", *words)).alias("words"))
    own = calls.select("hash", F.concat(F.lit(CLAIM), "words").alias("input"))
    return own.unionByName(calls.select("hash", F.concat(F.lit("0x00000001"), "words").alias("input")))


def claim_calls(spark, d):
    return D.claim_calls(_claims(spark, d), [CLAIM]).select("hash", "points", "points_text", "recipient")


def reward_claims_of_calls(spark, d):
    """The links of reward claims that are read from calls."""
    claims = D.claim_calls(_claims(spark, d), [CLAIM])
    claims = claims.select("hash", "points", F.conv(F.substring("recipient", 3, 40), 16, 10).cast("long").alias("recipient"))
    return H.reward_claim_links(claims, X.deposits(spark, d), X.withdrawals(spark, d), X.pools(spark))


def exact_words(spark, d):
    """A number of about 80 bits for each event: as decimal text, its seventh with the remainder, and its double."""
    rows = X.events(spark, d).select("event_id", F.lpad(F.concat(F.lower(F.hex(F.col("event_id") + 1)), F.lpad(F.lower(F.hex("user_id")), 16, "0")), 64, "0").alias("word"))
    part = W.word_divide(F.col("word"), F.lit(7))
    return rows.select("event_id", W.word_decimal(F.col("word")).alias("number"), W.word_decimal(part["quotient"]).alias("seventh"), part["remainder"].alias("remainder"), W.word_decimal(W.word_add(F.col("word"), F.col("word"))).alias("doubled"))


QUERIES = {f.__name__: f for f in (pool_calls, claim_calls, reward_claims_of_calls, exact_words)}
_HEX = "'0x' || lpad(lower(to_hex({})), 40, '0')"
ORACLE_SQL = {
    "pool_calls": sql(
        f"SELECT event_id AS hash, CASE k % 3 WHEN 0 THEN {_HEX.format('1000 + k % 19')} WHEN 1 THEN '{S.PROXIES[0]}' ELSE '{S.PROXIES[1]}' END AS to_address, CASE event_type WHEN 'purchase' THEN 'deposit' ELSE 'withdraw' END AS kind, "
        f"{_HEX.format('1000 + k % 19')} AS pool_address, CASE event_type WHEN 'signup' THEN {_HEX.format('user_id')} END AS recipient_address FROM ev WHERE event_type IN ('purchase', 'signup')", "ev"),
    "claim_calls": sql(f"SELECT hash, points, points::VARCHAR AS points_text, {_HEX.format('recipient')} AS recipient FROM claims", "claims"),
    "exact_words": "SELECT event_id, n::VARCHAR AS number, (n // 7)::VARCHAR AS seventh, (n % 7)::BIGINT AS remainder, (2 * n)::VARCHAR AS doubled FROM (SELECT event_id, (event_id + 1)::HUGEINT * 18446744073709551616 + user_id AS n FROM events)",
    "reward_claims_of_calls": P.ORACLE_SQL["reward_claim_links"],
}
