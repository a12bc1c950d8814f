"""Exact words, reward claims from calls and the closed form of linked addresses."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodeweave.functions import words
from lodeweave.operators import decoding, heuristics
from lodeweave.operators.components import connected_components


def test_words_are_exact(spark):
    rng = random.Random(1)
    numbers = [0, 1, 2**32 - 1, 2**32, 2**60, 2**63 - 1, 2**63, 10**30, 2**128, 2**255, 2**256 - 1] + [rng.getrandbits(rng.randrange(1, 257)) for _ in range(60)]
    rows = [(f"{n:064x}", f"{m:064x}", d) for n, m, d in zip(numbers, reversed(numbers), [1, 7, 1000, 2**31 - 1] * 20)]
    df = spark.createDataFrame([r for r in rows if int(r[0], 16) + int(r[1], 16) < 2**256], "a string, b string, d long")
    divided = words.word_divide(F.col("a"), F.col("d"))
    got = df.select("a", "b", "d", words.word_decimal(F.col("a")).alias("text"), words.word_add(F.col("a"), F.col("b")).alias("sum"), divided["quotient"].alias("q"), divided["remainder"].alias("r"), words.word_long(F.col("a"), strict=False).alias("n"), (F.col("a") < F.col("b")).alias("less"))
    for r in got.collect():
        a, b = int(r.a, 16), int(r.b, 16)
        assert r.text == str(a) and r["sum"] == f"{a + b:064x}" and (int(r.q, 16), r.r) == divmod(a, r.d) and r.less == (a < b)
        assert r.n == (a if a < 2**63 else None)
    top = spark.createDataFrame([("f" * 64,)], "a string")
    with pytest.raises(Exception, match="no long"):
        top.select(words.word_long(F.col("a"))).collect()
    with pytest.raises(Exception, match="256 bits"):
        top.select(words.word_add(F.col("a"), F.col("a"))).collect()
    assert [x for x in spark.createDataFrame([(None,)], "a string").select(words.word_long(F.col("a")), words.word_divide(F.col("a"), F.lit(0))).first()] == [None, None]


def test_claims_of_any_size(spark):
    def call(selector, points):
        return selector + "".join(f"{x:064x}" for x in [0, 96, 7, points, 5, 128, 9, 3, 0xAB, 0])

    rows = [(i, call("0x0000000A" if i % 2 else "0x0000000a", p)) for i, p in enumerate([5, 2**60, 10**30, 2**255])] + [(9, call("0x0000000b", 5)), (10, None)]
    got = {r.hash: (r.points, r.points_text, r.recipient) for r in decoding.claim_calls(spark.createDataFrame(rows, "hash long, input string"), ["0x0000000a"]).collect()}
    to = "0x" + "ab".rjust(40, "0")
    assert got == {0: (5, "5", to), 1: (2**60, str(2**60), to), 2: (None, str(10**30), to), 3: (None, str(2**255), to)}


def transactions(spark, rows, recipient):
    df = spark.createDataFrame(rows, "hash long, address long, pool int, t long").withColumn("block_timestamp", F.timestamp_seconds("t").cast("timestamp_ntz"))
    return df.withColumnRenamed("address", "recipient_address" if recipient else "from_address")


def test_stars_have_the_components_of_the_links(spark):
    rng = random.Random(5)
    for _ in range(4):
        d = transactions(spark, [(i, rng.randrange(8), rng.randrange(2), rng.randrange(9)) for i in range(40)], False)
        w = transactions(spark, [(100 + i, rng.randrange(8), rng.randrange(2), rng.randrange(9)) for i in range(40)], True)
        pairs = spark.createDataFrame([(rng.randrange(8), rng.randrange(8)) for _ in range(5)], "from_address long, to_address long")
        links = heuristics.linked_address_links(pairs, d, w)
        want = {tuple(r) for r in connected_components(links, "withdraw_hash", "deposit_hash").collect()}
        assert {tuple(r) for r in connected_components(heuristics.linked_address_stars(pairs, d, w)).collect()} == want


def test_members_are_the_transactions_of_the_links(spark):
    rng = random.Random(6)
    for _ in range(3):
        d = transactions(spark, [(i, rng.randrange(8), rng.randrange(2), rng.randrange(9)) for i in range(40)], False)
        w = transactions(spark, [(100 + i, rng.randrange(8), rng.randrange(2), rng.randrange(9)) for i in range(40)], True)
        pairs = spark.createDataFrame([(rng.randrange(8), rng.randrange(8)) for _ in range(5)], "from_address long, to_address long")
        want = sorted({x for r in heuristics.linked_address_links(pairs, d, w).collect() for x in (r.withdraw_hash, r.deposit_hash)})
        assert sorted(r[0] for r in heuristics.linked_address_members(pairs, d, w).collect()) == want and want


def test_hot_addresses_have_no_pair_list(spark):
    n = 100_000
    times = spark.range(n).withColumn("block_timestamp", F.timestamp_seconds("id").cast("timestamp_ntz")).withColumn("pool", F.lit(1))
    d, w = times.select(F.col("id").alias("hash"), F.lit(1).cast("long").alias("from_address"), "pool", "block_timestamp"), times.select((F.col("id") + n).alias("hash"), F.lit(2).cast("long").alias("recipient_address"), "pool", "block_timestamp")
    start = time.perf_counter()
    stars = heuristics.linked_address_stars(spark.createDataFrame([(1, 2)], "from_address long, to_address long"), d, w)
    assert stars.count() == 2 * n - 1  # the last deposit and the first withdrawal have no link
    assert time.perf_counter() - start < 60


def test_words_are_whole_numbers_of_batches(spark):
    word = F.concat(F.sha2(F.col("id").cast("string"), 224), F.lpad(F.hex("id"), 8, "0"))
    rows = spark.range(0, 3000, 1, 4).select("id", F.lower(word).alias("w")).withColumn("half", F.concat(F.lit("0"), F.substring("w", 2, 63)))
    part = words.word_divide(F.col("w"), F.lit(7))
    got = rows.select("id", "w", "half", words.word_decimal(F.col("w")).alias("text"), words.word_decimal(part["quotient"]).alias("q"), part["remainder"].alias("r"), words.word_add(F.col("half"), F.col("half")).alias("sum"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan  # Spark never compiles lambdas: before, 62.4 s for 100,000 rows of exact_words
    for r in got.collect():
        n, half = int(r.w, 16), int(r.half, 16)
        assert (r.text, r.q, r.r, r["sum"]) == (str(n), str(n // 7), n % 7, f"{2 * half:064x}")


def test_what_is_no_word_keeps_the_digits_of_its_limbs(spark):
    rows = ["", "f", "zz", "F" * 64, "0" * 56 + "12z45678", "0" * 56 + " 1234567", "0" * 55 + "x" + "0000_001", "1" * 70, "0" * 48 + "g" * 8 + "0000000a"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(rows)], "i int, w string")
    none = spark.createDataFrame([(None,)], "w string").select(words.word_decimal(F.col("w")), words.word_add(F.col("w"), F.lit("0" * 64)))
    assert list(none.first()) == [None, None]  # before: 0, and an error that names a sum of more than 256 bits
    part = words.word_divide(F.col("w"), F.lit(16))
    got = df.select("i", words.word_decimal(F.col("w")).alias("text"), part["quotient"].alias("q"), part["remainder"].alias("r")).orderBy("i").collect()
    want = [0, 15 << 224, 0, 2**256 - 1, 0x12, 0x1234567, 0, int("1" * 64, 16), 10]
    assert [int(r.text) for r in got] == want and [(int(r.q, 16), r.r) for r in got] == [divmod(n, 16) for n in want]
