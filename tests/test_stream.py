"""The as-of stream over loads against the batch operator."""

import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import heuristics
from lodeweave.streaming import reuse

SCHEMA = "transaction string, from_address string, to_address string, value double, block long"
NAMES = ["user_address", "deposit", "exchange", "forward_tx", "receipt_tx", "t_diff"]


@pytest.fixture(scope="module")
def case(spark):
    """Transfers of few addresses, amounts and blocks, so that ties are many; exchanges, known addresses and miners."""
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        way = rng.choice([("u", "s"), ("u", "s"), ("s", "x"), ("u", "m"), ("m", "s"), ("s", "s")])
        a, b = (f"{k}{rng.randrange(3 if k in 'xm' else 12)}" for k in way)
        rows.append((f"t{i % 1500}{'b' * (i // 1500)}", a, b, rng.choice([1.0, 1.04, 1.05, 2.0, 2.005, 7.25, None]), rng.randrange(200) if i % 97 else None))
    addresses = lambda k: spark.createDataFrame([(f"{k}{i}",) for i in range(3)], "address string")
    known = addresses("x").unionByName(spark.createDataFrame([("u1",)], "address string"))
    return spark.createDataFrame(rows, SCHEMA).repartition(4), addresses("x"), known, addresses("m")


def plain(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def test_stream_gives_the_matches_of_the_batch(spark, case, tmp_path):
    transfers, *lists = case
    want = plain(heuristics.reuse_matches(transfers, *lists, 0.01, 30))
    loads, span, last = reuse.in_order_of_arrival(transfers, 6, late=3)
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("source", "out", "state"))
    run = lambda: reuse.run_matches(spark, source, transfers.schema, *lists, 30, 0.01, 2 * span, out, state)
    for load in loads:
        assert load.rdd.getNumPartitions() == 4  # before: one task wrote a load
        load.write.mode("append").parquet(source)
        run()
    some = len(plain(reuse.matches_of(spark, out)))
    reuse.close_loads(spark, source, transfers.schema, last + 3 * span + 30)
    run()
    run()  # nothing has come
    assert plain(reuse.matches_of(spark, out)) == want and 0 < some < len(want)
    # rows that no later load can need are gone, and a last receipt is kept while it may match
    assert len(list((tmp_path / "state" / "rows").iterdir())) < 7
    assert spark.read.parquet(f"{state}/last/6").count() == 0 < spark.read.parquet(f"{state}/last/5").count()


def test_micro_batch_that_runs_again_changes_nothing(spark, case, tmp_path):
    transfers, *lists = case
    out, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    take = lambda k: reuse.add_transfers(spark, transfers.where(F.col("block").between(k * 50, k * 50 + 49)), k, *lists, 30, 0.01, 50, out, state)
    found = []
    for k in range(4):
        take(k)
        found.append(plain(reuse.matches_of(spark, out)))
        take(k)
        assert plain(reuse.matches_of(spark, out)) == found[-1]
    assert [len(x) for x in found] == sorted(len(x) for x in found) and found[0] != found[-1]
    assert found[-1] == plain(heuristics.reuse_matches(transfers.where("block <= 149"), *lists, 0.01, 30))


def test_rows_that_come_too_late_are_dropped(spark, tmp_path):
    rows = [("a", "u1", "s1", 1.0, 10), ("b", "u2", "s1", 1.0, 90)]
    x, none = spark.createDataFrame([("x0",)], "address string"), spark.createDataFrame([], "address string")
    out, state = f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    for k, load in enumerate([rows, [("late", "u3", "s1", 1.0, 79), ("in time", "s1", "x0", 1.0, 81)], [("c", "s1", "x0", 1.0, 82)], [("end", "", "", 0.0, 200)]]):
        reuse.add_transfers(spark, spark.createDataFrame(load, SCHEMA), k, x, none, none, 100, 0.01, 10, out, state)
    assert plain(reuse.matches_of(spark, out)) == [("u1", "s1", "x0", "c", "a", 72), ("u1", "s1", "x0", "in time", "a", 71)]


def test_no_file_no_match(spark, tmp_path):
    (tmp_path / "source").mkdir()
    none = spark.createDataFrame([], "address string")
    out = f"file://{tmp_path}/out"
    reuse.run_matches(spark, f"file://{tmp_path}/source", spark.createDataFrame([], SCHEMA).schema, none, none, none, 30, 0.01, 5, out, f"file://{tmp_path}/state")
    assert reuse.matches_of(spark, out).count() == 0
