"""Samples, ranks, timelines, address pages, components' names and reductions on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.functions import scalars as S
from lodeweave.operators import clusters, graphs, reports


def test_hash_sample_and_its_merge(spark):
    import hashlib

    names = [f"a{i}" for i in range(500)]
    df = spark.createDataFrame([(x,) for x in [*names, *names[:50], None]], "address string")
    key = lambda x: hashlib.md5(f"7:{x}".encode()).hexdigest()
    want = sorted(names, key=key)
    for size in (0, 1, 37, 500, 900):
        assert {r.address for r in reports.hash_sample(df, size, 7).collect()} == set(want[:size])
    loads = [reports.hash_sample(df.where(F.pmod(F.xxhash64("address"), F.lit(3)) == k), 40, 7) for k in range(3)]
    assert {r.address for r in reports.merge_samples(loads, 40, 7).collect()} == set(want[:40])
    # ranks in samples stay within the stated error of the true ones
    rng = random.Random(1)
    value = {x: rng.randrange(30) for x in names}
    wrong = 0
    for seed in range(20):
        own = [value[r.address] for r in reports.hash_sample(df, 100, seed).collect()]
        wrong += max(abs(np.mean([v < t for v in own]) - np.mean([v < t for v in value.values()])) for t in range(31)) > reports.sample_error(100, 0.01)
    assert wrong <= 1 and reports.sample_error(100, 0.01) == pytest.approx(math.sqrt(math.log(200) / 200))


def test_ranks_of_counts_that_the_sample_lacks(spark):
    counts = spark.createDataFrame([("a", 0, 5), ("b", 0, 2), ("c", 0, 1)], "address string, heuristic int, n long")
    dist = spark.createDataFrame([(0, 0, 6), (0, 2, 3), (0, 9, 1)], "heuristic int, reveals long, frequency long")
    assert {r.address: (r["rank"], r.percent) for r in reports.rank_within(counts, dist).collect()} == {"a": (0.9, 90), "b": (0.6, 60), "c": (0.6, 60)}


def test_weeks_of_windows_in_months(spark):
    rows = spark.createDataFrame([("2024-02-26 10:00:00", 0), ("2024-02-27 00:00:00", 1), ("2024-01-28 00:00:00", 1)], "t string, heuristic int").select(F.col("t").cast("timestamp_ntz").alias("ts"), "heuristic")
    got = {(r.months, r.week): (str(r.start), r.by_0, r.by_1) for r in reports.weekly_windows(rows, "ts", "2024-02-28", [1, 3], [0, 1]).collect()}
    # 31 days before are four whole weeks; the days after them are in none
    assert [got[1, k][0] for k in range(4)] == ["2024-01-28", "2024-02-04", "2024-02-11", "2024-02-18"] and (1, 4) not in got
    assert got[1, 0][1:] == (0, 1) and got[1, 3][1:] == (0, 0) and sum(x[1] + x[2] for k, x in got.items() if k[0] == 3) == 2  # 13 weeks end on 27 February


def test_address_page_has_neighbours_first(spark):
    responses = spark.createDataFrame(
        [("u1", 0, 0.9, "c", None), ("u2", 0, 0.8, "c", None), ("d1", 1, 0.95, "c", "e"), ("x1", 2, 1.0, None, "e"), ("lone", 0, 0.5, None, None)],
        "address string, entity int, conf double, user_cluster string, exchange_cluster string")
    near = spark.createDataFrame([("u1", "u1", 0.0), ("u1", "n2", 0.4), ("u1", "n1", 0.1), ("new", "u1", 0.2)], "asked string, address string, distance double")
    asked = spark.createDataFrame([("u1",), ("x1",), ("new",), ("lone",), ("nobody",)], "address string")
    rows = sorted(tuple(r) for r in reports.address_page(responses, near, asked, 0, 2).select("asked", "place", "address", "entity", "cluster_size", "pages").collect())
    assert rows == [
        ("new", 1, "u1", "node", 1, 1), ("u1", 1, "n1", "node", 5, 3), ("u1", 2, "n2", "node", 5, 3), ("u1", 3, "d1", "deposit", 5, 3), ("u1", 4, "u1", "eoa", 5, 3),
        ("x1", 1, "x1", "exchange", 2, 1), ("x1", 2, "d1", "deposit", 2, 1)]
    second = [r.address for r in reports.address_page(responses, near, asked, 1, 2).where("asked = 'u1' AND entity <> 'node'").collect()]
    assert second == ["u2"]


def test_orders_and_complete_rows(spark):
    comps = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")], "node string, component string")
    assert [tuple(r) for r in graphs.components_by_size(comps).collect()] == [("a", 2), ("c", 2), ("e", 1)]
    rows = spark.createDataFrame([(2, 1, "a", "t2"), (1, 3, "b", "t9"), (1, 0, "c", "t3"), (1, 0, "c", "t1")], "ts long, heuristic int, address string, transaction string")
    assert [r.transaction for r in reports.sorted_timeline(rows).collect()] == ["t1", "t3", "t9", "t2"]
    assert reports.complete(spark.createDataFrame([(1, None), (None, "a"), (2, "b")], "a long, b string")).count() == 1
    with pytest.raises(Exception, match="no such node id"):
        graphs.decode_nodes(spark.createDataFrame([(7,)], "src long"), spark.createDataFrame([("a", 1)], "node string, id long"), ["src"]).collect()


def test_an_old_cluster_across_two_new_ones(spark):
    new = spark.createDataFrame([("a", "n1"), ("b", "n1"), ("c", "n2"), ("d", "n2"), ("e", "n3")], "address string, cluster string")
    old = spark.createDataFrame([("a", "o1"), ("c", "o1"), ("b", "o2"), ("z", "o2"), ("y", "o9")], "address string, cluster string")
    got = {r.address: r.cluster for r in clusters.merge_clusters(new, old).collect()}
    assert got == {"a": "o1", "b": "o1", "c": "o1", "d": "o1", "z": "o1", "e": "n3", "y": "o9"}


def test_texts_dates_and_maps(spark):
    row = spark.range(1).select(
        S.without_prefix(F.lit("Pool 0.1"), "Pool "), S.without_prefix(F.lit("x"), "Pool "), S.parse_date(F.lit("02/29/2024")).cast("string"), S.parse_date(F.lit("02/30/2024")),
        S.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")), F.lit(None).cast("map<string,string>")),
    ).first()
    assert tuple(row) == ("0.1", "x", "2024-02-29", None, {"a": "1", "b": "3"})


def test_principal_components_are_those_of_the_covariance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) * [5, 3, 2, 0.5, 0.1] + 7
    got = graphs.principal_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 3).orderBy("vec_id").collect()
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ axes[:, ::-1][:, :3]
    have = np.array([[r.c1, r.c2, r.c3] for r in got])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-8)


def test_vocabulary_counts(spark):
    walks = spark.createDataFrame([([1, 2, 1],), ([2, 3],), ([],), (None,)], "walk array<long>")
    assert {(r.node, r.n) for r in graphs.vocabulary_counts(walks, 2).collect()} == {(1, 2), (2, 2)}
