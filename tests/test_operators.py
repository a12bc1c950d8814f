"""Edge cases of the operators on hand-written rows."""

import random

import numpy as np
import pytest

from lodeweave.functions import scalars as S
from lodeweave.operators import graphs, heuristics, joins, reports, vector_index
from lodeweave.operators.components import connected_components
from pyspark.sql import functions as F


def txs(spark, rows, recipient=False):
    schema = "hash long, from_address long, gas_price double, block_timestamp timestamp_ntz, pool int, block_number long"
    df = spark.createDataFrame([(h, a, g, None, p, b) for h, a, g, p, b in rows], schema)
    df = df.withColumn("block_timestamp", F.timestamp_seconds(F.col("block_number") * 3600).cast("timestamp_ntz"))
    return df.withColumn("recipient_address", F.col("from_address")) if recipient else df


def test_equal_times_are_no_link(spark):
    d = txs(spark, [(1, 7, 1.0, 0, 5)])
    w = txs(spark, [(2, 7, 1.0, 0, 5), (3, 7, 1.0, 0, 6)], True)
    assert [r.withdraw_hash for r in heuristics.exact_match_links(d, w).collect()] == [3]


def test_deposit_window_leaves_the_anchor_out_and_both_ends_count(spark):
    d = txs(spark, [(1, 7, 1.0, 0, 0), (2, 7, 1.0, 1, 24), (3, 7, 1.0, 1, 49)])
    found = {r["hash"]: [(x.category, x.n) for x in r.portfolio] for r in heuristics.deposit_portfolios(d, [0, 1], 1).collect()}
    assert found == {1: [], 2: [(0, 1)], 3: []}


def test_nearest_receipt_of_the_wrong_amount_hides_a_farther_right_one(spark):
    schema = "transaction string, from_address string, to_address string, value double, block long"
    t = spark.createDataFrame([("a", "u1", "s1", 1.0, 1), ("b", "u2", "s1", 1.04, 2), ("c", "s1", "x0", 1.0, 3), ("d", "u3", "s2", 1.0, 3), ("e", "s2", "x0", 1.0, 3)], schema)
    x = spark.createDataFrame([("x0",)], "address string")
    none = spark.createDataFrame([], "address string")
    found = heuristics.reuse_matches(t, x, x, none, 0.01, 10).collect()
    assert [(r.user_address, r.forward_tx) for r in found] == [("u3", "e")]
    assert heuristics.reuse_matches(t, x, x, none, 0.05, 10).count() == 2
    assert heuristics.reuse_matches(t.limit(0), x, x, none).count() == 0


def test_typed_pairs_in_both_ways_and_strict(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "x long, y long")
    d = spark.createDataFrame([(1,), (2,)], "address long")
    w = spark.createDataFrame([(1,), (2,)], "address long")
    assert sorted(tuple(r) for r in joins.typed_pairs(pairs, d, w).collect()) == [(1, 2), (2, 1)]
    with pytest.raises(Exception, match="no such pair type"):
        joins.typed_pairs(pairs, d, w, strict=True).collect()


def test_upsert_updates_only_named_columns(spark):
    old = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.2)], "k int, c string, conf double")
    new = spark.createDataFrame([(2, "z", 0.9), (3, "y", 0.8)], "k int, c string, conf double")
    assert sorted(tuple(r) for r in joins.upsert(old, new, "k", ["c"]).collect()) == [(1, "a", 0.1), (2, "z", 0.2), (3, "y", 0.8)]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(900 + i, 901 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1), (5, 5)], "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_euler_walk_visits_each_edge_twice():
    walk = graphs.euler_walk([10, 11, 12, 13], [-1, 0, 1, 0])
    assert walk[0] == walk[-1] == 10 and len(walk) == 7
    steps = sorted(tuple(sorted(x)) for x in zip(walk, walk[1:]))
    assert steps == sorted([(10, 11), (10, 13), (11, 12)] * 2)


def test_walks_stay_on_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src long, dst long")
    near = {1: {2, 3}, 2: {1, 3}, 3: {1, 2}, 7: {8}, 8: {7}}
    rows = graphs.diffusion_walks(edges, cover=4).collect()
    assert {r.node for r in rows} == set(near)
    assert all(b in near[a] for r in rows for a, b in zip(r.walk, r.walk[1:]))


def test_density_is_the_sum_over_all_points(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 3)) @ np.array([[1, 0.9, 0], [0, 0.3, 0], [0, 0, 2]]), [[1000.0, 0, 0]]])
    inverse = np.linalg.inv(covariance := np.cov(x.T) * len(x) ** (-2 / 7))
    apart = x[:, None, :] - x[None, :, :]
    want = np.exp(-0.5 * np.einsum("abi,ij,abj->ab", apart, inverse, apart)).sum(1) / (len(x) * np.sqrt(np.linalg.det(2 * np.pi * covariance)))
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    for block_rows in (1 << 18, 50):
        got = {r.vec_id: r.density for r in graphs.density(spark.createDataFrame(rows, "vec_id long, a double, b double, c double"), ["a", "b", "c"], block_rows=block_rows).collect()}
        assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-9, atol=0)


def test_rounding_and_names(spark):
    row = spark.range(1).select(S.round_half_even(F.lit(0.25), 1), S.name_of(F.lit(2), S.ENTITIES), S.number_of(F.lit("dex"), S.ENTITIES), S.is_address(F.lit("0x" + "a" * 40))).first()
    assert tuple(row) == (0.2, "exchange", 3, True)
    with pytest.raises(Exception, match="no such number"):
        spark.range(1).select(S.name_of(F.lit(40), S.ENTITIES)).collect()


def test_ether_of_large_amounts(spark):
    assert spark.range(1).select(S.ether(F.lit("1500000000000000000000").cast("decimal(38,0)"))).first()[0] == 1500.0


def test_page_limits(spark):
    assert reports.page(spark.range(200), ["id"], number=-3, limit=500).count() == 50


def test_files_round_trip(spark, tmp_path):
    from lodeweave.sources import files

    df = spark.createDataFrame([("0xb", "2"), ("0xa", "1")], files.CALL_TABLE)
    files.write_sorted(df, str(tmp_path / "s"), "address", partitions=1)
    assert [r.address for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["0xa", "0xb"]
    files.write_table(df, str(tmp_path / "c"), fmt="csv")
    assert files.read_csv(spark, str(tmp_path / "c"), files.CALL_TABLE).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    from lodeweave.sources import files

    rows = [("0xa", "1"), ("0xb", "2"), ("0xc", "3")]
    df = spark.createDataFrame(rows, files.CALL_TABLE)
    first, second = (str(tmp_path / x) for x in "ab")
    for path in (first, second):
        files.write_table(df, path, fmt="csv")
    both = files.read_csv(spark, [first, second], files.CALL_TABLE)
    assert sorted(map(tuple, both.collect()), key=str) == sorted(rows * 2, key=str)
    files.write_table(df.limit(1), first, fmt="csv", mode="append")
    assert files.read_csv(spark, first, files.CALL_TABLE).count() == 4
    files.write_table(df.limit(1), first, fmt="csv", mode="overwrite")
    assert files.read_csv(spark, first, files.CALL_TABLE).count() == 1
    files.write_table(df, str(tmp_path / "j"), fmt="json")
    assert sorted(r.address for r in files.read_json(spark, str(tmp_path / "j"), files.CALL_TABLE).collect()) == ["0xa", "0xb", "0xc"]
    spark.range(1).createOrReplaceTempView("listed_table")
    assert "listed_table" in files.table_names(spark)
    (tmp_path / "p.txt").write_text("0xa|1\n0xb|2\n")
    assert [tuple(r) for r in files.read_piped(spark, str(tmp_path / "p.txt"), files.CALL_TABLE).orderBy("address").collect()] == [("0xa", "1"), ("0xb", "2")]


def test_reward_claims_from_both_sides(spark):
    d = txs(spark, [(1, 7, 1.0, 0, 10), (2, 8, 1.0, 0, 20)])
    w = txs(spark, [(11, 9, 1.0, 0, 15), (12, 7, 1.0, 0, 25)], True)
    rates = spark.createDataFrame([(0, 4), (1, None)], "pool int, rate int")
    claims = spark.createDataFrame([(50, 7, 20), (51, 9, 20), (52, 7, 20), (53, 7, 21)], "hash long, recipient long, points long")
    got = {tuple(r)[:3] for r in heuristics.reward_claim_links(claims, d, w, rates).collect()}
    # 5 blocks: deposit 1 by address 7 and withdrawal 11 to 9; deposit 2 and withdrawal 12 to 7
    assert got == {(50, 1, 11), (52, 1, 11), (51, 1, 11), (50, 2, 12), (52, 2, 12)}
    last = {tuple(r)[:3] for r in heuristics.reward_claim_links(claims, d, w, rates, last_claim_only=True).collect()}
    assert last == {(52, 1, 11), (51, 1, 11), (52, 2, 12)}


def test_known_addresses_split_counts_missing_values_as_different(spark):
    known = spark.createDataFrame([("a", "eoa", "exchange"), ("b", None, "exchange"), ("c", "eoa", None), ("d", "eoa", "dex")], "address string, account_type string, entity string")
    exchanges, others = heuristics.split_known(known)
    assert [r.address for r in exchanges.collect()] == ["a"] and sorted(r.address for r in others.collect()) == ["b", "c", "d"]


def test_miners_and_names_of_exchanges(spark):
    schema = "transaction string, from_address string, to_address string, value double, block long"
    t = spark.createDataFrame([("a", "u1", "s1", 1.0, 1), ("c", "s1", "x0", 1.0, 3), ("d", "u3", "s2", 1.0, 3), ("e", "s2", "x1", 1.0, 3)], schema)
    x = spark.createDataFrame([("x0",), ("x1",)], "address string")
    found = heuristics.reuse_matches(t, x, x, spark.createDataFrame([("u1",)], "address string"), 0.01, 10)
    assert [r.user_address for r in found.collect()] == ["u3"]
    found = heuristics.reuse_matches(t, x, x, x.limit(0), 0.01, 10)
    names = spark.createDataFrame([("x0", "North")], "address string, name string")
    got = {(r.address, r.entity): r.meta_data for r in heuristics.reuse_attributes(found, names).collect()}
    assert got["x0", 2] == '{"name":"North"}' and got["x1", 2] == '{"name":null}' and got["u1", 0] == "{}"
    assert got["s1", 1] == '{"exchange_address":"x0","exchange_name":"North","name":"Deposit for North"}'


def test_address_filter(spark):
    df = spark.createDataFrame([("Ab", 0.9, 0), ("cd", 0.4, 1), ("ab", None, 0)], "address string, conf double, entity int")
    assert reports.address_filter(df, max_conf=0.5).count() == 1
    assert reports.address_filter(df, name="AB").count() == 2
    assert reports.address_filter(df, min_conf=0.5, entity=0, name="ab").count() == 1


def test_nearest_takes_equal_distances_by_id(spark):
    rows = [(i, [0.0, 1.0]) for i in range(60, 0, -1)] + [(100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vector_index.nearest(df.where("vec_id = 100"), df, 5).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3, 4, 100]


def test_walks_reach_all_neighbours_of_a_hub(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 201)], "src long, dst long")
    rows = graphs.diffusion_walks(edges, cover=4, most_rounds=90).collect()
    assert len(rows) == 201 and all(len(set(r.walk)) == 4 for r in rows)
    assert len({x for r in rows for x in r.walk[1:] if x != r.node}) > 150


def test_calls_of_other_kinds_raise(spark):
    from lodeweave.operators import decoding

    txs_ = spark.createDataFrame([(1, "0xp", "0x")], "hash long, to_address string, input string")
    pools = spark.createDataFrame([("0xp",)], "address string")
    trace = lambda *selectors: spark.createDataFrame([(1, x) for x in selectors], "transaction_hash long, input string")
    assert [r.kind for r in decoding.pool_calls(txs_, trace(S.DEPOSIT_SELECTOR), pools).collect()] == ["deposit"]
    for selectors, message in [(("0x00000000",), "neither deposit"), ((S.DEPOSIT_SELECTOR, S.WITHDRAW_SELECTOR), "not just one"), ((), "not just one")]:
        with pytest.raises(Exception, match=message):
            decoding.pool_calls(txs_, trace(*selectors), pools).collect()


def test_files_of_graphs(spark, tmp_path):
    graphs.write_adjacency(spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"), str(tmp_path / "a"), rows_per_file=1)
    assert sorted((r.node, r.neighbours) for r in spark.read.option("header", True).csv(str(tmp_path / "a")).collect()) == [("1", "2 3"), ("2", "1"), ("3", "1")]
    for _ in range(2):
        graphs.write_vectors(spark.createDataFrame([("a", [1.0, 2.0])], "node string, vector array<double>"), str(tmp_path / "v"))
    assert [r.vector for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [[1.0, 2.0]]


def _reward_case(spark):
    """Claims, deposits, withdrawals and rates where links come from both sides and some blocks hold several transactions, of which one has no address."""
    rng = np.random.default_rng(5)
    side = lambda first: [(first + i, None if i == 3 else int(rng.integers(0, 7)), 1.0, 0, int(rng.integers(0, 9))) for i in range(40)]
    d, w = txs(spark, side(1000)), txs(spark, side(2000), True)
    claims = spark.createDataFrame([(i, int(rng.integers(0, 7)), int(rng.integers(0, 4)) * 4) for i in range(6)], "hash long, recipient long, points long")
    return claims, d, w, spark.createDataFrame([(0, 4), (1, None)], "pool int, rate int")


def test_reward_links_are_not_shuffled_to_be_counted_once(spark):
    case = _reward_case(spark)
    claims, d, w, _ = ([r.asDict() for r in df.collect()] for df in case)
    want = sorted({
        (c["hash"], a["hash"], b["hash"]) for c in claims for a in d for b in w
        if c["recipient"] in (a["from_address"], b["recipient_address"]) and a["block_number"] + c["points"] // 4 == b["block_number"]
    })
    links = heuristics.reward_claim_links(*case)
    assert sorted(tuple(r)[:3] for r in links.collect()) == want and len(want) > 50
    # repeated rows of a transaction or claim count once
    claims, d, w, rates = case
    assert heuristics.reward_claim_links(claims.union(claims), d.union(d), w.union(w), rates).count() == len(want)
    # the union of the two joins is the last step: nothing above it groups the links
    assert links._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_reward_members_and_stars_stand_for_the_links(spark):
    case = _reward_case(spark)
    claims, d, w, rates = case
    links = heuristics.reward_claim_links(*case)
    members = {x for r in links.collect() for x in (r.deposit_hash, r.withdraw_hash)}
    assert sorted(r[0] for r in heuristics.reward_claim_members(*case).collect()) == sorted(members)
    stars = heuristics.reward_claim_stars(*case)
    assert stars.count() < links.count()
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(connected_components(stars)) == plain(connected_components(links, "deposit_hash", "withdraw_hash"))
    owners = d.select(F.col("hash").alias("transaction"), F.col("from_address").alias("address")).union(w.select("hash", "recipient_address"))
    pairs = lambda edges, a, b: connected_components(heuristics.address_matches(edges, owners, a, b), "x", "y")
    assert plain(pairs(stars, "src", "dst")) == plain(pairs(links, "deposit_hash", "withdraw_hash"))


def test_reward_members_shuffle_what_asks_only_by_transaction(spark):
    members = heuristics.reward_claim_members(*_reward_case(spark))
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan  # before, all that ask were dealt by pool and block, with their claims
    assert "claim_hash" not in plan
    # the blocks of the other side are a table whose size Spark knows, so few of them are broadcast whatever asks
    planned = members._jdf.queryExecution().sparkPlan().toString()
    assert planned.count("BroadcastHashJoin [pool") >= 2


def test_receipts_of_listed_addresses_are_not_kept_by_the_stream(spark):
    from lodeweave.streaming import reuse

    schema = "transaction string, from_address string, to_address string, value double, block long"
    t = spark.createDataFrame([("a", "u1", "s1", 1.0, 1), ("b", "s1", "x0", 1.0, 2), ("c", "u1", "m", 1.0, 2)], schema)
    x, m = (spark.createDataFrame([(a,)], "address string") for a in ("x0", "m"))
    assert sorted((r.deposit, r.side) for r in reuse._sides(t, x, x, m, "1 day").collect()) == [("s1", 0), ("s1", 1)]


def test_reuse_takes_the_last_receipt_of_a_block_by_its_text(spark):
    schema = "transaction string, from_address string, to_address string, value double, block long"
    t = spark.createDataFrame([("a", "u1", "s1", 1.0, 2), ("ab", "u2", "s1", 1.0, 2), ("c", "s1", "x0", 1.0, 3), ("b", "s1", "x0", 1.0, 3), ("a0", "s1", "x0", 1.0, 2)], schema)
    x, none = spark.createDataFrame([("x0",)], "address string"), spark.createDataFrame([], "address string")
    found = heuristics.reuse_matches(t, x, x, none, 0.01, 10)
    assert found.columns == ["user_address", "deposit", "exchange", "forward_tx", "receipt_tx", "receipt_block", "t_diff", "a_diff"]
    # a text goes before those that it begins, as in SQL; receipts of a block go before its forwards
    assert sorted((r.forward_tx, r.receipt_tx, r.user_address, r.receipt_block, r.t_diff) for r in found.collect()) == [("a0", "ab", "u2", 2, 0), ("b", "ab", "u2", 2, 1), ("c", "ab", "u2", 2, 1)]
