"""Node vectors from walks: continuous bag of words with negative sampling, trained in blocks of walks whose models are averaged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.graphs import vocabulary_counts
from lodeweave.operators.materialize import discard, materialize

#: Exponent of the counts in the table that negatives are drawn from, and the share of all steps above which a node is thinned.
NOISE, FREQUENT = 0.75, 1e-3
LEAST_RATE = 1e-4


def _summed(place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A matrix of ``n`` rows and a column for each row of ``place``: the sums of the values whose place is that row."""
    columns = len(place)
    return np.bincount((place * columns + np.arange(columns)[:, None]).ravel(), value.ravel(), n * columns).reshape(n, columns)


def _train(walks: list[np.ndarray], start: np.ndarray, out: np.ndarray, counts: np.ndarray, kept: np.ndarray, window: int, negative: int, rates: tuple[float, float], rng: np.random.Generator) -> np.ndarray:
    """Train ``start`` (context vectors) and ``out`` (centre vectors) in place over the walks of a block; how often each node was trained.

    For each step of a walk, the mean of the vectors around it (a random width up to ``window``) is moved so that the step's
    node is told from ``negative`` nodes of the noise table. Steps are taken in small groups, whose updates are added up.
    """
    noise = np.cumsum(counts**NOISE)
    trained = np.zeros(len(start))
    group = int(np.clip(len(start) // 4, 8, 256))
    total, done = max(1, sum(len(w) for w in walks)), 0
    for walk in walks:
        own = walk[rng.random(len(walk)) < kept[walk]]
        n = len(own)
        if n > 1:
            reach = rng.integers(1, window + 1, n)
            steps = np.arange(-window, window + 1)
            around = np.arange(n)[:, None] + steps[None, :]
            there = (np.abs(steps)[None, :] <= reach[:, None]) & (steps != 0)[None, :] & (around >= 0) & (around < n)
            around = own[np.clip(around, 0, n - 1)]
            for at in range(0, n, group):
                centre, near, mask = own[at : at + group], around[at : at + group], there[at : at + group, :, None]
                size = np.maximum(mask.sum(1), 1)
                # how often each node is around each step, so that means and updates are products of small matrices
                nodes, inside = np.unique(near, return_inverse=True)
                share = _summed(inside.reshape(near.shape), mask[:, :, 0].astype(float), len(nodes))
                mean = share.T @ start[nodes] / size
                other = np.minimum(np.searchsorted(noise, rng.random((len(centre), negative)) * noise[-1], side="right"), len(noise) - 1)
                target = np.column_stack([centre, other])
                wanted = np.zeros(target.shape)
                wanted[:, 0] = 1
                use = np.column_stack([np.ones(len(centre), bool), other != centre[:, None]])
                score = 1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", mean, out[target]), -30, 30)))
                rate = rates[0] + (rates[1] - rates[0]) * done / total
                error = (wanted - score) * use * rate
                back = np.einsum("bk,bkd->bd", error, out[target])
                told, place = np.unique(target, return_inverse=True)
                place = place.reshape(target.shape)
                out[told] += _summed(place, error, len(told)) @ mean
                start[nodes] += share @ back
                trained[nodes] += share.sum(1)
                trained[told] += np.bincount(place.ravel(), use.ravel(), len(told))
        done += len(walk)
    return trained


def negative_sampling_embedding(
    walks: DataFrame, size: int = 128, window: int = 5, min_count: int = 5, epochs: int = 5, rate: float = 0.025, negative: int = 5, sample: float = FREQUENT,
    seed: int = 42, rounds: int = 1, walks_per_block: int = 20_000,
) -> DataFrame:
    """``node, vector`` of the nodes that occur at least ``min_count`` times in ``walks`` (``node, walk``).

    The model is a table, never a broadcast: a block of about ``walks_per_block`` walks gets the vectors of just the nodes that
    occur in it, trains them over its walks, and the vectors of all blocks meet by node, each weighted by how often the block
    trained it. That is done ``rounds`` times an epoch, each over its share of the walks, at a falling rate. Negatives are drawn from a
    block's nodes by their counts over all walks to the power 0.75. Nodes above the share ``sample`` of all steps are thinned.
    Blocks are dealt by a hash of the walk, so the same walks give the same vectors but for the order of sums.
    """
    spark = walks.sparkSession
    known = materialize(vocabulary_counts(walks, min_count).where("node IS NOT NULL"), "vocabulary")
    all_steps = known.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") / float(max(all_steps, 1))
    kept = F.least(F.lit(1.0), F.sqrt(sample / share) + sample / share) if sample else F.lit(1.0)
    kind = walks.schema["walk"].dataType.elementType
    table = spark.createDataFrame([], f"node {kind.simpleString()}, start array<float>, out array<float>")

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            start = np.array([(np.random.default_rng([h & 0xFFFFFFFFFFFFFFFF, seed]).random(size) - 0.5) / size for h in hashes.tolist()], np.float32).reshape(len(hashes), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(start), pa.list_(pa.float32())), pa.array([[0.0] * size] * len(hashes), pa.list_(pa.float32()))], names=["node", "start", "out"])

    model = materialize(known.select("node", F.xxhash64("node").alias("h")).mapInArrow(fresh, table.schema), "model")
    # a walk's steps that are in the vocabulary, in order, and its block
    steps = walks.select("walk", F.xxhash64("walk", F.lit(seed)).alias("key")).select("key", F.posexplode("walk").alias("at", "node")).join(known.select("node"), "node", "left_semi")
    corpus = materialize(steps.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("walk")), "walks")
    blocks = max(1, -(-corpus.count() // (walks_per_block * rounds)))
    last = epochs * rounds

    def trainer(k: int, rates: tuple[float, float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            nodes = right["node"].to_pylist()
            number = {node: i for i, node in enumerate(nodes)}
            vectors = [np.array(right[c].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(nodes), -1) for c in ("start", "out")]
            paths = [np.array([number[x] for x in w], np.int64) for w in left["walk"].to_pylist()]
            rng = np.random.default_rng([seed, k, left["block"][0].as_py() if left.num_rows else 0])
            trained = _train(paths, *vectors, right["n"].to_numpy(), right["kept"].to_numpy(), window, negative, rates, rng)
            rows = [right["node"], pa.array(list(vectors[0]), pa.list_(pa.float32())), pa.array(list(vectors[1]), pa.list_(pa.float32())), pa.array(trained)]
            return pa.table(rows, names=["node", "start", "out", "weight"])

        return run

    for k in range(last):
        own = corpus.where(F.pmod("key", F.lit(rounds)) == k % rounds) if rounds > 1 else corpus
        dealt = own.withColumn("block", F.pmod(F.xxhash64("key", F.lit(k)), F.lit(blocks)).cast("int"))
        needed = dealt.select(F.col("block").alias("of"), F.explode("walk").alias("node")).distinct()
        parts = needed.join(model, "node").join(known.select("node", F.col("n").cast("double").alias("n"), kept.alias("kept")), "node")
        rates = tuple(max(LEAST_RATE, rate - (rate - LEAST_RATE) * (k + step) / last) for step in (0, 1))

        found = dealt.select("block", "walk").groupBy("block").cogroup(parts.groupBy("of")).applyInArrow(trainer(k, rates), f"node {kind.simpleString()}, start array<float>, out array<float>, weight double")
        found = materialize(found, "found")
        # the weighted mean of each entry over the blocks of a node; a node that no block trained keeps its vectors
        entry = found.select("node", "weight", F.posexplode(F.arrays_zip("start", "out")).alias("i", "x"))
        total = F.greatest(F.sum("weight"), F.lit(1e-9))
        mean = entry.groupBy("node", "i").agg((F.sum(F.col("weight") * F.col("x.start")) / total).cast("float").alias("start"), (F.sum(F.col("weight") * F.col("x.out")) / total).cast("float").alias("out"), F.sum("weight").alias("weight"))
        whole = mean.where("weight > 0").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("i", "start", "out"))).alias("v"))
        whole = whole.select("node", F.transform("v", lambda x: x["start"]).alias("start"), F.transform("v", lambda x: x["out"]).alias("out"))
        before = model
        model = materialize(before.join(whole.select("node", F.col("start").alias("s"), F.col("out").alias("o")), "node", "left").select("node", F.coalesce("s", "start").alias("start"), F.coalesce("o", "out").alias("out")), "model")
        discard(before, found)
    discard(corpus, known)
    return model.select("node", F.col("start").cast("array<double>").alias("vector"))
