"""The negative-sampling embedding recovers planted groups of nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeweave.operators import embedding, graphs, vector_index

GROUPS, EACH = 4, 30


@pytest.fixture(scope="module")
def walks(spark):
    """Walks on a graph of four groups whose nodes have four times as many neighbours inside as outside."""
    rng = np.random.default_rng(12)
    near = {}
    for i in range(GROUPS * EACH):
        inside = [j for j in range(GROUPS * EACH) if j % GROUPS == i % GROUPS and j != i]
        outside = [j for j in range(GROUPS * EACH) if j % GROUPS != i % GROUPS]
        near[i] = [*rng.choice(inside, 8, replace=False), *rng.choice(outside, 2, replace=False)]
    rows = []
    for i in near:
        for _ in range(8):
            walk = [i]
            for _ in range(24):
                walk.append(int(rng.choice(near[walk[-1]])))
            rows.append((i, walk))
    rows += [(900, [900, 901]), (902, None), (903, [])]
    return spark.createDataFrame(rows, "node long, walk array<long>").repartition(4)


def precision(vectors):
    """The share of the five nearest by angle that are of a node's own group."""
    unit = vectors.select(F.col("node").cast("long").alias("vec_id"), F.transform("vector", lambda x: x / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b * b))).alias("embedding"))
    found = [(r.query_id, r.vec_id) for r in vector_index.nearest(unit, unit, 6).collect() if r.query_id != r.vec_id]
    return np.mean([a % GROUPS == b % GROUPS for a, b in found])


def test_groups_are_recovered(spark, walks):
    got = embedding.negative_sampling_embedding(walks, size=16, epochs=4, rate=0.08, sample=0.05, rounds=1, walks_per_block=400)
    rows = got.collect()
    assert sorted(r.node for r in rows) == list(range(GROUPS * EACH)) and all(len(r.vector) == 16 for r in rows)
    own = precision(got)
    from pyspark.ml.functions import vector_to_array

    other = precision(graphs.node_embedding(walks.where("walk IS NOT NULL"), size=16, epochs=4, rate=0.08).select("node", vector_to_array("vector").alias("vector")))
    assert own >= 0.9 and own >= other - 0.02, (own, other)


def test_nothing_to_learn(spark, walks):
    assert embedding.negative_sampling_embedding(walks.limit(0), size=4, epochs=1).count() == 0
    assert embedding.negative_sampling_embedding(walks.where("node = 900"), size=4, epochs=1, min_count=1).count() == 2


def test_training_adds_up_and_is_quick():
    """Means and updates of a group of steps against sums one by one, and a time that one row at a time would not keep."""
    import time

    rng = np.random.default_rng(3)
    place, value = rng.integers(0, 5, (7, 4)), rng.random((7, 4))
    want = np.zeros((5, 7))
    for i in range(7):
        for j in range(4):
            want[place[i, j], i] += value[i, j]
    assert np.allclose(embedding._summed(place, value, 5), want)
    walks = [rng.integers(0, 300, 59) for _ in range(400)]
    start, out = rng.random((300, 128)).astype(np.float32), np.zeros((300, 128), np.float32)
    began = time.process_time()
    trained = embedding._train(walks, start, out, np.ones(300), np.ones(300), 5, 5, (0.025, 0.01), rng)
    assert time.process_time() - began < 4 and trained.sum() > 400 * 59 * 6 * 0.9 and np.abs(out).max() > 0


def test_words_are_trained_in_several_tasks(walks, monkeypatch):
    from pyspark.ml import feature
    from pyspark.ml.functions import vector_to_array

    asked, plain = [], feature.Word2Vec.fit
    monkeypatch.setattr(feature.Word2Vec, "fit", lambda self, rows: asked.append(self.getNumPartitions()) or plain(self, rows))
    monkeypatch.setattr(graphs, "WALKS_PER_TASK", 240)
    found = graphs.node_embedding(walks.where("walk IS NOT NULL"), size=16, epochs=4, rate=0.08)
    assert asked == [4] and precision(found.select("node", vector_to_array("vector").alias("vector"))) >= 0.9
