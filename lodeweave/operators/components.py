"""Weakly connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodeweave.operators.materialize import discard, materialize


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """The edges as a table, with their number and checksum, taken while it is written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return out, seen.get


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    joined = both.where("v > u").join(low, "u")
    return joined.select(F.col("v").alias("u"), F.least("u", "low").alias("v"))  # repeats go in the small star


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """One row ``(node, component)`` for each node of a non-loop edge; ``component`` is its smallest reachable node.

    Nulls and self loops are dropped and repeated edges count once. Each round is written to the shared folder, and
    only a row count and a checksum come to the driver. Stars are joined on the node, so a hub is an ordinary skewed
    join key that adaptive execution splits.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    edges, before = _written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        last = edges
        edges, now = _written(_small_star(_large_star(edges)), "stars")
        discard(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    found = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "components")
    discard(edges)
    return found
