"""Cluster ids over time, and how well clusters match known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.components import connected_components
from lodeweave.operators.joins import first_per_key


def merge_clusters(new: DataFrame, old: DataFrame) -> DataFrame:
    """``address, cluster``: clusters that share addresses become one, under the old id that most of its addresses have.

    ``new`` and ``old`` are ``address, cluster``. New and old clusters with a common address are joined by an edge; each
    component takes the most frequent old id (the smallest of equals), or its smallest new id where it has none.
    """
    both = new.select("address", F.col("cluster").alias("new")).join(old.select("address", F.col("cluster").alias("old")), "address")
    votes = both.groupBy("new", "old").agg(F.count(F.lit(1)).alias("n"))
    edges = votes.select(F.concat(F.lit("n:"), "new").alias("a"), F.concat(F.lit("o:"), "old").alias("b"))
    component = connected_components(edges, "a", "b")
    placed = votes.join(component.where("node LIKE 'n:%'").select(F.expr("substring(node, 3)").alias("new"), "component"), "new")
    counted = placed.groupBy("component", "old").agg(F.sum("n").alias("n"))
    mode = first_per_key(counted, ["component"], F.desc("n"), F.col("old")).select("component", F.col("old").alias("mode"))
    names = component.join(mode, "component").select(F.expr("substring(node, 3)").alias("id"), F.substring("node", 1, 1).alias("kind"), "mode")

    def renamed(rows: DataFrame, kind: str) -> DataFrame:
        own = names.where(F.col("kind") == kind).select(F.col("id").alias("cluster"), "mode")
        return rows.select("address", F.col("cluster").cast("string").alias("cluster")).join(own, "cluster", "left").select("address", F.coalesce("mode", "cluster").alias("cluster"))

    gone = old.join(new.select("address"), "address", "left_anti")
    return renamed(new, "n").unionByName(renamed(gone, "o"))


def evaluate_clusters(predicted: DataFrame, known: DataFrame) -> DataFrame:
    """``cluster, precision, recall`` for each known cluster of several members, from ``member, cluster`` on both sides.

    Of the predicted clusters that hold members of a known one, the one with most of them is compared (the smallest id
    of equals).
    """
    sizes = predicted.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    real = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("real")).where("real > 1")
    p = predicted.select("member", F.col("cluster").alias("guess"))
    hits = known.join(p, "member").groupBy("cluster", "guess").agg(F.count(F.lit(1)).alias("hit"))
    best = first_per_key(hits, ["cluster"], F.desc("hit"), F.col("guess"))
    found = real.join(best, "cluster", "left").join(sizes.withColumnRenamed("cluster", "guess"), "guess", "left")
    hit = F.coalesce("hit", F.lit(0))
    return found.select("cluster", F.coalesce(hit / F.col("size"), F.lit(0.0)).alias("precision"), (hit / F.col("real")).alias("recall"))


def responses(user_clusters: DataFrame, exchange_clusters: DataFrame, metadata: DataFrame) -> DataFrame:
    """``address, entity, conf, user_cluster, exchange_cluster``: the metadata of each address with its clusters (``address, cluster``), null where it has none.

    An address in two clusters of one kind raises.
    """

    def single(rows: DataFrame, name: str) -> DataFrame:
        found = rows.groupBy("address").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"))
        several = F.raise_error(F.concat(F.lit(f"in more than one {name}: "), F.col("address").cast("string")))
        return found.select("address", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(several).alias(name))

    own = metadata.select("address", "entity", "conf")
    return own.join(single(user_clusters, "user_cluster"), "address", "left").join(single(exchange_clusters, "exchange_cluster"), "address", "left")


def cluster_mates(addresses: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked, address, entity, conf``: for each asked address the others of its cluster; an exchange is looked up by its exchange cluster, others by
    their user cluster. ``addresses`` is what ``responses`` returns."""
    own = addresses.join(asked.select("address").distinct(), "address", "left_semi")
    key = F.when(F.col("entity") == 2, F.struct(F.lit("e").alias("kind"), F.col("exchange_cluster").alias("cluster"))).otherwise(F.struct(F.lit("u").alias("kind"), F.col("user_cluster").alias("cluster")))
    own = own.select(F.col("address").alias("asked"), F.col("entity").alias("asked_entity"), key.alias("key")).where("key.cluster IS NOT NULL")
    kinds = F.array(F.struct(F.lit("u").alias("kind"), F.col("user_cluster").alias("cluster")), F.struct(F.lit("e").alias("kind"), F.col("exchange_cluster").alias("cluster")))
    members = addresses.select("address", "entity", "conf", F.explode(kinds).alias("key")).where("key.cluster IS NOT NULL")
    return own.join(members, "key").where("asked <> address").select("asked", "address", "entity", "conf").distinct()
