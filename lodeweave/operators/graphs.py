"""Graphs as edge tables: weights, degrees, encoding, subgraphs, walks, neighbours and reductions of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.operators.components import connected_components
from lodeweave.operators.materialize import discard, materialize


def edge_weights(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` with every edge once."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct neighbours ``node, neighbour`` in both directions, without loops."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour")))
    return both.where("node <> neighbour").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree`` counting repeated edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def eulerian(edges: DataFrame) -> DataFrame:
    """One row: number of nodes of odd degree, of components, and whether a closed (0 odd) or open (2 odd) Euler walk exists."""
    odd = degrees(edges).agg(F.count_if(F.col("degree") % 2 == 1).alias("odd_nodes"))
    parts = connected_components(edges, "src", "dst").agg(F.count_distinct("component").alias("components"))
    # two single rows
    return odd.crossJoin(F.broadcast(parts)).withColumn("is_eulerian", (F.col("components") == 1) & F.col("odd_nodes").isin(0, 2))


def encode_nodes(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """``node, id``: ids from 0 without gaps in order of the nodes.

    The nodes are sorted by range; each range then starts where the ones before end, by a table with a row for each range.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return numbered(nodes, ["node"], partitions)


def numbered(rows: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with an ``id`` from 0 without gaps in order of the ``columns``."""
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *columns).sortWithinPartitions(*columns)
    parts = materialize(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")), "numbered")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("part", F.coalesce(F.sum("n_").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.col("m").bitwiseAND((1 << 33) - 1)
    return parts.join(before, "part").select(*rows.columns, (F.col("before") + own).alias("id"))


def decode_nodes(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the ids in ``columns`` replaced by their nodes (``ids``: ``node, id``); unknown ids raise."""
    for c in columns:
        named = rows.join(ids.select(F.col("id").alias(c), F.col("node").alias("__node")), c, "left")
        unknown = F.raise_error(F.concat(F.lit("no such node id: "), F.col(c).cast("string")))
        rows = named.select(*[F.when(F.col(c).isNull(), None).otherwise(F.coalesce("__node", unknown)).alias(c) if x == c else F.col(x) for x in rows.columns])
    return rows


def components_by_size(components: DataFrame) -> DataFrame:
    """``component, size``, the largest first, equal ones by name; from ``node, component``."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    own = nodes.select("node").distinct()
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """``node, neighbours`` (sorted array)."""
    return both_ways(edges).groupBy("node").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))


def write_adjacency(edges: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Adjacency lists as CSV, ``node`` and its neighbours divided by blanks, so many rows in a file at most."""
    rows = adjacency(edges).select("node", F.array_join("neighbours", " ").alias("neighbours"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("header", True).csv(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (``node, vector``) as Parquet arrays of doubles, replaced as a whole."""
    from pyspark.ml.functions import vector_to_array

    kind = vectors.schema["vector"].dataType.typeName()
    column = F.col("vector") if kind == "array" else vector_to_array("vector")
    vectors.select("node", column.cast("array<double>").alias("vector")).write.mode("overwrite").parquet(path)


def numbered_neighbours(edges: DataFrame, buckets: int = 64) -> DataFrame:
    """``node, k, neighbour, degree``: the distinct neighbours of each node by number from 0, with the neighbour's own degree.

    A node's neighbours are numbered by hash buckets, so that a hub's are sorted in many tasks.
    """
    near = materialize(both_ways(edges).withColumn("bucket", F.pmod(F.xxhash64("neighbour"), F.lit(buckets)).cast("int")), "neighbours")
    sizes = near.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("node").orderBy("bucket")) - F.col("n"))
    degree = sizes.groupBy(F.col("node").alias("neighbour")).agg(F.sum("n").alias("degree"))
    own = near.withColumn("own", F.row_number().over(Window.partitionBy("node", "bucket").orderBy("neighbour")) - 1)
    numbered = own.join(before, ["node", "bucket"]).select("node", (F.col("before") + F.col("own")).alias("k"), "neighbour")
    return materialize(numbered.join(degree, "neighbour").select("node", "k", "neighbour", "degree"), "numbered")


def diffusion_walks(edges: DataFrame, cover: int = 30, seed: int = 42, most_rounds: int | None = None) -> DataFrame:
    """``node, walk``: from each node a diffusion over at most ``cover`` nodes, as the Euler walk of its tree.

    Each round every unfinished tree draws one of its nodes and one of all neighbours of that node (hashes of seed, root
    and round); a neighbour not in the tree yet joins it, else the tree draws again in the next round, ``most_rounds``
    times at most (four times ``cover``). A tree that already holds its whole component is finished. The walk goes down
    and up every branch, so it starts and ends at its root.
    """
    near = numbered_neighbours(edges)
    component = connected_components(near, "node", "neighbour")
    size = component.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    most = component.join(size, "component").select("node", F.least("size", F.lit(cover)).alias("most"))
    degree = near.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    trees = degree.join(most, "node").select(F.col("node").alias("root"), "most", F.array("node").alias("members"), F.array("degree").alias("degrees"), F.array(F.lit(-1)).alias("parents"))
    growing = last = materialize(trees, "trees")
    done = None
    drawn = near.select(F.col("node").alias("from"), F.col("k").alias("draw"), F.col("neighbour").alias("new"), F.col("degree").alias("new_degree"))
    for k in range(most_rounds or 4 * cover):
        at = F.pmod(F.xxhash64(F.lit(seed), "root", F.lit(k)), F.size("members")).cast("int")
        growing = growing.withColumn("at", at).withColumn("from", F.get("members", F.col("at")))
        growing = growing.withColumn("draw", F.pmod(F.xxhash64(F.lit(seed + 1), "root", F.lit(k)), F.get("degrees", F.col("at"))))
        fresh = (F.size("members") < F.col("most")) & ~F.array_contains("members", F.col("new"))
        add = lambda column, value: F.when(fresh, F.array_append(column, value)).otherwise(F.col(column)).alias(column)
        growing = growing.join(drawn, ["from", "draw"]).select("root", "most", add("members", F.col("new")), add("degrees", F.col("new_degree")), add("parents", F.col("at")))
        if k % 6 == 5:
            drawn_trees = materialize(growing, "trees")
            discard(last)
            finished = materialize(drawn_trees.where(F.size("members") >= F.col("most")), "finished")
            done = finished if done is None else done.unionByName(finished)
            growing = last = materialize(drawn_trees.where(F.size("members") < F.col("most")), "trees")
            discard(drawn_trees)
            if growing.isEmpty():
                break
    trees = growing if done is None else done.unionByName(growing)

    def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["root"], "walk": [euler_walk(list(m), list(p)) for m, p in zip(batch["members"], batch["parents"], strict=True)]})

    kind = edges.schema["src"].dataType.simpleString()
    return trees.select("root", "members", "parents").mapInPandas(walks, f"node {kind}, walk array<{kind}>")


def euler_walk(members: list, parents: list[int]) -> list:
    """The walk along both sides of every edge of a tree given by each member's parent index (-1: the root)."""
    children: list[list[int]] = [[] for _ in members]
    for k, p in enumerate(parents):
        if p >= 0:
            children[p].append(k)
    walk, stack = [members[0]], [(0, iter(children[0]))]
    while stack:
        child = next(stack[-1][1], None)
        if child is None:
            stack.pop()
            if stack:
                walk.append(members[stack[-1][0]])
        else:
            walk.append(members[child])
            stack.append((child, iter(children[child])))
    return walk


#: Walks that a task of Spark's word2vec trains, and the most tasks.
WALKS_PER_TASK, MOST_TASKS = 4_000, 12
#: Numbers in the vectors of a model that may pass through the driver, which takes about 40 bytes for each.
MOST_NUMBERS = 1 << 22


def node_embedding(walks: DataFrame, size: int = 128, window: int = 5, min_count: int = 5, epochs: int = 5, rate: float = 0.025, seed: int = 42) -> DataFrame:
    """``node, vector`` by word2vec over walks (skip-gram with a hierarchical softmax).

    Spark's own holds the model on the driver, so it trains models of ``MOST_NUMBERS`` at most; a greater one is a table (``skip_gram``).
    Spark trains in one task by default; here a task has about ``WALKS_PER_TASK`` walks. Each task sends all vectors it trained once an
    epoch, so there are ``MOST_TASKS`` at most.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import array_to_vector

    words = materialize(walks.select(F.transform("walk", lambda x: x.cast("string")).alias("walk")), "walks")
    counts = materialize(vocabulary_counts(words, min_count).where("node IS NOT NULL"), "vocabulary")
    if counts.count() * size > MOST_NUMBERS:
        from lodeweave.operators.skip_gram import skip_gram_embedding

        found = skip_gram_embedding(words, counts, size, window, epochs, rate, seed).select("node", array_to_vector("vector").alias("vector"))
        discard(words, counts)
        return found
    tasks = min(MOST_TASKS, max(1, words.count() // WALKS_PER_TASK))
    model = Word2Vec(numPartitions=tasks, vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, stepSize=rate, seed=seed, inputCol="walk", outputCol="v").fit(words)
    discard(words, counts)
    return model.getVectors().select(F.col("word").alias("node"), "vector")


def neighbour_confidence(distance: Column) -> Column:
    return 1 / F.abs(10 * distance + 1)


def principal_components(vectors: DataFrame, k: int = 3) -> DataFrame:
    """``vec_id, c1 ... ck`` by Spark's PCA on centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(rows).transform(rows)
    out = PCA(k=k, inputCol="x", outputCol="p").fit(centred).transform(centred).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", *[F.get("p", F.lit(i)).alias(f"c{i + 1}") for i in range(k)])


def density(points: DataFrame, columns: list[str], block_rows: int = 1 << 15) -> DataFrame:
    """``vec_id, density``: Gaussian kernel density (Scott's factor times the full covariance) at each point, over all points.

    Points are dealt into blocks of about ``block_rows``; each pair of blocks meets in a task, and a point's sums meet by its number. The
    time is the square of the points, as the sum is exact.
    """
    own = materialize(points.select("vec_id", *columns).withColumn("row", F.monotonically_increasing_id()), "points")
    pairs = [(a, b) for a in columns for b in columns]
    n, *covariance = own.agg(F.count(F.lit(1)), *[F.covar_samp(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    covariance = np.array([c or 0.0 for c in covariance]).reshape(len(columns), -1) * max(n, 1) ** (-2 / (len(columns) + 4))
    variance, axes = np.linalg.eigh(covariance)
    scale = np.sqrt(np.maximum(variance, 1e-24))
    norm = max(n, 1) * np.prod(scale) * (2 * np.pi) ** (len(columns) / 2)
    blocks = max(1, -(-n // block_rows))
    block, every = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, centre = (np.column_stack([t[c].to_numpy() for c in names]).reshape(t.num_rows, -1) @ axes / scale for t, names in ((left, columns), (right, centres)))
        out = np.zeros(len(x))
        for a in range(0, len(x), 256):
            for b in range(0, len(centre), 4096):
                apart = sum((x[a : a + 256, i, None] - centre[None, b : b + 4096, i]) ** 2 for i in range(len(columns)))
                out[a : a + 256] += np.exp(-0.5 * apart).sum(1)
        return pa.table([left["row"], left["vec_id"].cast(pa.int64()), pa.array(out / norm)], names=["row", "vec_id", "density"])

    centres = [f"centre_{i}" for i in range(len(columns))]
    left = own.select("row", "vec_id", *columns, block.alias("own_block"), every.alias("other_block"))
    right = own.select(*[F.col(c).alias(n) for c, n in zip(columns, centres, strict=True)], block.alias("centre_block"), every.alias("point_block"))
    found = left.groupBy("own_block", "other_block").cogroup(right.groupBy("point_block", "centre_block")).applyInArrow(run, "row long, vec_id long, density double")
    return found.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.sum("density").alias("density")).drop("row")


def vocabulary_counts(walks: DataFrame, least: int = 5) -> DataFrame:
    """``node, n`` of nodes that occur at least so often in the walks."""
    return walks.select(F.explode("walk").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
