"""Nearest vectors: block joins of queries and vectors, and an inverted-file index kept as tables.

Distances are squared Euclidean ones, equal distances are ordered by id. Queries are rows like the vectors; neither side is
ever collected. The index divides the vectors by their nearest of ``cells`` centroids, which are fitted on a bounded sample; a
search looks into the cells nearest to a query, or, exactly, into every cell that can still hold one of its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators.materialize import discard, materialize

#: Vectors, and queries, of one block of a join.
BLOCK_ROWS = 8192
#: Sampled vectors for each cell that the centroids are fitted on.
SAMPLE_PER_CELL = 256
#: The centroids go to every task, so they have a bound.
MOST_CENTROID_BYTES = 64 << 20
_FOUND = "query_id long, vec_id long, distance double"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of equal length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and distances of the ``k`` nearest of all ``vectors`` for each query.

    A matrix product gives rough distances; what may be among the nearest within rounding is then measured exactly.
    """
    out_query, out_id, out_distance = [], [], []
    lengths = (vectors**2).sum(1)
    for at in range(0, len(queries) if len(ids) else 0, 256):
        part = queries[at : at + 256]
        rough = (part**2).sum(1)[:, None] - 2 * part @ vectors.T + lengths[None, :]
        nth = min(k, len(ids)) - 1
        limit = np.partition(rough, nth, axis=1)[:, nth] + 1e-9 * ((part**2).sum(1) + lengths.max() + 1)
        for query, own, far, line in zip(query_ids[at : at + 256], part, limit, rough, strict=True):
            near = np.flatnonzero(line <= far)
            exact = ((own - vectors[near]) ** 2).sum(1)
            best = np.lexsort((ids[near], exact))[:k]
            out_query.append(np.full(len(best), query))
            out_id.append(ids[near[best]])
            out_distance.append(exact[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(out_query, np.int64), join(out_id, np.int64), join(out_distance, np.float64)


def _in_blocks(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``query_id, vec_id, distance``: the ``k`` best of each block for each of its queries; both sides carry the ``keys`` of their blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = best_of(left["query_id"].to_numpy(), matrix(left["query"]), right["vec_id"].to_numpy(), matrix(right["embedding"]), k) if left.num_rows and right.num_rows else (np.zeros(0),) * 3
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "distance"])

    left = queries.select(*keys, "query_id", "query").groupBy(*keys)
    return left.cogroup(vectors.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked(queries: DataFrame) -> DataFrame:
    """``query_id, query``, an id once, without rows that have no vector."""
    rows = queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
    return rows.groupBy("query_id").agg(F.min("query").alias("query"))


def _held(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def nearest(queries: DataFrame, base: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, vec_id, distance, rank``: the ``k`` nearest of all of ``base`` for each query (both ``vec_id, embedding``), by block pairs.

    Both sides are dealt into blocks of about ``block_rows`` by a hash of the id, and each pair of blocks meets in a task of
    its own. Rows without id or vector are left out.
    """
    asked, held = _asked(queries), _held(base)
    parts, query_parts = (max(1, -(-rows.count() // block_rows)) for rows in (held, asked))
    left = asked.select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("b"))
    right = held.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))).alias("q"))
    return _best(_in_blocks(left, right, ["b", "q"], k), k)


@dataclass(frozen=True)
class VectorIndex:
    """``cells``: ``cell, centroid, radius, n, parts``, one row for each; ``lists``: ``cell, part, vec_id, embedding``, in folders by cell."""

    cells: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    radii: np.ndarray


def _fit(vectors: DataFrame, cells: int, sample: int, n: int, seed: int, rounds: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chance = min(1.0, sample / max(n, 1))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(chance * (1 << 30))) if chance < 1 else vectors
    drawn = materialize(drawn.select(array_to_vector("embedding").alias("features")), "sample")
    centres = KMeans(k=cells, maxIter=rounds, seed=seed, initSteps=2).fit(drawn).clusterCenters()
    discard(drawn)
    return np.array(centres)


def _placed(rows: DataFrame, vector: str, centroids: np.ndarray, most: int) -> DataFrame:
    """``rows`` for each of its ``most`` nearest cells, with ``cell`` and ``apart``, the distance to its centroid."""
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)
    most = min(most, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shipped.value
        lengths = (centres**2).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(vector))
                rough = lengths[None, :] - 2 * x @ centres.T
                cell = np.argpartition(rough, most - 1, axis=1)[:, :most] if most < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
                row = np.repeat(np.arange(len(x)), most)
                apart = np.sqrt(((x[row] - centres[cell.ravel()]) ** 2).sum(1))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.ravel(), pa.int32()), pa.array(apart)], names=[*part.schema.names, "cell", "apart"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, cell int, apart double")


def build_index(vectors: DataFrame, path: str, cells: int | None = None, list_rows: int = BLOCK_ROWS, sample_per_cell: int = SAMPLE_PER_CELL, seed: int = 42, rounds: int = 10) -> VectorIndex:
    """Fit the cells (four times the square root of the number of vectors, unless given) and write all vectors of ``vec_id, embedding`` to ``path``.

    The centroids are fitted on about ``sample_per_cell`` vectors for each cell, drawn by a hash of the id. A cell of more
    than ``list_rows`` vectors is kept in several parts, so that a common vector is no hot key. Rows without id or vector
    are left out; no vectors raise.
    """
    held = _held(vectors)
    n, width = held.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError("no vectors to index")
    cells = cells or max(1, int(4 * n**0.5))
    if cells * width * 8 > MOST_CENTROID_BYTES:
        raise ValueError(f"{cells} centroids of {width} entries are more than {MOST_CENTROID_BYTES} bytes; ask for fewer cells")
    centroids = _fit(held, cells, cells * sample_per_cell, n, seed, rounds)
    placed = materialize(_placed(held, "embedding", centroids, 1), "placed")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).withColumn("parts", F.ceil(F.col("n") / list_rows).cast("int"))
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "found int, centroid array<double>")
    sizes = sizes.withColumnRenamed("cell", "found").coalesce(1)  # a row for each cell; cells without vectors go, the others are numbered anew
    known = sizes.join(centres, "found").withColumn("cell", F.row_number().over(Window.orderBy("found")) - 1)
    known.select("cell", "found", "centroid", "radius", "n", "parts").write.mode("overwrite").parquet(f"{path}/cells")
    parts = spark.read.parquet(f"{path}/cells").select("cell", "found", "parts")
    lists = placed.withColumnRenamed("cell", "found").join(F.broadcast(parts), "found")
    lists = lists.select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "embedding")
    lists.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    discard(placed)
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build_index`` wrote."""
    cells = spark.read.parquet(f"{path}/cells").select("cell", "centroid", "radius", "n", "parts")
    known = sorted(cells.select("cell", "centroid", "radius").collect())  # a row for each cell, bounded when it was built
    lists = spark.read.schema("part int, vec_id long, embedding array<double>, cell int").parquet(f"{path}/lists")
    return VectorIndex(cells, lists, np.array([r.centroid for r in known]), np.array([r.radius for r in known]))


def _look_up(index: VectorIndex, probes: DataFrame, k: int, list_queries: int) -> DataFrame:
    """The ``k`` best in each probed list, for ``query_id, query, cell``.

    Only folders of probed cells are read. Queries meet every part of a cell, and the queries of a popular cell are dealt
    into several blocks, to which its lists are copied.
    """
    probes = materialize(probes, "probes")
    asked = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / list_queries).cast("int").alias("query_parts"))
    asked = materialize(asked.join(index.cells.select("cell", "parts"), "cell"), "asked")  # a row for each cell at most
    left = probes.join(F.broadcast(asked), "cell").select("cell", "query_id", "query", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("query_parts")).cast("int").alias("q"))
    lists, wanted = index.lists, [r.cell for r in asked.select("cell").collect()]
    if 2 * len(wanted) < len(index.centroids):
        lists = lists.where(F.col("cell").isin(wanted))
    right = lists.join(F.broadcast(asked.drop("parts")), "cell").select("cell", "part", "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("q"))
    return _in_blocks(left, right, ["cell", "part", "q"], k)


def search(index: VectorIndex, queries: DataFrame, k: int = 10, nprobe: int = 8, list_queries: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, vec_id, distance, rank``: the ``k`` nearest of the vectors in the ``nprobe`` cells nearest to each query of ``vec_id, embedding``."""
    probes = _placed(_asked(queries), "query", index.centroids, nprobe).select("query_id", "query", "cell")
    return _best(_look_up(index, probes, k, list_queries), k)


def search_exactly(index: VectorIndex, queries: DataFrame, k: int = 10, nprobe: int = 4, list_queries: int = BLOCK_ROWS) -> DataFrame:
    """The same over all vectors: what the first ``nprobe`` cells give bounds the distance, and every other cell whose ball reaches within it is searched too."""
    asked = materialize(_asked(queries), "queries")
    probes = _placed(asked, "query", index.centroids, nprobe).select("query_id", "query", "cell")
    first = materialize(_best(_look_up(index, probes, k, list_queries), k), "first")
    far = first.where(F.col("rank") == k).select("query_id", F.col("distance").alias("far"))
    bounded = asked.join(far, "query_id", "left").select("query_id", "query", F.coalesce("far", F.lit(float("inf"))).alias("far"))
    shipped = asked.sparkSession.sparkContext.broadcast((index.centroids, index.radii))
    probed = min(nprobe, len(index.centroids))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = shipped.value
        lengths = (centres**2).sum(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, limit = matrix(part.column("query")), part.column("far").to_numpy()
                rough = lengths[None, :] - 2 * x @ centres.T
                apart = np.sqrt(np.maximum(rough + (x**2).sum(1)[:, None], 0))
                reach = np.maximum(apart - radii[None, :] * (1 + 1e-9), 0) ** 2
                open_ = reach <= (limit * (1 + 1e-9) + 1e-9 * ((x**2).sum(1) + lengths.max() + 1))[:, None]
                if probed < len(centres):  # those that the first search took
                    np.put_along_axis(open_, np.argpartition(rough, probed - 1, axis=1)[:, :probed], False, axis=1)
                else:
                    open_[:] = False
                row, cell = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([*part.select(["query_id", "query"]).take(pa.array(row)).columns, pa.array(cell, pa.int32())], names=["query_id", "query", "cell"])

    more = _look_up(index, bounded.mapInArrow(rest, "query_id long, query array<double>, cell int"), k, list_queries)
    return _best(first.select("query_id", "vec_id", "distance").unionByName(more), k)
