"""Queries over the transaction graph and over vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodeweave.operators import graphs as G
from lodeweave.operators import vector_index as V
from lodeweave.operators.clusters import evaluate_clusters
from lodeweave.operators.components import connected_components
from lodeweave.operators.embedding import negative_sampling_embedding
from lodeweave.operators.materialize import materialize, scratch_path
from lodeweave.plans import reuse as U
from lodeweave.sources import fixtures as X
from lodeweave.sources.fixtures import sql


def edge_weights(spark, d):
    return G.edge_weights(X.edges(spark, d))


def node_degrees(spark, d):
    return G.degrees(X.edges(spark, d))


def node_encode(spark, d):
    return G.encode_nodes(X.edges(spark, d))


def encoded_edges(spark, d):
    ids = node_encode(spark, d)
    found = edge_weights(spark, d)
    found = found.join(ids.withColumnRenamed("node", "src").withColumnRenamed("id", "src_id"), "src").join(ids.withColumnRenamed("node", "dst").withColumnRenamed("id", "dst_id"), "dst")
    return found.select("src_id", "dst_id", "weight")


def induced_subgraph(spark, d):
    nodes = G.degrees(X.edges(spark, d)).where("degree >= 35")
    return G.induced_subgraph(X.edges(spark, d).distinct(), nodes)


def adjacency_lists(spark, d):
    return G.adjacency(X.edges(spark, d)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


def eulerian_check(spark, d):
    return G.eulerian(X.edges(spark, d))


def component_sizes(spark, d):
    found = connected_components(X.external_txs(spark, d).groupBy("from_address", "to_address").count().where("count >= 4"), "from_address", "to_address")
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def knn_exact(spark, d):
    vectors = X.vectors(spark, d)
    found = V.nearest(vectors.where("vec_id % 100 = 0"), vectors, 10)
    return found.select("query_id", "vec_id", F.round("distance", 5).alias("distance"))


def _index(spark, d) -> V.VectorIndex:
    """An index of all vectors, written to the shared folder and read back."""
    path = scratch_path(spark, "vectors")
    V.build_index(X.vectors(spark, d), path)
    return V.load_index(spark, path)


def knn_index(spark, d):
    """The neighbours that the nearest cells of an inverted-file index hold."""
    found = V.search(_index(spark, d), X.vectors(spark, d).where("vec_id % 100 = 0"), 10, nprobe=24)
    return found.select("query_id", "vec_id", F.round("distance", 5).alias("distance"))


def knn_index_exact(spark, d):
    """The same index searched until no other cell can hold a nearer vector."""
    found = V.search_exactly(_index(spark, d), X.vectors(spark, d).where("vec_id % 100 = 0"), 10)
    return found.select("query_id", "vec_id", F.round("distance", 5).alias("distance"))


def neighbour_confidence(spark, d):
    vectors = X.vectors(spark, d)
    found = V.nearest(vectors.where("vec_id % 100 = 0"), vectors, 10).where("query_id <> vec_id")
    return found.groupBy("query_id").agg(F.round(F.avg(G.neighbour_confidence(F.col("distance"))), 6).alias("conf"), F.count(F.lit(1)).alias("n"))


def diffusion_sequences(spark, d):
    return G.diffusion_walks(X.external_txs(spark, d).select(F.col("from_address").alias("src"), F.col("to_address").alias("dst")))


def walk_vocabulary(spark, d):
    return G.vocabulary_counts(diffusion_sequences(spark, d))


def node_embedding(spark, d):
    return G.node_embedding(diffusion_sequences(spark, d)).select("node", vector_to_array("vector").alias("vector"))


def node_embedding_negative(spark, d):
    """Vectors by continuous bag of words with negative samples, with the settings that walks of this kind are trained with."""
    return negative_sampling_embedding(diffusion_sequences(spark, d))


def embedding_pca(spark, d):
    return G.principal_components(X.vectors(spark, d))


def embedding_density(spark, d):
    return G.density(G.principal_components(X.vectors(spark, d)), ["c1", "c2", "c3"])


def cluster_eval(spark, d):
    vectors = X.vectors(spark, d)
    found = connected_components(V.nearest(vectors, vectors, 4).where("query_id <> vec_id"), "query_id", "vec_id")
    predicted = found.select(F.col("node").alias("member"), F.col("component").alias("cluster"))
    scores = evaluate_clusters(predicted, vectors.select(F.col("vec_id").alias("member"), F.col("label").alias("cluster")))
    return scores.select("cluster", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def cluster_eval_modes(spark, d):
    """The same for clusters of reused deposit addresses (``dar``), of neighbours (``node``) and of both together; vector n is address ``p`` n."""
    vectors = X.vectors(spark, d)
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    node = materialize(V.nearest(vectors, vectors, 4).where("query_id <> vec_id").select(name("query_id").alias("a"), name("vec_id").alias("b")), "node")
    dar = materialize(U._pruned(spark, d).select(F.col("user_address").alias("a"), F.col("deposit").alias("b")), "dar")
    known = vectors.select(name("vec_id").alias("member"), F.col("label").alias("cluster"))
    out = None
    for mode, edges in (("dar", dar), ("node", node), ("both", dar.unionByName(node))):
        predicted = connected_components(edges, "a", "b").select(F.col("node").alias("member"), F.col("component").alias("cluster"))
        scores = evaluate_clusters(predicted, known).select(F.lit(mode).alias("mode"), "cluster", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
        out = scores if out is None else out.unionByName(scores)
    return out


QUERIES = {f.__name__: f for f in (
    edge_weights, node_degrees, node_encode, encoded_edges, induced_subgraph, adjacency_lists, eulerian_check, component_sizes, knn_exact, knn_index, knn_index_exact, neighbour_confidence,
    diffusion_sequences, walk_vocabulary, node_embedding, node_embedding_negative, embedding_pca, embedding_density, cluster_eval, cluster_eval_modes,
)}

_IDS = "SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"
_DEGREES = "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node"
_WEIGHTS = "SELECT src, dst, count(*) AS weight FROM edges GROUP BY ALL"
_DISTANCE = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))"


def _nearest(step: int, k: int) -> str:
    return f"SELECT query_id, vec_id, distance FROM (SELECT a.vec_id AS query_id, b.vec_id, {_DISTANCE} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE}, b.vec_id) AS k FROM embeddings a JOIN embeddings b ON a.vec_id % {step} = 0) WHERE k <= {k}"


def _mode(mode: str) -> str:
    hits = f"SELECT label AS cluster, component AS c, count(*) AS hit, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, component) AS k FROM by_{mode} JOIN embeddings ON 'p' || vec_id = node GROUP BY label, component"
    return (
        f"SELECT '{mode}' AS mode, r.cluster, round(coalesce(hit / size, 0), 6) AS precision, round(coalesce(hit, 0) / rl, 6) AS recall FROM (SELECT label AS cluster, count(*) AS rl FROM embeddings GROUP BY label HAVING count(*) > 1) r "
        f"LEFT JOIN (SELECT * FROM ({hits}) WHERE k = 1) h ON h.cluster = r.cluster LEFT JOIN (SELECT component AS c, count(*) AS size FROM by_{mode} GROUP BY component) s ON s.c = h.c"
    )


_MODES = {"dar": "SELECT user_address AS a, deposit AS b FROM p2", "node": "SELECT 'p' || query_id AS a, 'p' || vec_id AS b FROM n WHERE query_id <> vec_id"}
_MODES["both"] = " UNION ALL ".join(_MODES.values())
ORACLE_SQL = {
    "cluster_eval_modes": sql(" UNION ALL ".join(map(_mode, _MODES)), "transfers", "known", "miners", **U._VIEWS, n=_nearest(1, 4), **{k: v for mode, edges in _MODES.items() for k, v in U._reach(f"by_{mode}", edges).items()}),
    "edge_weights": sql(_WEIGHTS, "edges"),
    "node_degrees": sql(_DEGREES, "edges"),
    "node_encode": sql(_IDS, "edges"),
    "encoded_edges": sql("SELECT a.id AS src_id, b.id AS dst_id, weight FROM w JOIN ids a ON a.node = src JOIN ids b ON b.node = dst", "edges", w=_WEIGHTS, ids=_IDS),
    "induced_subgraph": sql("SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT node FROM g WHERE degree >= 35) AND dst IN (SELECT node FROM g WHERE degree >= 35)", "edges", g=_DEGREES),
    "adjacency_lists": sql("SELECT node, string_agg(other, ',' ORDER BY other) AS neighbours FROM (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges) GROUP BY node", "edges"),
    "eulerian_check": sql(
        "SELECT (SELECT count(*) FROM g WHERE degree % 2 = 1) AS odd_nodes, (SELECT count(DISTINCT c) FROM comp) AS components, (SELECT count(DISTINCT c) FROM comp) = 1 AND (SELECT count(*) FROM g WHERE degree % 2 = 1) IN (0, 2) AS is_eulerian",
        "edges", g=_DEGREES, e="SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges", seed="SELECT min(a) AS m FROM e",
        r="SELECT m AS node FROM seed UNION SELECT e.b FROM r JOIN e ON e.a = r.node", comp="SELECT node, CASE WHEN node IN (SELECT node FROM r) THEN 'one' ELSE node END AS c FROM g"),
    "component_sizes": sql("SELECT component, count(*) AS size FROM (SELECT a, min(b) AS component FROM reach GROUP BY a) GROUP BY component", "external_txs",
                           p="SELECT from_address AS a, to_address AS b FROM external_txs GROUP BY ALL HAVING count(*) >= 4", e="SELECT a, b FROM p UNION SELECT b, a FROM p", reach="SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b"),
    "knn_exact": sql("SELECT query_id, vec_id, round(distance, 5) AS distance FROM n", n=_nearest(100, 10)),
    "knn_index_exact": sql("SELECT query_id, vec_id, round(distance, 5) AS distance FROM n", n=_nearest(100, 10)),
    "neighbour_confidence": sql("SELECT query_id, round(avg(1 / abs(10 * distance + 1)), 6) AS conf, count(*) AS n FROM n WHERE query_id <> vec_id GROUP BY query_id", n=_nearest(100, 10)),
    "cluster_eval": sql(
        "SELECT r.cluster, round(coalesce(hit / size, 0), 6) AS precision, round(coalesce(hit, 0) / rl, 6) AS recall FROM (SELECT label AS cluster, count(*) AS rl FROM embeddings GROUP BY label HAVING count(*) > 1) r LEFT JOIN (SELECT * FROM h WHERE k = 1) h ON h.cluster = r.cluster LEFT JOIN (SELECT c, count(*) AS size FROM p GROUP BY c) s ON s.c = h.c",
        n=_nearest(1, 4), e="SELECT query_id AS a, vec_id AS b FROM n WHERE query_id <> vec_id UNION SELECT vec_id, query_id FROM n WHERE query_id <> vec_id", reach="SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b",
        p="SELECT a AS member, min(b) AS c FROM reach GROUP BY a", h="SELECT label AS cluster, c, count(*) AS hit, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, c) AS k FROM p JOIN embeddings ON vec_id = member GROUP BY label, c"),
}
