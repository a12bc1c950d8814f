"""Connected components kept up to date while edges arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeweave.operators.components import connected_components
from lodeweave.operators.materialize import discard, materialize, scratch_path
from lodeweave.sources.stored import StoredTable


def cluster_table(spark: SparkSession, path: str, node: T.DataType, buckets: int = 64) -> StoredTable:
    """An empty table of ``node, component``, dealt by component, so that a cluster's rows are together."""
    schema = T.StructType([T.StructField("node", node), T.StructField("component", node)])
    return StoredTable.create(spark, path, schema, "node", buckets, bucket_by="component")


def add_edges(table: StoredTable, edges: DataFrame, batch: str | None = None) -> int:
    """Merge edges (``src, dst``) into the components of ``table``; the version that it is then.

    Each end is contracted to its component, and only the graph of the components that the edges touch is searched; the
    clusters that change are written anew, all others keep their files. A component's name is its smallest node, as in
    ``connected_components``. A ``batch`` that was added before changes nothing; null ends and loops are left out.
    """
    before = table.version()
    if batch is not None and batch in before.batches:
        return before.number
    edges = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = table.read(before.number)
    own = materialize(ends.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("old"), F.col("component").isNull().alias("fresh")), "ends")
    a, b = own.select(F.col("node").alias("src"), F.col("old").alias("a")), own.select(F.col("node").alias("dst"), F.col("old").alias("b"))
    links = edges.join(a, "src").join(b, "dst").where("a <> b").select("a", "b")
    joined = connected_components(links, "a", "b").select(F.col("node").alias("old"), "component")
    # every end's new component; a component that the edges only touch inside keeps its rows
    changed = materialize(joined.where("old <> component"), "changed")
    members = known.join(changed.withColumnRenamed("component", "to"), known["component"] == F.col("old")).select("node", F.col("to").alias("component"))
    fresh = own.where("fresh").join(joined, "old", "left").select("node", F.coalesce("component", "old").alias("component"))
    rows = materialize(members.unionByName(fresh), "rows")
    number = table.replace(changed.select(F.col("old").alias("component")), rows, batch) if batch is not None or not rows.isEmpty() else before.number
    discard(edges, own, joined, changed, rows)
    return number


def stream_components(spark: SparkSession, source: str, schema: T.StructType, table: StoredTable, state: str | None = None) -> None:
    """Add all files of ``source`` (``src, dst``) to ``table``, one in a micro-batch; a micro-batch that runs again after a failure changes nothing."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = rows.writeStream.foreachBatch(lambda df, number: add_edges(table, df, f"stream-{number}")).option("checkpointLocation", state or scratch_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
