"""Merges into stored tables, and components that are kept up to date."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators.components import connected_components
from lodeweave.sources.stored import StoredTable
from lodeweave.streaming import clusters

ADDRESS = "address string, conf double, user_cluster string"


def files(table, number=None):
    return set(table.read(number).inputFiles())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    empty = spark.createDataFrame([], ADDRESS)
    return StoredTable.create(spark, f"file://{tmp_path}/t", empty.schema, "address", buckets=8)


def test_merge_writes_only_touched_buckets(spark, table):
    assert table.read().count() == 0
    table.merge(spark.createDataFrame([(f"a{i}", float(i), "old") for i in range(40)], ADDRESS))
    before = files(table)
    new = spark.createDataFrame([("a3", 99.0, "new"), ("b1", 1.0, "new"), ("b1", 0.5, "new"), (None, 1.0, "x")], ADDRESS)
    assert table.merge(new, updated=["user_cluster"], batch="7") == 2
    after = files(table)
    touched = {r[0] for r in new.where("address IS NOT NULL").select(F.pmod(F.xxhash64("address"), F.lit(8))).distinct().collect()}
    kept = {f for f in before if int(f.split("__bucket=")[1].split("/")[0]) not in touched}
    assert len(kept) > 0 and kept <= after and not (before - kept) & after
    got = {r.address: (r.conf, r.user_cluster) for r in table.read().collect()}
    assert len(got) == 41 and got["a3"] == (3.0, "new") and got["b1"] == (0.5, "new") and got["a4"] == (4.0, "old")
    assert table.merge(new, batch="7") == 2 and files(table) == after
    assert rows(table.read(1)) == sorted([(f"a{i}", float(i), "old") for i in range(40)], key=str)
    assert [r.conf for r in table.look_up(spark.createDataFrame([("a9",), ("zz",)], "address string")).collect()] == [9.0]


def test_delete_and_insert(spark, table):
    table.merge(spark.createDataFrame([(f"a{i}", float(i), None) for i in range(20)], ADDRESS))
    assert table.delete(F.col("conf") >= 15) == 2 and table.delete(F.col("conf") >= 15) == 2
    assert table.read().count() == 15 and table.delete(F.col("user_cluster") == "x") == 2
    table.insert(table.read().where("conf < 5").select(F.concat(F.lit("c"), "address").alias("address"), "conf", "user_cluster"))
    assert table.read().count() == 20
    with pytest.raises(ValueError, match="not unique"):
        table.insert(spark.createDataFrame([("a1", 0.0, None)], ADDRESS))
    with pytest.raises(FileNotFoundError):
        table.version(40)


def test_a_failed_merge_leaves_the_old_version(spark, table):
    table.merge(spark.createDataFrame([("a", 1.0, "x")], ADDRESS))
    before, was = files(table), rows(table.read())
    bad = spark.createDataFrame([("a", 2.0, "y"), ("q", 3.0, "y")], ADDRESS).withColumn("conf", F.when(F.col("address") == "q", F.raise_error(F.lit("broken load")).cast("double")).otherwise(F.col("conf")))
    with pytest.raises(Exception, match="broken load"):
        table.merge(bad)
    assert table.version().number == 1 and files(table) == before and rows(table.read()) == was
    # two loads from one version: the second one is refused
    version = table.version()
    table.merge(spark.createDataFrame([("b", 1.0, "x")], ADDRESS))
    with pytest.raises(RuntimeError, match="another load"):
        table._write(table.read(version.number), version, [], None)


def test_components_after_each_load(spark, tmp_path):
    loads = [
        [("a", "b"), ("c", "d"), ("e", "f"), (None, "a"), ("g", "g")],
        [("b", "c"), ("x", "y"), ("a", "b")],
        [("e", "x"), ("n", "o"), ("f", "d")],  # an old cluster across two others, and a new one
        [("p", "n"), ("n", "p")],
        [],
        [("0", "o"), ("z", "y"), ("q", "r")],
    ]
    schema = "src string, dst string"
    table = clusters.cluster_table(spark, f"file://{tmp_path}/c", spark.createDataFrame([], schema).schema["src"].dataType, buckets=16)
    seen = []
    for k, load in enumerate(loads):
        seen += load
        df = spark.createDataFrame(load, schema)
        before = files(table)
        number = clusters.add_edges(table, df, batch=str(k))
        assert rows(table.read()) == rows(connected_components(spark.createDataFrame(seen, schema)))
        kept = files(table)
        assert clusters.add_edges(table, df, batch=str(k)) == number and files(table) == kept
        if k == 3:  # clusters that no edge touches keep their files
            assert before & kept
    source = str(tmp_path / "loads")
    for load in loads:
        spark.createDataFrame(load, schema).coalesce(1).write.mode("append").parquet(source)
    other = clusters.cluster_table(spark, f"file://{tmp_path}/d", spark.createDataFrame([], schema).schema["src"].dataType)
    state = f"file://{tmp_path}/state"
    clusters.stream_components(spark, source, spark.createDataFrame([], schema).schema, other, state)
    assert rows(other.read()) == rows(connected_components(spark.createDataFrame(seen, schema)))
    number = other.version().number
    clusters.stream_components(spark, source, spark.createDataFrame([], schema).schema, other, state)
    assert other.version().number == number
