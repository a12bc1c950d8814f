"""Plans over bucketed tables and look-ups by layout."""

from pyspark.sql import functions as F

from lodeweave.operators import heuristics
from lodeweave.plans import profiles, reuse
from lodeweave.sources import files, fixtures
from lodeweave.sources.stored import StoredTable

SF = "/root/testdata/sf0.001"


def test_as_of_window_over_a_bucketed_table_has_no_exchange(spark, tmp_path):
    known = fixtures.known(spark, SF)
    rows = heuristics.reuse_sequence(fixtures.transfers(spark, SF), heuristics.split_known(known)[0], known, fixtures.miners(spark, SF))
    table = files.save_bucketed(rows, "reuse_sequence_test", heuristics.REUSE_KEYS, ["on_", "side_", "tie_"], 4, str(tmp_path / "t"))
    found = heuristics.reuse_matches_of(table, reuse.A_MAX, reuse.T_MAX)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    assert "Exchange" in heuristics.reuse_matches_of(rows, reuse.A_MAX, reuse.T_MAX)._jdf.queryExecution().executedPlan().toString()
    assert found.count() == reuse.dar_matches(spark, SF).count()
    spark.sql("DROP TABLE reuse_sequence_test")


def test_look_up_reads_few_files(spark, tmp_path):
    rows = spark.range(20_000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("address"), "id")
    table = StoredTable.create(spark, f"file://{tmp_path}/t", rows.schema, "address", 64)
    table.merge(rows)
    asked = spark.createDataFrame([("a77",)], "address string")
    found = table.look_up(asked)
    assert [r.id for r in found.collect()] == [77]
    every, read = len(table.read().inputFiles()), table.read(buckets=table._buckets_of(asked, table.version())).inputFiles()
    assert every >= 64 and len(read) * 10 < every


def scanned(df):
    """Rows that the scan of a query without shuffle gives, once it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_look_up_skips_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("address"), "id")
    files.write_for_look_up(rows, str(tmp_path / "t"), "address", partitions=4, rows_per_group=2000)
    one = rows.where("id = 77").first().address
    found = files.look_up(spark, str(tmp_path / "t"), "address", [one])
    assert [r.id for r in found.collect()] == [77] and 0 < scanned(found) < 6_000
    # within the bounds of a group, but not in it: the bloom filter says so
    none = files.look_up(spark, str(tmp_path / "t"), "address", [one[:-1] + ("0" if one[-1] != "0" else "1")])
    assert none.count() == 0 and scanned(none) < 2_500
    assert scanned(spark.read.parquet(str(tmp_path / "t")).where("id >= 0")) == 60_000


def test_forwarding_addresses_have_a_size_that_spark_knows(spark):
    known = fixtures.known(spark, SF)
    rows = heuristics.reuse_sequence(fixtures.transfers(spark, SF), heuristics.split_known(known)[0], known, fixtures.miners(spark, SF))
    # the semi join reads them as a table, so that few of them are broadcast and transfers are not shuffled by receiver
    assert any("/forwarding/" in path for path in rows.inputFiles())
    join = [line for line in rows._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftSemi" in line and "[to_address" in line]
    assert join and all("BroadcastHashJoin" in line for line in join)


def test_transfers_are_not_shuffled_by_few_addresses_above_sparks_threshold(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    try:
        known = fixtures.known(spark, SF)
        rows = heuristics.reuse_sequence(fixtures.transfers(spark, SF), heuristics.split_known(known)[0], known, fixtures.miners(spark, SF))
        plan = rows._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # more than that are joined by key
    assert "broadcast" not in heuristics._few(spark.range(3).toDF("address"), most=2)._jdf.queryExecution().logical().toString().lower()


def test_weekly_windows_neither_writes_all_reveals_nor_shuffles_a_transaction_twice(spark):
    found = profiles.weekly_windows(spark, SF)
    assert found.inputFiles() and not any("/all_reveals/" in path for path in found.inputFiles())
    known = fixtures.known(spark, SF)
    rows = heuristics.reuse_sequence(fixtures.transfers(spark, SF), heuristics.split_known(known)[0], known, fixtures.miners(spark, SF))
    # a receipt's transaction is its place among those of equal block, and a forward needs none
    assert rows.schema["tie_"].dataType.names == ["tx"] and "tx" not in rows.schema["right_"].dataType.names
    assert rows.where("(side_ = 0) <> (tie_ IS NOT NULL)").count() == 0
