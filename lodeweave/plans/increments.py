"""Queries over increments and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeweave.operators import heuristics as H
from lodeweave.operators import joins as J
from lodeweave.operators.materialize import materialize, scratch_path
from lodeweave.plans import reuse as U
from lodeweave.sources import fixtures as X
from lodeweave.sources.files import save_bucketed
from lodeweave.sources.fixtures import sql
from lodeweave.sources.stored import StoredTable
from lodeweave.streaming import clusters as C
from lodeweave.streaming import reuse as S


def stream_dar_equals_batch(spark, d):
    """The stream's matches over transfers that arrive in six loads, the fourth one place too late; the oracle is the batch form."""
    transfers, known = X.transfers(spark, d), X.known(spark, d)
    loads, span, last = S.in_order_of_arrival(transfers, 6, late=3)
    path, out, state = (scratch_path(spark, name) for name in ("loads", "matches", "state"))
    run = lambda: S.run_matches(spark, path, transfers.schema, H.split_known(known)[0], known, X.miners(spark, d), U.T_MAX, U.A_MAX, 2 * span, out, state)
    for load in loads:
        load.write.mode("append").parquet(path)
        run()
    S.close_loads(spark, path, transfers.schema, last + 3 * span + U.T_MAX)
    run()
    return S.matches_of(spark, out)


def above_high_water_mark(spark, d):
    rows = X.transfers(spark, d).select("transaction", "block")
    return S.above_mark(rows, rows.where("block <= 500"), "block")


def daily_windows(spark, d):
    counts = S.windowed_counts(X.events(spark, d).withColumn("at", F.col("ts")), "at", "event_type")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def dar_matches_bucketed(spark, d):
    """The same matches from a catalog table that is bucketed and sorted by deposit and amount."""
    known = X.known(spark, d)
    rows = H.reuse_sequence(X.transfers(spark, d), H.split_known(known)[0], known, X.miners(spark, d))
    path = scratch_path(spark, "sequence")
    table = save_bucketed(rows, f"reuse_sequence_{path.split('lodeweave-')[1][:32]}", H.REUSE_KEYS, ["on_", "side_", "tie_"], 8, path)
    return H.reuse_matches_of(table, U.A_MAX, U.T_MAX).select("user_address", "deposit", "exchange", "forward_tx", "receipt_tx", "t_diff")


def upsert_stored(spark, d):
    """``upsert_address`` as two loads that are merged into a stored table, the second one twice."""
    old, new = (materialize(rows, "load") for rows in U._loads(spark, d))
    table = StoredTable.create(spark, scratch_path(spark, "addresses"), old.schema, "address", 16)
    table.merge(old, batch="1")
    for _ in range(2):
        table.merge(new, updated=["user_cluster"], batch="2")
    return table.read()


def stored_changes(spark, d):
    """Deposits by address: the small ones deleted, then the withdrawals of addresses that are left out inserted by a query."""
    counts = lambda rows, a: rows.groupBy(F.col(a).alias("address")).agg(F.count(F.lit(1)).alias("n"))
    own = counts(X.deposits(spark, d), "from_address")
    table = StoredTable.create(spark, scratch_path(spark, "counts"), own.schema, "address", 16)
    table.insert(own)
    table.delete(F.col("n") < 13)
    table.insert(counts(X.withdrawals(spark, d), "recipient_address").join(table.read(), "address", "left_anti"))
    return table.read()


def address_lookup(spark, d):
    """The metadata of those who claim rewards, from the buckets of a stored table that hold them."""
    meta = J.first_per_key(U.dar_metadata(spark, d), ["address"], "entity")
    table = StoredTable.create(spark, scratch_path(spark, "metadata"), meta.schema, "address", 64)
    table.merge(meta)
    return table.look_up(X.claims(spark, d).select(F.concat(F.lit("p"), F.col("recipient").cast("string")).alias("address")))


def components_stream(spark, d):
    """Users and their deposit addresses in four loads, merged into the components of the loads before."""
    edges = U._edges(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    path = scratch_path(spark, "edges")
    edges = materialize(edges, "all_edges")
    for k in range(4):
        edges.where(F.pmod(F.xxhash64("src"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(path)
    table = C.cluster_table(spark, scratch_path(spark, "clusters"), edges.schema["src"].dataType, 16)
    C.stream_components(spark, path, edges.schema, table)
    return table.read()


QUERIES = {f.__name__: f for f in (stream_dar_equals_batch, above_high_water_mark, daily_windows, dar_matches_bucketed, upsert_stored, stored_changes, address_lookup, components_stream)}
ORACLE_SQL = {
    "stream_dar_equals_batch": U.ORACLE_SQL["dar_matches"],
    "above_high_water_mark": sql("SELECT transaction, block FROM transfers WHERE block > (SELECT max(block) FROM transfers WHERE block <= 500)", "transfers"),
    "dar_matches_bucketed": U.ORACLE_SQL["dar_matches"],
    "upsert_stored": U.ORACLE_SQL["upsert_address"],
    "stored_changes": sql("SELECT address, n FROM o WHERE n >= 13 UNION ALL SELECT recipient_address, count(*) FROM withdrawals WHERE recipient_address NOT IN (SELECT address FROM o WHERE n >= 13) GROUP BY recipient_address", "deposits", "withdrawals", o="SELECT from_address AS address, count(*) AS n FROM deposits GROUP BY from_address"),
    "address_lookup": U._sql("SELECT address, min(entity) AS entity, arg_min(round(conf, 6), entity) AS conf FROM meta WHERE address IN (SELECT 'p' || user_id FROM events WHERE event_type = 'error') GROUP BY address"),
    "components_stream": U.ORACLE_SQL["components_dar"],
    "daily_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
