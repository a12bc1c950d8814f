"""Joins of the ledger heuristics, each as equi-joins or windows that Spark can shuffle by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_sequence(left: DataFrame, right: DataFrame, by: list[str], on: str, right_tie: list[str]) -> DataFrame:
    """Both sides of an as-of join as one table: ``by``, their place (``on_``, ``side_``, ``tie_``) and their other columns as ``left_`` or ``right_``. Null keys are left out.

    ``tie_`` holds the columns that order right rows, which are not repeated in ``right_``. Left rows need no order among themselves, as each is compared with right ones only.
    """
    own = [c for c in left.columns if c not in by]
    others = [c for c in right.columns if c not in by and c not in right_tie]
    b = right.select(*by, F.col(on).alias("on_"), F.lit(0).alias("side_"), F.struct(*right_tie).alias("tie_"), F.lit(None).cast(left.select(F.struct(*own).alias("s")).schema["s"].dataType).alias("left_"), F.struct(*others).alias("right_"))
    none = {c: F.lit(None).cast(b.schema[c].dataType).alias(c) for c in ("tie_", "right_")}
    a = left.select(*by, F.col(on).alias("on_"), F.lit(1).alias("side_"), none["tie_"], F.struct(*own).alias("left_"), none["right_"])
    rows = a.unionByName(b)
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def as_of_last(rows: DataFrame, by: list[str], on: str, tolerance: int) -> DataFrame:
    """The as-of join of an ``as_of_sequence``: a window over each key, which a table bucketed and sorted by it gives without a shuffle."""
    own, others, ties = (list(rows.schema[c].dataType.names) for c in ("left_", "right_", "tie_"))
    order = Window.partitionBy(*by).orderBy("on_", "side_", "tie_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(order) for c in ("right_", "tie_")}).where("side_ = 1 AND last_right_ IS NOT NULL")
    near = last.where(F.col(f"left_.{on}") - F.col(f"last_right_.{on}") <= tolerance)
    found = [F.col(f"last_{s}.{c}").alias(f"r_{c}") for s, names in (("right_", others), ("tie_", ties)) for c in names]
    return near.select(*by, *[F.col(f"left_.{c}").alias(c) for c in own], *found)


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], on: str, tolerance: int, right_tie: list[str]) -> DataFrame:
    """For each row of ``left`` the last row of ``right`` with equal ``by`` and ``on`` at most ``tolerance`` before; others go.

    Both sides share one shuffle by key: they are put into one sequence, where a window carries the last right row on.
    Equal ``on``: right rows come first, and of several the last by ``right_tie`` counts. Result: the columns of
    ``left`` and those of ``right`` with the prefix ``r_``. Null keys never match.
    """
    return as_of_last(as_of_sequence(left, right, by, on, right_tie), by, on, tolerance)


def before_join(later: DataFrame, earlier: DataFrame, keys: list[tuple[str, str]], ts: str = "block_timestamp") -> Column:
    """Join condition: equal keys, and ``earlier`` strictly before ``later``."""
    condition = earlier[ts] < later[ts]
    for a, b in keys:
        condition = condition & (later[a] == earlier[b])
    return condition


def unique_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` occurs once, counted by key before the join so that a common key costs one row for each task."""
    once = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(*by)
    return df.join(once, by, "left_semi")


def window_counts(df: DataFrame, key: str, ts_micros: str, category: str, categories: list, days: int, with_self: bool) -> DataFrame:
    """``df`` with ``portfolio``: counts by category over the rows of ``key`` in the trailing ``days``, as a sorted array.

    Both ends of the window are inclusive and rows of equal time count; without ``with_self`` the row itself doesn't.
    """
    frame = Window.partitionBy(key).orderBy(ts_micros).rangeBetween(-days * 86_400_000_000, 0)
    entries = []
    for c in categories:
        hit = F.when(F.col(category) == c, 1).otherwise(0)
        n = F.sum(hit).over(frame) - (0 if with_self else hit)
        entries.append(F.when(n > 0, F.struct(F.lit(c).cast("int").alias("category"), n.cast("long").alias("n"))))
    return df.withColumn("portfolio", F.array_compact(F.array(*entries)))


def portfolio_size(portfolio: Column) -> Column:
    return F.aggregate(portfolio, F.lit(0).cast("long"), lambda total, x: total + x["n"])


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs of different values as ``x, y`` with x < y."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


def typed_pairs(pairs: DataFrame, first: DataFrame, second: DataFrame, strict: bool = False) -> DataFrame:
    """Orient unordered pairs ``x, y`` as ``a`` (in ``first.address``) and ``b`` (in ``second.address``), in both ways where both fit.

    ``strict``: a pair that fits in no way raises; otherwise it goes.
    """
    both = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(pairs.select(F.col("y").alias("a"), F.col("x").alias("b")))
    first, second = first.select(F.col("address").alias("a")).distinct(), second.select(F.col("address").alias("b")).distinct()
    typed = both.join(first, "a", "left_semi").join(second, "b", "left_semi").select("a", "b")
    if strict:
        fit = typed.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        stray = pairs.join(fit, ["x", "y"], "left_anti").select(F.raise_error(F.concat_ws(" ", F.lit("no such pair type:"), "x", "y")).cast("long").alias("a"))
        typed = typed.unionByName(stray.select(F.col("a").cast(typed.schema["a"].dataType).alias("a"), F.col("a").cast(typed.schema["b"].dataType).alias("b")))
    return typed


def either_direction(df: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows from one set of addresses to the other, in either direction, each row once."""
    first, second = first.select("address").distinct(), second.select("address").distinct()

    def way(a: DataFrame, b: DataFrame) -> DataFrame:
        return df.join(a.withColumnRenamed("address", "from_address"), "from_address", "left_semi").join(b.withColumnRenamed("address", "to_address"), "to_address", "left_semi")

    return way(first, second).unionByName(way(second, first)).distinct()


def in_list(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Rows whose ``key`` is listed, in all their columns, each once however often the list has it."""
    return df.join(listed.select(F.col(key)).distinct(), key, "left_semi").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a declared order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def merge_by_precedence(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources; an earlier source wins a key, within a source the first row by all columns."""
    ranked = None
    for i, source in enumerate(sources):
        own = source.withColumn("__rank", F.lit(i))
        ranked = own if ranked is None else ranked.unionByName(own)
    columns = [c for c in ranked.columns if c not in (key, "__rank")]
    return first_per_key(ranked, [key], F.col("__rank"), *[F.col(c).asc_nulls_last() for c in columns]).drop("__rank")


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """``old`` with ``updated`` columns taken from ``new`` where the key is in both, and the new keys added."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    out = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    for c in old.columns:
        if c == key:
            continue
        fresh = F.col(f"n.{key}").isNotNull() if c in updated else F.col(f"o.{key}").isNull()
        out.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, one for each key."""
    fresh = new.join(old.select(key), key, "left_anti")
    return old.unionByName(first_per_key(fresh, [key], *[F.col(c) for c in fresh.columns if c != key]).select(*old.columns))
