"""Scalar expressions of the ledger queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.words import word_long

WEI_PER_ETHER = 1e18

#: Entities and heuristics by number (fixed values of the data model).
ENTITIES = ["eoa", "deposit", "exchange", "dex", "defi", "ico wallet", "mining", "tornado", "unknown"]
HEURISTICS = ["deposit_address_reuse", "address_match", "unique_gas_price", "multi_denomination", "linked_transaction", "torn_mine", "diff2vec"]

DEPOSIT_SELECTOR, WITHDRAW_SELECTOR = "0xb214faa5", "0x21a0adb6"
#: Contracts that pass calls on to a pool, the present one and the one before (fixed values of the data model).
PROXIES = ["0x722122df12d4e14e13ac3b6895a86e84145b6967", "0x905b63fff465b9ffbf41dea908ceb12478ec7601"]


def round_half_even(x: Column, digits: int) -> Column:
    """Decimal rounding of doubles with ties to even, by scaling and ``rint``."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ether(wei: Column) -> Column:
    return wei.cast("double") / WEI_PER_ETHER


def is_address(x: Column) -> Column:
    """42 characters, ``0x`` first, no white space."""
    return F.coalesce((F.length(x) == 42) & x.startswith("0x") & ~x.rlike(r"\s"), F.lit(False))


def confidence_label(conf: Column) -> Column:
    return F.when(conf > 0.98, "high").when(conf > 0.95, "medium").otherwise("low")


def name_of(number: Column, names: list[str]) -> Column:
    """Name by number; an unknown number raises, null stays null."""
    known = F.get(F.array(*map(F.lit, names)), number)
    return F.when(number.isNull(), None).when(known.isNull(), F.raise_error(F.concat(F.lit("no such number: "), number.cast("string")))).otherwise(known)


def number_of(name: Column, names: list[str]) -> Column:
    """Number by name; an unknown name raises, null stays null."""
    at = F.array_position(F.array(*map(F.lit, names)), name).cast("int")
    return F.when(name.isNull(), None).when(at == 0, F.raise_error(F.concat(F.lit("no such name: "), name))).otherwise(at - 1)


def with_pool_flag(rows: DataFrame, pools: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``is_pool``: whether ``column`` is the address of one of the ``pools``; null is none."""
    own = pools.select(F.col("address").alias(column), F.lit(True).alias("is_pool")).distinct()
    return rows.join(own, column, "left").select(*[rows[c] if c != column else F.col(c) for c in rows.columns], F.coalesce("is_pool", F.lit(False)).alias("is_pool"))


def safe_cast(x: Column, kind: str, default) -> Column:
    return F.coalesce(x.try_cast(kind), F.lit(default).cast(kind))


def without_prefix(x: Column, prefix: str) -> Column:
    """The text behind a prefix; a text without it stays as it is."""
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)


def parse_date(x: Column, pattern: str = "MM/dd/yyyy") -> Column:
    """A date in the pattern; null where the text is none."""
    return F.try_to_timestamp(x, F.lit(pattern)).cast("date")


def shown_date(x: Column, pattern: str = "MM/dd/yyyy") -> Column:
    return F.date_format(x, pattern)


def merged_maps(first: Column, *others: Column) -> Column:
    """All keys of several maps, each with the value of the last map that has it; a null map has no keys."""
    none = lambda m: F.coalesce(m, F.create_map().cast("map<string,string>"))
    keys = F.array_distinct(F.concat(*[F.map_keys(none(m)) for m in (first, *others)]))

    def value(key: Column) -> Column:
        out = F.element_at(none(first), key)
        for m in others:
            out = F.when(F.map_contains_key(none(m), key), F.element_at(none(m), key)).otherwise(out)
        return out

    return F.map_from_arrays(keys, F.transform(keys, value))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


# call data: a 10-character selector, then words of 64 hex digits


def selector(call: Column) -> Column:
    return F.substring(call, 1, 10)


def word(call: Column, k: int) -> Column:
    """The k-th word of the arguments; null where the call is too short."""
    found = F.substring(call, 11 + 64 * k, 64)
    return F.when(F.length(found) == 64, found)


def word_address(call: Column, k: int) -> Column:
    """The k-th word as a lower-case address."""
    return F.concat(F.lit("0x"), F.lower(F.substring(word(call, k), 25, 40)))


def word_number(call: Column, k: int) -> Column:
    """The k-th word as a long; one that is greater raises."""
    return word_long(F.lower(word(call, k)))


def word_at(call: Column, offset: Column) -> Column:
    """The word that begins so many bytes into the arguments; null where the call is too short."""
    found = F.substring(call, (F.lit(11) + 2 * offset).cast("int"), F.lit(64))
    return F.when(F.length(found) == 64, found)


def as_address(word: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(word, 25, 40)))


def as_number(word: Column) -> Column:
    """A word as a long; one that is greater raises."""
    return word_long(F.lower(word))
