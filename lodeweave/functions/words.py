"""Exact arithmetic on 256-bit words of call data, given as 64 lower-case hex digits.

Words of equal length compare as text, so ``<`` and ``=`` on the strings are those of the numbers. Sums, quotients and decimal text are
whole numbers of Python over Arrow batches: plain Spark expressions, limb by limb, are never compiled and took a hundred times as long.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_WORD, _DIGITS = re.compile("[0-9a-fA-F]{64}"), re.compile("[0-9a-fA-F]*")
_MOST = 1 << 256


def _number(word: str) -> int:
    """The number of a word; in one that is none, each 32 bits count as the digits that they begin with."""
    if _WORD.fullmatch(word):
        return int(word, 16)
    return int("".join((_DIGITS.match(word[i : i + 8].strip(" "))[0] or "0").rjust(8, "0") for i in range(0, 64, 8)), 16)


@F.arrow_udf(StringType())
def _decimal(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else str(_number(w)) for w in words.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _sum(first: pa.Array, second: pa.Array) -> pa.Array:
    sums = (None if a is None or b is None else _number(a) + _number(b) for a, b in zip(first.to_pylist(), second.to_pylist(), strict=True))
    return pa.array([None if n is None or n >= _MOST else f"{n:064x}" for n in sums], pa.string())


@F.arrow_udf(StructType([StructField("quotient", StringType()), StructField("remainder", LongType())]))
def _divided(words: pa.Array, by: pa.Array) -> pa.Array:
    found = [None if w is None or n is None else divmod(_number(w), n) for w, n in zip(words.to_pylist(), by.to_pylist(), strict=True)]
    kind = pa.struct([("quotient", pa.string()), ("remainder", pa.int64())])
    return pa.array([None if x is None else {"quotient": f"{x[0]:064x}", "remainder": x[1]} for x in found], kind)


def word_decimal(word: Column) -> Column:
    """The number as decimal text, whatever its size."""
    return _decimal(word)


def word_add(a: Column, b: Column) -> Column:
    """The sum of two words; one of more than 256 bits raises."""
    found = _sum(a, b)
    return F.when(found.isNull() & a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("the sum has more than 256 bits"))).otherwise(found)


def word_divide(word: Column, divisor: Column) -> Column:
    """``quotient`` (a word) and ``remainder`` (a long) of a division by a positive number below 2**31; null where the divisor is none."""
    return _divided(word, F.when((divisor > 0) & (divisor < 1 << 31), divisor.cast("long")))


def fits_long(word: Column) -> Column:
    return word <= F.lit("0" * 48 + "7" + "f" * 15)


def word_long(word: Column, strict: bool = True) -> Column:
    """The number as long; one of 2**63 or more raises, or is null unless ``strict``."""
    other = F.raise_error(F.concat(F.lit("no long: 0x"), word)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(word.isNotNull(), F.when(fits_long(word), F.conv(F.substring(word, 49, 16), 16, 10).cast("long")).otherwise(other))


def word_of(number: Column) -> Column:
    """A non-negative long as a word."""
    return F.lpad(F.lower(F.hex(number.cast("long"))), 64, "0")
