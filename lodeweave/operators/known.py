"""Known addresses from label lists of different layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.scalars import without_prefix
from lodeweave.operators.joins import merge_by_precedence

#: What label lists call a kind of account and a good name (fixed values of the data model).
ACCOUNT_TYPES = {"Smart Contract": "contract", "Wallet": "eoa"}
LABELS = {"Legit": True, "Dodgy": False}
POOL_PREFIX = "Tornado Cash Pool "
COLUMNS = ["address", "name", "account_type", "entity", "legitimacy", "tags"]


def mapped(value: Column, names: dict, otherwise: Column | None = None) -> Column:
    """The value that a name stands for; other names stay, or become ``otherwise``."""
    out = value if otherwise is None else otherwise
    for name, meant in names.items():
        out = F.when(value == name, F.lit(meant)).otherwise(out)
    return out


def label_list(rows: DataFrame) -> DataFrame:
    """``address, name, account_type, entity, label, tags`` with words for types and labels; header lines that were read as rows go, texts are lower-cased."""
    own = rows.where(~F.col("address").eqNullSafe("Address"))
    legit = mapped(F.col("label"), LABELS, F.lit(None).cast("boolean"))
    return own.select("address", "name", mapped(F.col("account_type"), ACCOUNT_TYPES).alias("account_type"), F.lower("entity").alias("entity"), legit.alias("legitimacy"), F.lower("tags").alias("tags"))


def cluster_list(rows: DataFrame) -> DataFrame:
    """``address, name, account_type, type``: all legitimate; a wallet is no kind of entity."""
    entity = F.lower("type")
    return rows.select("address", "name", "account_type", F.when(entity != "wallet", entity).alias("entity"), F.lit(True).alias("legitimacy"), F.lit(None).cast("string").alias("tags"))


def pool_list(rows: DataFrame) -> DataFrame:
    """``address, name, account_type, type, legitimacy``: the pool's amount and currency are its tags, without the prefix of all names."""
    return rows.select("address", "name", "account_type", F.lower("type").alias("entity"), F.col("legitimacy").cast("boolean").alias("legitimacy"), F.lower(without_prefix(F.col("name"), POOL_PREFIX)).alias("tags"))


def known_addresses(sources: list[DataFrame]) -> DataFrame:
    """``address, name, account_type, entity, legitimacy, tags``: an address once, from the first source that has it. Rows without address go."""
    return merge_by_precedence([s.select(*COLUMNS).where("address IS NOT NULL") for s in sources], "address").select(*COLUMNS)
