"""Messages delivered more than once: keep exactly one copy of each.

Copies are ranked by arrival inside (key, salt), and the heads of the salts are ranked once more by
key, so a key that holds any share of all rows is spread over ``salts`` groups and no task sees more
than rows/salts of it plus at most ``salts`` heads. Only the key, the order and the caller's id go
through the two exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups over which the copies of one key are spread. Costs nothing for small keys.
SALTS = 1024


def rank_copies(df: DataFrame, key: Column, order: list[Column], row_id: Column, carry: dict[str, Column] | None = None, salts: int = SALTS) -> DataFrame:
    """Columns row_id, key, is_first and the carried ones, one row per input row.

    Exactly one row per key has is_first true: the first by ``order`` (NULLs last), ties by row_id.
    A row whose key is NULL has no identity and counts as the only copy of its message. An empty
    table gives an empty result; other columns of df, whatever their names, do not matter.
    """
    thin = df.select(
        row_id.alias("row_id"),
        key.alias("key"),
        *[c.alias(f"o{i}") for i, c in enumerate(order)],
        *[c.alias(k) for k, c in (carry or {}).items()],
    )
    by = [F.col(f"o{i}").asc_nulls_last() for i in range(len(order))] + [F.col("row_id").asc_nulls_last()]
    # a row without a key is a group of its own
    group = F.coalesce(F.concat(F.lit("k"), F.col("key")), F.concat(F.lit("r"), F.col("row_id").cast("string")))
    salted = thin.withColumn("g", group).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    inner = salted.withColumn("r1", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*by)))
    # heads compete by key; the others are settled and keep their salt, so they stay spread
    lane = F.when(F.col("r1") == 1, F.lit(-1)).otherwise(F.col("salt"))
    outer = inner.withColumn("lane", lane).withColumn("r2", F.row_number().over(Window.partitionBy("g", "lane").orderBy(*by)))
    first = (F.col("r1") == 1) & (F.col("r2") == 1)
    return outer.select("row_id", "key", first.alias("is_first"), *(carry or {}))


def admit_batch(new: DataFrame, stored: DataFrame, key: Column, stored_key: Column, order: list[Column], row_id: Column) -> DataFrame:
    """row_id and key of the rows of a new delivery to be stored: firsts of messages not stored yet.

    The new rows are reduced to one per key before the anti join, so a hot key meets the stored side
    once. Rows without a key are always admitted.
    """
    firsts = rank_copies(new, key, order, row_id).filter("is_first").select("row_id", "key")
    # distinct first: a key stored very often would else meet the exchange with all its rows
    known = stored.select(stored_key.alias("key")).filter(F.col("key").isNotNull()).distinct()
    return firsts.join(known, "key", "left_anti").select("row_id", "key")
