"""Orders, runs, overlaps and running limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import chunked_rank, chunked_sum, hash_order


def even_spread(df: DataFrame, provider: str, key: str, seed: str) -> DataFrame:
    """key, provider, pos: an order in which every provider is spread evenly over the whole.

    The i-th of a provider's n units gets the place (i - 1/2) / n; places are compared as exact
    fractions, ties go to the provider's name. Ranks are taken in chunks of the hash order.
    """
    h = hash_order(seed, F.col(key))
    ranked = chunked_rank(df.select(provider, key).withColumn("_h", h), [provider], [F.col("_h"), F.col(key)], F.substring("_h", 1, 3))
    place = F.floor((2 * F.col("rank") - 1).cast("double") * 1e9 / (2 * F.col("group_size")).cast("double"))
    placed = ranked.select(provider, key, place.alias("_p"))
    whole = chunked_rank(placed.withColumn("_all", F.lit(1)), ["_all"], [F.col("_p"), F.col(provider), F.col(key)], F.floor(F.col("_p") / 250_000))
    return whole.select(key, provider, F.col("rank").alias("pos"))


def longest_runs(df: DataFrame, value: str, order: list[Column], group: list[str], chunk: Column) -> DataFrame:
    """group, value, longest: the most rows in a row with one value, by gaps and islands.

    chunk must not decrease along order (see chunked_rank). The value before a chunk's first row comes
    from the last row of the chunk before it, so runs go on across chunks; NULL is a value of its own.
    """
    keyed = df.withColumn("_c", chunk)
    w = Window.partitionBy(*group, "_c").orderBy(*order)
    last = keyed.groupBy(*group, "_c").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    ahead = last.select(*group, "_c", F.lag("_last").over(Window.partitionBy(*group).orderBy("_c")).alias("_ahead"))
    own = F.struct(F.col(value).alias("v"))
    placed = keyed.withColumn("_prev", F.lag(own).over(w)).withColumn("_n", F.row_number().over(w)).join(ahead, [*group, "_c"])
    before = F.when(F.col("_n") == 1, F.col("_ahead")).otherwise(F.col("_prev"))
    starts = placed.withColumn("_s", F.when(before.isNotNull() & before["v"].eqNullSafe(F.col(value)), 0).otherwise(1)).drop("_c", "_prev", "_n", "_ahead")
    islands = chunked_sum(starts, "_s", order, chunk, group)
    return islands.groupBy(*group, value, "running").agg(F.count(F.lit(1)).alias("n")).groupBy(*group, value).agg(F.max("n").alias("longest"))


def peak_overlap(df: DataFrame, group: list[str], start: str, end: str, chunk: int) -> DataFrame:
    """group, peak: the most intervals open at once. At one instant ends come before starts.

    Equal instants are summed first; the running sum goes over chunks of ``chunk`` time units.
    """
    ends = df.select(*group, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*group, "e.t", "e.d")
    steps = ends.groupBy(*group, "t", "d").agg(F.sum("d").alias("delta"))
    run = chunked_sum(steps, "delta", [F.col("t"), F.col("d")], F.floor(F.col("t") / chunk), group)
    return run.groupBy(*group).agg(F.max("running").alias("peak"))


def within_ceiling(df: DataFrame, value: str, order: list[Column], chunk: Column, ceiling: float) -> DataFrame:
    """df with ``spent_before`` and ``admitted``: a charge is admitted while what was spent before it is below the ceiling."""
    run = chunked_sum(df, value, order, chunk)
    before = F.col("running") - F.coalesce(F.col(value), F.lit(0))
    return run.withColumn("spent_before", before).withColumn("admitted", before < ceiling)


def quarantined(df: DataFrame, group: list[str], defect: Column, order: list[Column], limit: int, chunk: Column) -> DataFrame:
    """df with ``state``: ACTIVE rows up to and with the limit-th defect of the group (successes in between do not reset), QUARANTINED after."""
    marked = df.withColumn("_d", F.when(defect, 1).otherwise(0))
    run = chunked_sum(marked, "_d", order, chunk, group)
    return run.withColumn("state", F.when(F.col("running") - F.col("_d") >= limit, "QUARANTINED").otherwise("ACTIVE")).drop("_d", "running")
