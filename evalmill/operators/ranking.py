"""Positions and running sums that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked_rank(df: DataFrame, group: list[str], order: list[Column], chunk: Column) -> DataFrame:
    """df with ``rank`` (1-based position in the group) and ``group_size``.

    chunk must not decrease along order: rows are counted per (group, chunk), chunk counts are summed
    up, and only the rows of one chunk are sorted together. Ties in order are ranked arbitrarily, so
    order should end in a unique column.
    """
    keyed = df.withColumn("_chunk", chunk)
    counts = keyed.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*group).orderBy("_chunk")
    before = F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("_n").over(Window.partitionBy(*group))
    starts = counts.select(*group, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"), whole.alias("group_size"))
    inside = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order))
    return keyed.withColumn("_place", inside).join(starts, [*group, "_chunk"]).withColumn("rank", (F.col("_before") + F.col("_place")).cast("bigint")).drop("_chunk", "_before", "_place")


#: Chunks whose sums one task adds up; their totals are added up in turn.
SPAN = 1024


def chunked_sum(df: DataFrame, value: str, order: list[Column], chunk: Column, group: list[str] | None = None, span: int | None = SPAN) -> DataFrame:
    """df with ``running``: the sum of value up to and with the row along order, in the group; NULL values add nothing.

    chunk is a whole number that does not decrease along order. Rows are added up per chunk, chunks per
    span of them, and only the totals of these in one task per group. Without a span all chunks of a
    group are added up in one task, which is less work where they are few.
    """
    by = group or []
    keyed = df.withColumn("_chunk", chunk.cast("bigint"))
    sums = keyed.groupBy(*by, "_chunk").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_s"))
    ahead = lambda keys, at: Window.partitionBy(*(keys or [F.lit(1)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    if span is None:
        starts = sums.select(*by, "_chunk", F.coalesce(F.sum("_s").over(ahead(by, "_chunk")), F.lit(0)).alias("_before"))
    else:
        sums = sums.withColumn("_top", F.floor(F.col("_chunk") / span).cast("bigint"))
        tops = sums.groupBy(*by, "_top").agg(F.sum("_s").alias("_t"))
        tops = tops.select(*by, "_top", F.coalesce(F.sum("_t").over(ahead(by, "_top")), F.lit(0)).alias("_ahead"))
        within = F.coalesce(F.sum("_s").over(ahead([*by, "_top"], "_chunk")), F.lit(0))
        starts = sums.withColumn("_within", within).join(tops, [*by, "_top"]).select(*by, "_chunk", (F.col("_ahead") + F.col("_within")).alias("_before"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, [*by, "_chunk"]).withColumn("running", F.col("_before") + F.col("_in")).drop("_chunk", "_before", "_in")


def exact_median(df: DataFrame, group: list[str], value: str, name: str, width: int = 256, sizes: DataFrame | None = None) -> DataFrame:
    """group and the median of an integer column (mean of the middle two), without NULLs.

    Equal values are counted first and the counts summed up in chunks of ``width`` values, so neither
    a task nor an aggregation buffer holds a whole group. sizes: group and _n, the number of values, where known.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = chunked_sum(per, "_c", [F.col("_v")], F.floor(F.col("_v") / width), group, span=None)
    sizes = per.groupBy(*group).agg(F.sum("_c").alias("_n")) if sizes is None else sizes
    at = lambda k: F.min(F.when(F.col("running") > k, F.col("_v")))
    n = F.col("_n")
    middle = run.join(sizes, group).groupBy(*group).agg(at(F.floor((n - 1) / 2)).alias("_a"), at(F.floor(n / 2)).alias("_b"))
    return middle.select(*group, ((F.col("_a") + F.col("_b")) / 2).alias(name))


def hash_order(seed: str, key: Column) -> Column:
    """A reproducible random order that no partitioning changes: sha256 over seed and key, as hex."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def hash_draw(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows drawn without replacement: the lowest in hash order (a top-n, not a sort of everything)."""
    return df.orderBy(hash_order(seed, F.col(key)), F.col(key)).limit(n)
