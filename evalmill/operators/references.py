"""References to records that do not exist: missing, deleted or late targets.

References and parents are co-partitioned on (domain, key) and sorted by time; one pass over the
sorted stream keeps how many parent intervals are open, so each reference is settled where it stands
in the merge, without emitting pairs. Keys with more than ``hot_rows`` references are split over
salts, to which the few parent events of those keys are copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: References of one key that one task takes at most. The list of hotter keys has at most
#: rows / HOT_ROWS entries, which bounds what is broadcast.
HOT_ROWS = 200_000
BEFORE_ALL = -(2**63)


def orphan_references(refs: DataFrame, parents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every reference without a valid target, with its ``ref_state``.

    refs: ref_table, ref_column, ref_key, ref_month, domain, fk, t (long). parents: domain, fk, t_from,
    t_until (longs). A parent is valid in [t_from, t_until); NULL t_from means always, NULL t_until
    for ever. States: ``missing`` if the domain never has the key, ``deleted`` if it had it before or
    at t but not any more, otherwise ``late``. A NULL fk is missing; a NULL t counts as before all
    time. Repeated references each count; repeated parents do not matter. Empty parents make every
    reference missing; empty references give an empty result; other columns do not matter.
    """
    refs = refs.select("ref_table", "ref_column", "ref_key", "ref_month", "domain", "fk", "t")
    parents = parents.select("domain", "fk", "t_from", "t_until")
    start = F.coalesce(F.col("t_from"), F.lit(BEFORE_ALL))
    events = F.array(
        # known from the start of time, so that any reference sees whether the key exists at all
        F.struct(F.lit(BEFORE_ALL).alias("t"), F.lit(0).alias("open"), F.lit(0).alias("begun"), F.lit(1).alias("known")),
        F.struct(start.alias("t"), F.lit(1).alias("open"), F.lit(1).alias("begun"), F.lit(0).alias("known")),
        F.struct(F.greatest(start, F.col("t_until")).alias("t"), F.when(F.col("t_until").isNull(), 0).otherwise(-1).alias("open"), F.lit(0).alias("begun"), F.lit(0).alias("known")),
    )
    steps = (
        parents.filter(F.col("fk").isNotNull())
        .select("domain", "fk", F.explode(events).alias("e"))
        .groupBy("domain", "fk", F.col("e.t").alias("t"))
        .agg(F.sum("e.open").alias("open"), F.sum("e.begun").alias("begun"), F.max("e.known").cast("bigint").alias("known"))
    )
    hot = (
        refs.groupBy("domain", "fk").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
        .select(F.col("domain").alias("h_domain"), F.col("fk").alias("h_fk"), F.ceil(F.col("n") / hot_rows).cast("int").alias("salts"))
    )
    hot = F.broadcast(hot)  # at most rows / hot_rows entries

    def salted(df: DataFrame, salt) -> DataFrame:
        same = (F.col("domain") == F.col("h_domain")) & F.col("fk").eqNullSafe(F.col("h_fk"))
        return df.join(hot, same, "left").withColumn("salt", salt).drop("h_domain", "h_fk", "salts")

    spread = F.coalesce(F.pmod(F.xxhash64("ref_table", "ref_column", "ref_key"), F.col("salts")), F.lit(0)).cast("int")
    right = salted(refs, spread).select(
        "domain", "fk", "salt", F.coalesce(F.col("t"), F.lit(BEFORE_ALL)).alias("t"), F.lit(1).alias("is_ref"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("open", "begun", "known")],
        "ref_table", "ref_column", "ref_key", "ref_month",
    )
    left = salted(steps, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).select(
        "domain", "fk", "salt", "t", F.lit(0).alias("is_ref"), "open", "begun", "known",
        *[F.lit(None).cast("string").alias(c) for c in ("ref_table", "ref_column", "ref_key", "ref_month")],
    )
    # at one time parents come first: opened at t is in force at t, closed at t is not
    merge = Window.partitionBy("domain", "fk", "salt").orderBy("t", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).select("*", *[F.sum(c).over(merge).alias(f"n_{c}") for c in ("open", "begun", "known")])
    state = (
        F.when(F.col("n_known") == 0, "missing")
        .when(F.col("n_begun") > 0, "deleted")
        .otherwise("late")
    )
    return seen.filter("is_ref = 1 and n_open <= 0").select("ref_table", "ref_column", "ref_key", state.alias("ref_state"), "ref_month")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, column, state and month."""
    return orphans.groupBy("ref_table", "ref_column", "ref_state", "ref_month").agg(F.count(F.lit(1)).alias("n_orphans"))
