"""Records against the plan: buckets, resume, comparison of arms and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts
from ..functions.scalars import share


def latest(records: DataFrame, unit: str, seq: str, fields: list[str], delivered: str | None = None) -> DataFrame:
    """One row per unit: the fields of its last record by seq; with ``delivered`` a delivered one goes before any other.

    An aggregate, not a window: equal units are reduced before the exchange.
    """
    order = [F.col(delivered)] if delivered else []
    top = F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate([*order, F.col(seq)])], *fields)).alias("r")
    return records.filter(F.col(unit).isNotNull()).groupBy(unit).agg(top).select(unit, *[F.col(f"r.{f}").alias(f) for f in fields])


def census(plan: DataFrame, last: DataFrame, censored: DataFrame) -> DataFrame:
    """The plan with exactly one ``bucket`` per unit. last: unit, verdict; censored: unit."""
    joined = plan.join(last.withColumn("_seen", F.lit(True)), "unit", "left").join(censored.select("unit").distinct().withColumn("_cut", F.lit(True)), "unit", "left")
    bucket = F.when(F.col("_seen"), verdicts.bucket(F.col("verdict"))).when(F.col("_cut"), "CENSORED").otherwise("MISSING")
    return joined.withColumn("bucket", bucket).drop("_seen", "_cut")


def compliance(counted: DataFrame, group: list[str]) -> DataFrame:
    """Counts per bucket and the rates over them; what was not observed is never a failure."""
    out = counted.groupBy(*group).agg(
        F.count(F.lit(1)).alias("planned"), *[F.count_if(F.col("bucket") == b).alias(b.lower()) for b in verdicts.BUCKETS],
        F.count_if((F.col("bucket") == "OBSERVED") & (F.col("verdict") == "COMPLETE")).alias("complied"),
    )
    return with_rates(out)


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates recomputed from counts, so totals are never averages of rates."""
    c = F.col
    return (
        counts.withColumn("rate", share(c("complied"), c("observed"))).withColumn("lower_bound", share(c("complied"), c("planned")))
        .withColumn("coverage", share(c("observed"), c("planned"))).withColumn("inspection_rate", share(c("needs_inspection"), c("planned")))
        .withColumn("rate_basis", F.when(c("observed") > 0, "observed").otherwise("none"))
    )


def verify_plan(plan: DataFrame, records: DataFrame) -> DataFrame:
    """unit, state of plan and records together: MATCH, MISASSOCIATED, NO_HASH, UNPLANNED or MISSING; one row per record, or per unit without one."""
    both = plan.select("unit", F.col("prompt_sha").alias("_planned"), F.lit(True).alias("_in_plan")).join(
        records.select("unit", F.col("prompt_sha").alias("_sent"), F.lit(True).alias("_in_records")), "unit", "full_outer"
    )
    state = (
        F.when(F.col("_in_plan").isNull(), "UNPLANNED").when(F.col("_in_records").isNull(), "MISSING")
        .when(F.col("_sent").isNull() | F.col("_planned").isNull(), "NO_HASH").when(F.col("_sent") == F.col("_planned"), "MATCH").otherwise("MISASSOCIATED")
    )
    return both.select("unit", state.alias("state"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, complied (nullable) on both sides and the kind of pair: common, only_a, only_b."""
    left = a.select(*keys, F.col("complied").alias("a"), F.lit(True).alias("_a"))
    right = b.select(*keys, F.col("complied").alias("b"), F.lit(True).alias("_b"))
    both = left.join(right, keys, "full_outer")
    kind = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").otherwise("common")
    return both.select(*keys, "a", "b", kind.alias("kind"))


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) for every field that is not null-safe equal between two versions; values as strings."""
    joined = old.select(key, *[F.col(f).alias(f"_o_{f}") for f in fields]).join(new.select(key, *[F.col(f).alias(f"_n_{f}") for f in fields]), key)
    pairs = F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").cast("string").alias("old_value"), F.col(f"_n_{f}").cast("string").alias("new_value")) for f in fields]),
        lambda p: ~p["old_value"].eqNullSafe(p["new_value"]),
    )
    return joined.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
