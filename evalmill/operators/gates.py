"""Claims, rules and guards: rejected rows are returned with their reasons, never dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A guard did not hold."""


def present(df: DataFrame, field: str) -> Column:
    """Whether a field holds something: not NULL, not an empty string, array or map; 0 and false do."""
    c, kind = F.col(field), dict(df.dtypes).get(field, "")
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def gaps(df: DataFrame, requires: list[str]) -> Column:
    """The required fields a row lacks; a column that does not exist is always lacking."""
    return F.array_compact(F.array(*[F.lit(f) if f not in df.columns else F.when(~present(df, f), f) for f in requires]))


def admit(df: DataFrame, requires: list[str]) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected with ``gaps``). Requiring nothing is a mistake and raises."""
    if not requires:
        raise GateError("a claim has to require something")
    marked = df.withColumn("gaps", gaps(df, requires))
    return marked.filter(F.size("gaps") == 0).drop("gaps"), marked.filter(F.size("gaps") > 0)


def require_admitted(df: DataFrame, requires: list[str]) -> DataFrame:
    """The admitted rows; raises if there are none, as a claim over nothing is no claim."""
    admitted, _ = admit(df, requires)
    if admitted.isEmpty():
        raise GateError(f"no row has all of {requires}")
    return admitted


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks, and item-level duplicates of the key under ``<key>_duplicate``.

    A rule that evaluates to NULL is not broken. Rules are built from functions that do not raise.
    """
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    single = df.select(F.col(key), F.explode(broken).alias("rule"))
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit(f"{key}_duplicate").alias("rule"))
    return single.unionByName(twice)


def require_none(found: DataFrame, what: str, show: int = 5) -> None:
    """Raises if there is any row, naming the first few."""
    some = found.limit(show).collect()  # at most ``show`` rows
    if some:
        raise GateError(f"{what}: {[r.asDict() for r in some]}")


def balanced(pool: DataFrame, draw: DataFrame, stratum: str, tolerance: float) -> DataFrame:
    """Per stratum of the pool: its share in pool and draw (0 if absent), and whether they are within tolerance."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias(f"{name}_n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum(f"{name}_n").alias(f"{name}_all"))))  # one row

    both = shares(pool, "pool").join(shares(draw, "draw"), stratum, "left")
    in_pool, in_draw = F.col("pool_n") / F.col("pool_all"), F.coalesce(F.col("draw_n") / F.col("draw_all"), F.lit(0.0))
    return both.select(stratum, in_pool.alias("pool_share"), in_draw.alias("draw_share"), (F.abs(in_draw - in_pool) <= tolerance).alias("balanced"))


def guard(df: DataFrame, test: Callable[[DataFrame], DataFrame], what: str) -> DataFrame:
    """df itself if test(df) gives no row; an explicit action, as a guard inside a plan may be pruned."""
    require_none(test(df), what)
    return df
