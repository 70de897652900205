"""Differences between two copies of data, field by field.

Both sides are tagged and united, grouped once by key with one struct kept per side, and the structs
are compared by expressions generated from the list of fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differing_fields(left: DataFrame, right: DataFrame, fields: list[str], missing_left: str, missing_right: str) -> DataFrame:
    """(key, field_name): once per key and differing field.

    left and right: key, pick (order among copies, the lowest is taken), usable (has comparable
    values), expected (the other side must have a usable row), and one column per field, same types
    on both sides. Keys with no left row give ``missing_left``; keys with an expected left row and no
    usable right row give ``missing_right``; where both are usable, each field not equal null-safely
    comes out under its name. NULL keys have no counterpart and are left out. The partial aggregation
    before the exchange keeps one struct per side, so a hot key costs one row per map task.
    """

    def tagged(df: DataFrame, side: str) -> DataFrame:
        body = F.struct("pick", *fields)
        keep = F.when(F.col("usable"), body)
        there = F.lit(True)
        return df.filter(F.col("key").isNotNull()).select(
            "key",
            *[(keep if s == side else F.lit(None)).cast(_type(df, fields)).alias(f"{s}_row") for s in ("l", "r")],
            *[(there if s == side else F.lit(None).cast("boolean")).alias(f"{s}_there") for s in ("l", "r")],
            (F.col("expected") if side == "l" else F.lit(None).cast("boolean")).alias("l_expected"),
        )

    both = tagged(left, "l").unionByName(tagged(right, "r"))
    once = both.groupBy("key").agg(
        F.min("l_row").alias("l"), F.min("r_row").alias("r"),
        F.max("l_there").alias("l_there"), F.max("r_there").alias("r_there"), F.max("l_expected").alias("l_expected"),
    )
    pairs = ", ".join(f"if(l.`{f}` <=> r.`{f}`, null, '{f}')" for f in fields)
    found = F.expr(f"""
        case when l_there is null then array('{missing_left}')
             when r is null then if(l_expected, array('{missing_right}'), array())
             when l is null then array()
             else filter(array({pairs}), f -> f is not null) end""")
    return once.select("key", F.explode(found).alias("field_name"))


def _type(df: DataFrame, fields: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"`{f}`:{kinds[f]}" for f in ("pick", *fields)) + ">"
