"""The tables of the run in canonical form, for Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ids
from ..functions import verdicts
from ..session import table

# Fixed value: the day before which an item may have been seen in training.
ANCHOR = "2026-02-16"


def records(spark: SparkSession, d: str) -> DataFrame:
    """records with unit and attempt in own form, the verdict's current name and whether the reply was delivered."""
    r = table(spark, d, "records").withColumns({"unit": ids.record_unit(), "attempt": ids.record_attempt(), "verdict": verdicts.current(F.col("completeness"))})
    return r.withColumn("delivered", verdicts.delivered(F.col("verdict"), F.col("finish_reason")))


def units(spark: SparkSession, d: str) -> DataFrame:
    """Every unit of every manifest: manifest_id, frozen_at, unit, model, item_id, arm, prompt_sha."""
    return table(spark, d, "manifest").select("manifest_id", "bench", "frozen_at", F.explode("units").alias("u")).select(
        "manifest_id", "bench", "frozen_at", F.col("u.unit_id").alias("unit"), "u.model", "u.item_id", "u.arm", "u.prompt_sha"
    )


def plan(spark: SparkSession, d: str) -> DataFrame:
    """The units of the manifests that none replaces, once each."""
    replaced = table(spark, d, "manifest").filter("supersedes is not null").select(F.col("supersedes").alias("manifest_id"))
    fields = ("model", "item_id", "arm", "prompt_sha", "manifest_id")
    return units(spark, d).join(replaced, "manifest_id", "left_anti").groupBy("unit").agg(*[F.min(f).alias(f) for f in fields])


def items(spark: SparkSession, d: str) -> DataFrame:
    """bench_items without repeated rows."""
    return table(spark, d, "bench_items").dropDuplicates(["item_id"])


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Probability replies with their outcome: model, arm, bp (NULL if unparsed), y, truncated, chars, ms."""
    outcome = table(spark, d, "bench_items").filter("bench = 'btf3'").groupBy("item_id").agg(F.max("outcome").alias("y"))
    r = table(spark, d, "records").filter("bench = 'btf3'")
    return r.join(outcome, "item_id").select(
        "model", "arm", F.round(F.col("parsed.prob") * 100).cast("bigint").alias("bp"), "y", F.coalesce(F.col("finish_reason") == "length", F.lit(False)).alias("truncated"),
        F.col("chars").cast("bigint").alias("chars"), F.round(F.col("duration_s") * 1000).cast("bigint").alias("ms"),
    )


def line_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Forecast-like rows made from lineitem: 600,000 rows at the largest size, eleven tied scores."""
    c = F.col
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("m"), (c("l_suppkey") % 7).cast("string")).alias("model"), F.when(c("l_linestatus") == "O", "forecastbench").otherwise("btf3").alias("dataset"),
        F.concat(F.lit("c"), (c("l_linenumber") % 4).cast("string")).alias("cond"),
        F.when(c("l_quantity") < 49, F.round(c("l_discount") * 1000).cast("bigint")).alias("bp"), F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (c("l_quantity") == 49).alias("truncated"), F.round(c("l_extendedprice")).cast("bigint").alias("chars"), F.round(c("l_extendedprice") * 100).cast("bigint").alias("ms"),
    )


# The same as common table expressions for DuckDB.
SQL = {
    "rec": r"""rec as (
        select *, case completeness when 'EMPTY' then 'EMPTY_HTTP' else completeness end as verdict,
               case when completeness is null then finish_reason is not null else completeness not in ('PROVIDER_ERROR', 'TRANSPORT_ERROR', 'EMPTY_HTTP', 'EMPTY') end as delivered,
               coalesce(regexp_replace(lower(regexp_replace(attempt_id, '\s+', '', 'g')), ':0+([0-9])', ':\1', 'g'), unit || ':' || attempt_no || ':' || lower(attempt_kind)) as attempt
        from (select *, coalesce(lower(regexp_replace(unit_id, '\s+', '', 'g')), split_part(lower(regexp_replace(attempt_id, '\s+', '', 'g')), ':', 1),
                                 substr(sha256(model || chr(0) || item_id || chr(0) || arm), 1, 16)) as unit from records))""",
    "units": "units as (select manifest_id, bench, frozen_at, u.unit_id as unit, u.model, u.item_id, u.arm, u.prompt_sha from (select manifest_id, bench, frozen_at, unnest(units) as u from manifest))",
    "plan": """plan as (select unit, min(model) as model, min(item_id) as item_id, min(arm) as arm, min(prompt_sha) as prompt_sha, min(manifest_id) as manifest_id from units
        where manifest_id not in (select supersedes from manifest where supersedes is not null) group by unit)""",
    "items": "items as (select distinct on (item_id) * from bench_items)",
    "fc": """fc as (select r.model, r.arm, cast(round(r.parsed.prob * 100) as bigint) as bp, o.y, coalesce(r.finish_reason = 'length', false) as truncated, cast(r.chars as bigint) as chars,
        cast(round(r.duration_s * 1000) as bigint) as ms from records r join (select item_id, max(outcome) as y from bench_items where bench = 'btf3' group by 1) o using (item_id) where r.bench = 'btf3')""",
    "lf": """lf as (select 'm' || (l_suppkey % 7) as model, case when l_linestatus = 'O' then 'forecastbench' else 'btf3' end as dataset, 'c' || (l_linenumber % 4) as cond,
        case when l_quantity < 49 then cast(round(l_discount * 1000) as bigint) end as bp, case when l_returnflag = 'R' then 1 else 0 end as y, l_quantity = 49 as truncated,
        cast(round(l_extendedprice) as bigint) as chars, cast(round(l_extendedprice * 100) as bigint) as ms from lineitem)""",
}
NEEDS = {"plan": ("units",)}


def with_views(names: str, select: str) -> str:
    """SQL over the named views."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "with " + ", ".join(SQL[n] for n in order) + (f", {select[5:]}" if select.startswith("with ") else f" {select}")
