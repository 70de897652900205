"""Queries of the general problems p1 to p4 over the test tables, with their oracles where SQL can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ids
from ..operators import copies, copydiff, nested, references
from ..session import month_of, table
from ..sources.envelope import reply_fields
from .views import with_views


# ---- 1. messages delivered more than once


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """rec_seq of every row of records but the first delivered of each attempt."""
    ranked = copies.rank_copies(table(spark, d, "records"), ids.record_attempt(), [F.col("delivered_at")], F.col("rec_seq"))
    return ranked.filter("not is_first").select(F.col("row_id").alias("rec_seq"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """The one copy kept of each attempt: attempt_id in own form and rec_seq."""
    ranked = copies.rank_copies(table(spark, d, "records"), ids.record_attempt(), [F.col("delivered_at")], F.col("rec_seq"))
    return ranked.filter("is_first").select(F.col("key").alias("attempt_id"), F.col("row_id").alias("rec_seq"))


def p1_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Incremental load: with the batches up to the middle one stored, what the later ones add."""
    records = table(spark, d, "records")
    middle = records.agg(F.floor((F.min("batch_no") + F.max("batch_no")) / 2).cast("int").alias("middle"))
    both = records.crossJoin(F.broadcast(middle))  # one row
    new, stored = both.filter("batch_no > middle"), both.filter("batch_no <= middle")
    out = copies.admit_batch(new, stored, ids.record_attempt(), ids.record_attempt(), [F.col("delivered_at")], F.col("rec_seq"))
    return out.select(F.col("key").alias("attempt_id"), F.col("row_id").alias("rec_seq"))


# ---- 2. references to records that do not exist


def _micros(ts):
    return F.unix_micros(ts)


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All references and all parents of the run's tables, in the form of orphan_references."""
    records, manifest = table(spark, d, "records"), table(spark, d, "manifest")
    items, roster = table(spark, d, "bench_items"), table(spark, d, "roster")
    raw, ledger = table(spark, d, "raw_responses"), table(spark, d, "ledger")

    def refs(df, name, column, key, month, domain, fk, t):
        return df.select(
            F.lit(name).alias("ref_table"), F.lit(column).alias("ref_column"), key.cast("string").alias("ref_key"),
            month_of(month).alias("ref_month"), F.lit(domain).alias("domain"), fk.alias("fk"), t.cast("bigint").alias("t"),
        )

    started = F.timestamp_micros(F.round(F.col("started_at") * 1_000_000).cast("bigint"))
    units = manifest.select("manifest_id", "frozen_at", F.explode("units").alias("u")).select(
        "manifest_id", "frozen_at", F.col("u.item_id").alias("item_id"), F.col("u.model").alias("model"),
        ids.own_unit(F.col("u.unit_id"), None, (F.col("u.model"), F.col("u.item_id"), F.col("u.arm"))).alias("unit_id"),
    )
    unit_key = F.concat_ws("/", "manifest_id", "unit_id")
    # a unit's item and model are two references read in one pass
    pair = F.explode(F.array(
        F.struct(F.lit("item_id").alias("c"), F.lit("item").alias("domain"), F.col("item_id").alias("fk")),
        F.struct(F.lit("model").alias("c"), F.lit("model").alias("domain"), F.col("model").alias("fk")),
    ))
    planned = units.withColumn("p", pair).select(
        F.lit("manifest").alias("ref_table"), F.col("p.c").alias("ref_column"), unit_key.alias("ref_key"),
        month_of(F.col("frozen_at")).alias("ref_month"), F.col("p.domain").alias("domain"), F.col("p.fk").alias("fk"), _micros(F.col("frozen_at")).alias("t"),
    )
    attempt = ids.own_attempt(F.col("attempt_id"))
    all_refs = (
        refs(records, "records", "unit_id", F.col("rec_seq"), started, "unit", ids.record_unit(), F.round(F.col("started_at") * 1_000_000))
        .unionByName(planned)
        .unionByName(refs(raw, "raw_responses", "attempt_id", F.col("raw_id"), F.col("logged_at"), "attempt", attempt, F.col("batch_no")))
        .unionByName(refs(ledger, "ledger", "attempt_id", F.col("entry_id"), F.col("charged_at"), "attempt", attempt, F.col("batch_no")))
    )

    ends = manifest.filter("supersedes is not null").groupBy(F.col("supersedes").alias("manifest_id")).agg(F.min(_micros(F.col("frozen_at"))).alias("t_until"))
    in_force = units.join(ends, "manifest_id", "left").select(F.lit("unit").alias("domain"), F.col("unit_id").alias("fk"), _micros(F.col("frozen_at")).alias("t_from"), "t_until")
    forever = F.lit(None).cast("bigint").alias("t_until")
    parents = (
        in_force
        .unionByName(items.select(F.lit("item").alias("domain"), F.col("item_id").alias("fk"), _micros(F.col("added_at")).alias("t_from"), _micros(F.col("withdrawn_at")).alias("t_until")))
        .unionByName(roster.select(F.lit("model").alias("domain"), F.col("model").alias("fk"), F.lit(None).cast("bigint").alias("t_from"), forever))
        .unionByName(records.groupBy(F.lit("attempt").alias("domain"), ids.record_attempt().alias("fk")).agg(F.min("batch_no").cast("bigint").alias("t_from")).select("*", forever))
    )
    return all_refs, parents


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of the run without a valid target."""
    return references.orphan_references(*_references(spark, d)).select("ref_table", "ref_column", "ref_key", "ref_state", "ref_month")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, column, state and month."""
    return references.orphan_report(p2_found(spark, d))


# ---- 3. differences between two copies of data

#: Fields compared, and their types on both sides.
REPLY_FIELDS = {"finish_reason": "string", "text": "string", "prompt_tokens": "double", "completion_tokens": "double", "reasoning_tokens": "double", "prompt_sha": "string"}


def _reply_body():
    names = ["complete", "finish_reason", "text", "prompt_tokens", "completion_tokens", "reasoning_tokens"]

    @F.pandas_udf("complete boolean, finish_reason string, text string, prompt_tokens double, completion_tokens double, reasoning_tokens double")
    def parse(response: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reply_fields(None if s is None else s) for s in response], columns=names)

    return parse


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Attempts lacking in records or in the sidecar, and each field in which the two differ."""
    records, raw = table(spark, d, "records"), table(spark, d, "raw_responses")
    left = records.select(
        ids.record_attempt().alias("key"), F.col("rec_seq").alias("pick"), F.lit(True).alias("usable"), F.col("finish_reason").isNotNull().alias("expected"),
        "finish_reason", "text", F.col("usage.prompt_tokens").cast("double").alias("prompt_tokens"), F.col("usage.completion_tokens").cast("double").alias("completion_tokens"),
        F.col("usage.completion_tokens_details.reasoning_tokens").cast("double").alias("reasoning_tokens"), "prompt_sha",
    )
    unit = ids.own_unit(F.col("unit_id"), F.col("attempt_id"))
    right = raw.select(
        ids.own_attempt(F.coalesce(F.col("attempt_id"), F.concat(unit, F.lit(":?")))).alias("key"), F.col("raw_id").alias("pick"), _reply_body()("response").alias("b"), "prompt_sha",
    ).select("key", "pick", F.col("b.complete").alias("usable"), F.lit(False).alias("expected"), "b.finish_reason", "b.text", "b.prompt_tokens", "b.completion_tokens", "b.reasoning_tokens", "prompt_sha")
    return copydiff.differing_fields(left, right, list(REPLY_FIELDS), "missing_record", "missing_raw").select(F.col("key").alias("attempt_id"), "field_name")


# ---- 4. deeply nested semi-structured records


def _shredded(spark: SparkSession, d: str, ancestor: str = "", columns: dict[str, str] | None = None) -> DataFrame:
    paths = nested.REPLY_TABLES if columns is None else [f"{ancestor}.{p}" if ancestor else p for p in columns.values()]
    return nested.shred(table(spark, d, "raw_responses"), "raw_id", "response", paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per choice and per element of the arrays in its message."""
    at = F.col("ordinals")
    return nested.elements(_shredded(spark, d)).select(
        F.col("row_id").alias("raw_id"), "child_table", at[0].alias("choice_pos"), F.when(F.size(at) > 1, at[F.size(at) - 1]).otherwise(F.lit(-1)).cast("int").alias("child_pos")
    )


def p4_responses(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of responses."""
    cols = {"response_id": "id", "model": "model", "provider": "provider", "prompt_tokens": "usage.prompt_tokens", "completion_tokens": "usage.completion_tokens", "error_code": "error.code"}
    return nested.flat_table(_shredded(spark, d, "", cols), "", cols, ()).withColumnRenamed("row_id", "raw_id")


def p4_choices(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of choices, tied to their response."""
    cols = {"finish_reason": "finish_reason", "role": "message.role", "content": "message.content", "reasoning": "message.reasoning"}
    return nested.flat_table(_shredded(spark, d, "choices[]", cols), "choices[]", cols, ("choice_pos",)).withColumnRenamed("row_id", "raw_id")


def p4_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of tool calls, tied to their choice."""
    cols = {"call_id": "id", "function_name": "function.name", "arguments": "function.arguments"}
    return nested.flat_table(_shredded(spark, d, "choices[].message.tool_calls[]", cols), "choices[].message.tool_calls[]", cols, ("choice_pos", "child_pos")).withColumnRenamed("row_id", "raw_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_admitted, p2_found, p2_report, p3_found, p4_found, p4_responses, p4_choices, p4_tool_calls)}


_NORM = r"regexp_replace(lower(regexp_replace({0}, '\s+', '', 'g')), ':0+([0-9])', ':\1', 'g')"
_PARENTS = """u as (select manifest_id, frozen_at, u.unit_id as unit, u.item_id, u.model from (select manifest_id, frozen_at, unnest(units) as u from manifest)),
ends as (select supersedes as manifest_id, min(frozen_at) as t_until from manifest where supersedes is not null group by 1),
force as (select u.unit, u.frozen_at as t_from, e.t_until from u left join ends e using (manifest_id)),
its as (select item_id, min(added_at) as added_at, min(withdrawn_at) as withdrawn_at from bench_items group by 1),
att as (select attempt, min(batch_no) as b from rec group by 1)"""
_ORPHANS = f"""orphans as (
select 'records' as ref_table, 'unit_id' as ref_column, cast(rec_seq as varchar) as ref_key, case when n = 0 then 'missing' when begun > 0 then 'deleted' else 'late' end as ref_state, strftime(t, '%Y-%m') as ref_month
from (select r.rec_seq, r.t, count(f.unit) as n, count(*) filter (f.t_from <= r.t) as begun, count(*) filter (f.t_from <= r.t and (f.t_until is null or r.t < f.t_until)) as valid
      from (select rec_seq, unit, make_timestamp(cast(round(started_at * 1000000) as bigint)) as t from rec) r left join (select unit, t_from::timestamp as t_from, t_until::timestamp as t_until from force) f on f.unit = r.unit group by 1, 2) where valid = 0
union all select 'manifest', 'item_id', manifest_id || '/' || unit, case when i.item_id is null then 'missing' when i.added_at > u.frozen_at then 'late' else 'deleted' end, strftime(u.frozen_at::timestamp, '%Y-%m')
from u left join its i on i.item_id = u.item_id where i.item_id is null or i.added_at > u.frozen_at or i.withdrawn_at <= u.frozen_at
union all select 'manifest', 'model', manifest_id || '/' || unit, 'missing', strftime(frozen_at::timestamp, '%Y-%m') from u where model not in (select model from roster)
union all select 'raw_responses', 'attempt_id', cast(raw_id as varchar), case when b is null then 'missing' else 'late' end, strftime(logged_at::timestamp, '%Y-%m')
from raw_responses w left join att on att.attempt = {_NORM.format('w.attempt_id')} where b is null or b > w.batch_no
union all select 'ledger', 'attempt_id', cast(entry_id as varchar), case when b is null then 'missing' else 'late' end, strftime(charged_at::timestamp, '%Y-%m')
from ledger w left join att on att.attempt = {_NORM.format('w.attempt_id')} where b is null or b > w.batch_no)"""
_RANKED = "ranked as (select rec_seq, attempt, row_number() over (partition by coalesce('k' || attempt, 'r' || rec_seq) order by delivered_at, rec_seq) as r from rec)"
ORACLE = {
    "p1_found": with_views("rec", f"with {_RANKED} select rec_seq from ranked where r > 1"),
    "p1_kept": with_views("rec", f"with {_RANKED} select attempt as attempt_id, rec_seq from ranked where r = 1"),
    "p1_admitted": with_views("rec", """with m as (select floor((min(batch_no) + max(batch_no)) / 2) as middle from records),
        n as (select attempt, rec_seq, row_number() over (partition by attempt order by delivered_at, rec_seq) as r from rec, m where batch_no > middle)
        select attempt as attempt_id, rec_seq from n where r = 1 and attempt not in (select attempt from rec, m where batch_no <= middle)"""),
    "p2_found": with_views("rec", f"with {_PARENTS}, {_ORPHANS} select * from orphans"),
    "p2_report": with_views("rec", f"with {_PARENTS}, {_ORPHANS} select ref_table, ref_column, ref_state, ref_month, count(*) as n_orphans from orphans group by all"),
}
