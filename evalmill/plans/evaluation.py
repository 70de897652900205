"""Queries of the evaluation engine over the test tables, each with its oracle in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ids
from ..functions import scalars, verdicts
from ..operators import gates, metrics, ranking, reconcile, sequences
from ..session import table
from . import views
from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = ""):
    """Registers a query, with its oracle where SQL can say it."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(needs, sql) if needs else sql
        return f

    return register


# ---- metrics over stored forecasts

_SUMMARY = """with c as (select {g}, count(*) as n, count(bp) as parsed, count(*) filter (truncated) as truncated, median(chars) as median_chars, median(ms) as median_ms, sum(bp) as s from {t} group by {g}),
k as (select {g}, count(*) filter (bp >= {h} and y = 1) as tp, count(*) filter (bp >= {h} and y = 0) as fp, count(*) filter (bp < {h} and y = 1) as fn, count(*) filter (bp < {h} and y = 0) as tn,
      count(*) as kn, sum(y) as ky, sum((bp - {u} * y) * (bp - {u} * y)) as sq from {t} where bp is not null and y is not null group by {g}),
a as (select {g}, sum(case when y = 1 then r else 0 end) as rs, sum(y) as p, count(*) - sum(y) as q
      from (select *, 2 * rank() over (partition by {g} order by bp) + count(*) over (partition by {g}, bp) - 1 as r from {t} where bp is not null and y is not null) group by {g})
select {gc}, n, parsed, truncated, cast(median_chars as double) as median_chars, cast(median_ms as double) as median_ms, tp, fp, fn, tn,
       tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, case when tp > 0 then 2 * tp / (2 * tp + fp + fn) when kn > 0 then 0.0 end as f1, (tp + tn) / nullif(kn, 0) as accuracy,
       sq / (kn * {u} * {u}) as brier, ky * (kn - ky) / (kn * kn) as brier_base_rate,
       case when p > 0 and q > 0 then cast((rs - p * (p + 1)) as double) / (2 * p * q) end as roc_auc,
       parsed / n as parse_rate, truncated / n as truncation_rate, case when parsed > 0 then s / (parsed * {u}) end as mean_forecast
from c left join k using ({g}) left join a using ({g})"""


def _summary_sql(t: str, groups: str, half: int, unit: int) -> str:
    return _SUMMARY.format(t=t, g=groups, gc=groups, h=half, u=unit)


@query("forecast_summary", _summary_sql("fc", "model, arm", 50, 100), "fc")
def forecast_summary(spark, d):
    """AG01: the headline table per model and arm over the recorded probability replies."""
    return metrics.forecast_summary(views.forecasts(spark, d), ["model", "arm"], 50, 100)


@query("forecast_summary_large", _summary_sql("lf", "model, dataset, cond", 50, 100), "lf")
def forecast_summary_large(spark, d):
    """AG01 over the large forecast rows, per model, dataset and condition."""
    return metrics.forecast_summary(views.line_forecasts(spark, d), ["model", "dataset", "cond"], 50, 100)


@query("forecast_auc", """select model, dataset, sum(y) as n_pos, count(*) - sum(y) as n_neg, (sum(case when y = 1 then r else 0 end) - sum(y) * (sum(y) + 1)) / cast(2 * sum(y) * (count(*) - sum(y)) as double) as roc_auc
    from (select *, 2 * rank() over (partition by model, dataset order by bp) + count(*) over (partition by model, dataset, bp) - 1 as r from lf where bp is not null) group by 1, 2""", "lf")
def forecast_auc(spark, d):
    """AG05, WN01: ROC-AUC with ties."""
    return metrics.rank_auc(views.line_forecasts(spark, d), ["model", "dataset"], "bp", "y")


@query("confusion_at_half", """select model, tp, fp, fn, tn, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, case when tp > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1, (tp + tn) / (tp + fp + fn + tn) as accuracy
    from (select model, count(*) filter (bp >= 50 and y = 1) as tp, count(*) filter (bp >= 50 and y = 0) as fp, count(*) filter (bp < 50 and y = 1) as fn, count(*) filter (bp < 50 and y = 0) as tn from lf where bp is not null group by 1)""", "lf")
def confusion_at_half(spark, d):
    """AG03, AG04."""
    return metrics.confusion(views.line_forecasts(spark, d), ["model"], "bp", "y", 50)


@query("brier_vs_base", """select model, cond, count(*) as n, sum(y) as n_pos, sum((bp - 100 * y) * (bp - 100 * y)) / (count(*) * 10000) as brier, sum(y) * (count(*) - sum(y)) / (count(*) * count(*)) as brier_base_rate from lf where bp is not null group by 1, 2""", "lf")
def brier_vs_base(spark, d):
    """AG06, MF05."""
    return metrics.brier(views.line_forecasts(spark, d), ["model", "cond"], "bp", "y", 100)


@query("expert_baseline", """select count(*) as n, sum(y) as n_pos, sum((pct - 100 * y) * (pct - 100 * y)) / (count(*) * 10000) as brier, sum(y) * (count(*) - sum(y)) / (count(*) * count(*)) as brier_base_rate
    from (select cast(l_quantity * 2 as bigint) as pct, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem where not isnan(l_quantity) and l_quantity is not null)""")
def expert_baseline(spark, d):
    """AG07: percent forecasts, with NaN left out and the scale checked before it is used."""
    rows = table(spark, d, "lineitem").filter("not isnan(l_quantity)").select((F.col("l_quantity") * 2).cast("bigint").alias("pct"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    gates.require_none(rows.agg(F.max("pct").alias("m")).filter("m <= 1"), "forecasts are not in percent")
    return metrics.brier(rows.withColumn("g", F.lit(1)), ["g"], "pct", "y", 100).drop("g")


@query("median_latency", "select model, arm, cast(median(ms) as double) as median_ms, min(ms) as least_ms, max(ms) as most_ms from fc group by 1, 2", "fc")
def median_latency(spark, d):
    """AG08."""
    f = views.forecasts(spark, d)
    out = f.groupBy("model", "arm").agg(F.min("ms").alias("least_ms"), F.max("ms").alias("most_ms"))
    return out.join(ranking.exact_median(f, ["model", "arm"], "ms", "median_ms", 4096), ["model", "arm"])


@query("capability_summary", """select model, bench, arm, count(*) as n, count(compliant) as scored, count(*) filter (compliant) as hits, count(*) filter (compliant) / nullif(count(compliant), 0) as accuracy, count(*) filter (finish_reason = 'length') as truncated from records group by 1, 2, 3""")
def capability_summary(spark, d):
    """AG02: accuracy over what was observed only."""
    out = table(spark, d, "records").groupBy("model", "bench", "arm").agg(F.count(F.lit(1)).alias("n"), F.count("compliant").alias("scored"), F.count_if("compliant").alias("hits"), F.count_if(F.col("finish_reason") == "length").alias("truncated"))
    return out.withColumn("accuracy", scalars.share(F.col("hits"), F.col("scored")))


@query("degenerate_cells", """select model, arm, n, parsed, parsed < 0.95 * n as degenerate from (select model, arm, count(*) as n, count(bp) as parsed from fc group by 1, 2)""", "fc")
def degenerate_cells(spark, d):
    """PF05: cells that lose parses are marked, never dropped."""
    cells = views.forecasts(spark, d).groupBy("model", "arm").agg(F.count(F.lit(1)).alias("n"), F.count("bp").alias("parsed"))
    return cells.withColumn("degenerate", F.col("parsed") < 0.95 * F.col("n"))


@query("row_preview", r"""select rec_seq, substr(replace(coalesce(text, ''), chr(10), ' ⏎ '), 1, 400) as preview, parsed.prob >= 0.5 as says_yes from records""")
def row_preview(spark, d):
    """PF01, PF02, PF03."""
    return table(spark, d, "records").select("rec_seq", F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ⏎ ")), 1, 400).alias("preview"), (F.col("parsed.prob") >= 0.5).alias("says_yes"))


# ---- the plan and what came of it


@query("plan_cross", """select r.model, i.item_id, a.arm, substr(sha256(r.model || chr(0) || i.item_id || chr(0) || a.arm), 1, 16) as unit from roster r, items i, (select 'original' as arm union all select 'cot') a where i.withdrawn_at is not null""", "items")
def plan_cross(spark, d):
    """The part of plan_grid over withdrawn items, to be run again."""
    picked = views.items(spark, d).filter("withdrawn_at is not null").select("item_id")
    return _cross(spark, d, picked)


@query("plan_grid", """select r.model, i.item_id, a.arm, substr(sha256(r.model || chr(0) || i.item_id || chr(0) || a.arm), 1, 16) as unit from roster r, items i, (select 'original' as arm union all select 'cot') a""", "items")
def plan_grid(spark, d):
    """JN01: roster x items x arms, the one cross product that is wanted; every item."""
    return _cross(spark, d, views.items(spark, d).select("item_id"))


@query("plan_collisions", """select count(*) as n_units, count(distinct substr(sha256(r.model || chr(0) || i.item_id || chr(0) || a.arm), 1, 16)) as n_distinct from roster r, items i, (select 'original' as arm union all select 'cot') a""", "items")
def plan_collisions(spark, d):
    """JN01: the collision check of the plan; gates that freeze a plan need both numbers equal."""
    return plan_grid(spark, d).agg(F.count(F.lit(1)).alias("n_units"), F.count_distinct("unit").alias("n_distinct"))


@query("grid_todo", """select r.model, i.item_id, a.arm, substr(sha256(r.model || chr(0) || i.item_id || chr(0) || a.arm), 1, 16) as unit from roster r, items i, (select 'original' as arm union all select 'cot') a
    where substr(sha256(r.model || chr(0) || i.item_id || chr(0) || a.arm), 1, 16) not in (select unit from rec where delivered and unit is not null)""", "rec items")
def grid_todo(spark, d):
    """JN21: the grid without the keys that are done."""
    done = views.records(spark, d).filter("delivered").select("unit")
    return plan_grid(spark, d).join(done, "unit", "left_anti").select("model", "item_id", "arm", "unit")


@query("repeat_grid", """with cases as (select distinct model, item_id, arm from rec where verdict in ('UNDECIDED', 'EMPTY_PARSE') and model is not null and item_id is not null and arm is not null)
    select c.model, c.item_id, c.arm, n as repeat_no, c.model in (select model from roster) as on_roster from cases c, range(1, 4) t(n) where c.model in (select model from roster) or n = 1""", "rec")
def repeat_grid(spark, d):
    """JN22: cases to run three times each; a case of a model off the roster is reported once, not run."""
    cases = views.records(spark, d).filter("verdict in ('UNDECIDED', 'EMPTY_PARSE') and model is not null and item_id is not null and arm is not null").select("model", "item_id", "arm").distinct()
    known = table(spark, d, "roster").select("model", F.lit(True).alias("known")).distinct()
    rows = cases.join(known, "model", "left").withColumn("on_roster", F.coalesce("known", F.lit(False)))
    return rows.withColumn("repeat_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.when(F.col("on_roster"), F.lit(3)).otherwise(F.lit(1)).cast("bigint")))).select("model", "item_id", "arm", "repeat_no", "on_roster")


@query("datasets", "select case when bench = 'btf3' then 'btf3' else 'forecastbench' end as dataset, count(*) as n from records group by 1")
def datasets(spark, d):
    """PF04: what is not of the one source counts for the other."""
    return table(spark, d, "records").groupBy(F.when(F.col("bench") == "btf3", "btf3").otherwise("forecastbench").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


def _cross(spark, d, picked):
    models = table(spark, d, "roster").select("model")  # a fixed list
    arms = F.explode(F.array(F.lit("original"), F.lit("cot"))).alias("arm")
    rows = picked.crossJoin(F.broadcast(models)).select("model", "item_id", arms)
    return rows.withColumn("unit", ids.unit_hash(F.col("model"), F.col("item_id"), F.col("arm")))


_LAST = """last as (select unit, max_by(verdict, rec_seq) as verdict, max_by(coalesce(verdict, ''), rec_seq) as v from rec group by unit),
cut as (select distinct unit_id as unit from faults where gave_up_because is not null),
cen as (select p.*, case when l.v = '' then null else l.v end as verdict, case when l.unit is not null then case when l.v in ('COMPLETE', 'NO_ANSWER') then 'OBSERVED' when l.v in ('EMPTY_PARSE', 'EMPTY_CONFLICT') then 'NEEDS_INSPECTION' else 'UNOBSERVED' end
    when c.unit is not null then 'CENSORED' else 'MISSING' end as bucket from plan p left join last l on l.unit = p.unit left join cut c on c.unit = p.unit)"""
_COUNTS = "count(*) as planned, count(*) filter (bucket = 'OBSERVED') as observed, count(*) filter (bucket = 'NEEDS_INSPECTION') as needs_inspection, count(*) filter (bucket = 'UNOBSERVED') as unobserved, count(*) filter (bucket = 'CENSORED') as censored, count(*) filter (bucket = 'MISSING') as missing, count(*) filter (bucket = 'OBSERVED' and verdict = 'COMPLETE') as complied"
_RATES = "complied / nullif(observed, 0) as rate, complied / nullif(planned, 0) as lower_bound, observed / nullif(planned, 0) as coverage, needs_inspection / nullif(planned, 0) as inspection_rate, case when observed > 0 then 'observed' else 'none' end as rate_basis"


def _census(spark, d):
    last = reconcile.latest(views.records(spark, d), "unit", "rec_seq", ["verdict"])
    cut = table(spark, d, "faults").filter("gave_up_because is not null").select(ids.own_unit(F.col("unit_id"), F.col("attempt_id")).alias("unit"))
    return reconcile.census(views.plan(spark, d), last, cut)


@query("census", f"with {_LAST} select unit, model, arm, bucket from cen", "rec plan")
def census(spark, d):
    """JN02, JN15, PF08, WN05: one bucket per planned unit."""
    return _census(spark, d).select("unit", "model", "arm", "bucket")


@query("compliance_table", f"with {_LAST}, t as (select model, {_COUNTS} from cen group by model) select *, {_RATES} from t", "rec plan")
def compliance_table(spark, d):
    """AG09."""
    return reconcile.compliance(_census(spark, d), ["model"])


@query("compliance_totals", f"with {_LAST}, t as (select arm, {_COUNTS} from cen group by rollup (arm)) select coalesce(arm, 'TOTAL') as arm, planned, observed, needs_inspection, unobserved, censored, missing, complied, {_RATES} from t", "rec plan")
def compliance_totals(spark, d):
    """AG10: subtotals and total, rates recomputed from the sums."""
    by = reconcile.compliance(_census(spark, d), ["arm"])
    counts = ["planned", *[b.lower() for b in verdicts.BUCKETS], "complied"]
    total = by.agg(*[F.sum(c).alias(c) for c in counts]).select(F.lit("TOTAL").alias("arm"), *counts)
    return reconcile.with_rates(by.select("arm", *counts).unionByName(total))


_TODO = "todo as (select * from plan where unit not in (select unit from rec where delivered))"


@query("resume_todo", f"with {_TODO} select unit, model, item_id, arm from todo", "rec plan")
def resume_todo(spark, d):
    """JN03, SR02: planned units without a delivered reply."""
    done = views.records(spark, d).filter("delivered").select("unit")
    return views.plan(spark, d).join(done, "unit", "left_anti").select("unit", "model", "item_id", "arm")


@query("resume_order", f"with pos as (select unit, row_number() over (order by sha256('run:' || unit), unit) as pos from plan), {_TODO} select pos.pos, unit from pos join todo using (unit)", "rec plan")
def resume_order(spark, d):
    """JN04, SA04: the frozen order without what is done, places kept."""
    frozen = views.plan(spark, d).select("unit").withColumn("g", F.lit(1)).withColumn("h", ranking.hash_order("run", F.col("unit")))
    placed = ranking.chunked_rank(frozen, ["g"], [F.col("h"), F.col("unit")], F.substring("h", 1, 3)).select(F.col("rank").alias("pos"), "unit")
    return placed.join(views.records(spark, d).filter("delivered").select("unit"), "unit", "left_anti").select("pos", "unit")


@query("stage_units", "select unit, model, item_id from plan where model in (select model from roster) and item_id in (select item_id from bench_items where item_level >= 3)", "plan")
def stage_units(spark, d):
    """JN05, JN06, PF13: the planned units of listed models and items."""
    chosen = table(spark, d, "bench_items").filter("item_level >= 3").select("item_id")
    return views.plan(spark, d).join(table(spark, d, "roster").select("model"), "model", "left_semi").join(chosen, "item_id", "left_semi").select("unit", "model", "item_id")


@query("strays", "select 'model' as kind, model as key, count(*) as n from plan where model not in (select model from roster) group by 2 union all select 'item' as kind, item_id as key, count(*) as n from plan where item_id not in (select item_id from bench_items) group by 2", "plan")
def strays(spark, d):
    """JN05, JN06, JN19: what a stage list names that the plan cannot have; the guard raises on these rows."""
    plan = views.plan(spark, d)
    bad_models = plan.join(table(spark, d, "roster").select("model"), "model", "left_anti").groupBy(F.lit("model").alias("kind"), F.col("model").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    bad_items = plan.join(table(spark, d, "bench_items").select("item_id"), "item_id", "left_anti").groupBy(F.lit("item").alias("kind"), F.col("item_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return bad_models.unionByName(bad_items)


@query("partition_records", """select r.rec_seq, case when p.unit is null then 'out_of_plan' when r.prompt_sha <> p.prompt_sha then 'misassociated' when r.delivered then 'answered' else 'unanswered' end as part
    from rec r left join plan p on p.unit = r.unit""", "rec plan")
def partition_records(spark, d):
    """JN14: every record in exactly one part."""
    plan = views.plan(spark, d).select("unit", F.col("prompt_sha").alias("planned_sha"), F.lit(True).alias("planned"))
    part = F.when(F.col("planned").isNull(), "out_of_plan").when(F.col("prompt_sha") != F.col("planned_sha"), "misassociated").when(F.col("delivered"), "answered").otherwise("unanswered")
    return views.records(spark, d).join(plan, "unit", "left").select("rec_seq", part.alias("part"))


@query("verify_manifest", """select state, count(*) as n from (select case when p.unit is null then 'UNPLANNED' when r.unit is null then 'MISSING' when r.prompt_sha is null or p.prompt_sha is null then 'NO_HASH' when r.prompt_sha = p.prompt_sha then 'MATCH' else 'MISASSOCIATED' end as state
    from plan p full join rec r on r.unit = p.unit) group by 1""", "rec plan")
def verify_manifest(spark, d):
    """JN13."""
    return reconcile.verify_plan(views.plan(spark, d), views.records(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("explain_gaps", """select p.unit, case when p.unit in (select unit from rec where delivered) then 'done' when p.unit in (select unit_id from faults) then 'infra_fault_unbought'
    when p.model in (select model from faults where classification like 'api:%' or classification like 'transport:%' or classification like 'request:%' or classification like 'http:%') then 'model_paused' else 'never_dispatched' end as kind from plan p""", "rec plan")
def explain_gaps(spark, d):
    """JN17: why each planned unit is or is not done; the kinds are exhaustive."""
    faults = table(spark, d, "faults")
    flag = lambda df, on, name: df.select(on).distinct().withColumn(name, F.lit(True))
    done = flag(views.records(spark, d).filter("delivered"), "unit", "done")
    faulted = flag(faults.select(F.col("unit_id").alias("unit")), "unit", "faulted")
    paused = flag(faults.filter(F.col("classification").rlike("^(api|transport|request|http):")), "model", "paused")
    kind = F.when(F.col("done"), "done").when(F.col("faulted"), "infra_fault_unbought").when(F.col("paused"), "model_paused").otherwise("never_dispatched")
    return views.plan(spark, d).join(done, "unit", "left").join(faulted, "unit", "left").join(paused, "model", "left").select("unit", kind.alias("kind"))


_ARMS = """arms as (select model, item_id, arm, case max_by(coalesce(verdict, ''), rec_seq) when 'COMPLETE' then true when 'NO_ANSWER' then false end as complied from rec group by 1, 2, 3),
cmp as (select coalesce(a.model, b.model) as model, coalesce(a.item_id, b.item_id) as item_id, a.complied as a, b.complied as b, case when a.model is null then 'only_b' when b.model is null then 'only_a' else 'common' end as kind
    from (select * from arms where arm = 'original') a full join (select * from arms where arm = 'cot') b on a.model = b.model and a.item_id = b.item_id)"""


@query("compare_arms", f"""with {_ARMS} select model, count(*) filter (kind = 'common') as common, count(*) filter (kind = 'only_a') as only_a, count(*) filter (kind = 'only_b') as only_b,
    count(*) filter (a is not null and b is not null) as both_observed, count(*) filter (a <> b) as discordant, count(*) filter (not a and b) as fixed, count(*) filter (a and not b) as broke from cmp group by 1""", "rec")
def compare_arms(spark, d):
    """JN07, ST01: two runs paired by model and item."""
    r = views.records(spark, d).withColumn("k", F.concat_ws("\x00", "model", "item_id", "arm"))
    last = reconcile.latest(r, "k", "rec_seq", ["model", "item_id", "arm", "verdict"]).withColumn("complied", verdicts.compliant(F.col("verdict")))
    pair = reconcile.compare_runs(last.filter("arm = 'original'"), last.filter("arm = 'cot'"), ["model", "item_id"])
    a, b = F.col("a"), F.col("b")
    return pair.groupBy("model").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("common", "only_a", "only_b")], F.count_if(a.isNotNull() & b.isNotNull()).alias("both_observed"),
        F.count_if(a != b).alias("discordant"), F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broke"),
    )


@query("key_sets", """select count(*) filter (o and c) as both_arms, count(*) filter (o and not c) as only_original, count(*) filter (c and not o) as only_cot from (select model, item_id, bool_or(arm = 'original') as o, bool_or(arm = 'cot') as c from units group by 1, 2)""", "units")
def key_sets(spark, d):
    """ST01, ST03, ST04: intersection and differences of two key sets."""
    u = views.units(spark, d)
    o, c = (u.filter(F.col("arm") == a).select("model", "item_id") for a in ("original", "cot"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(o.intersect(c), "both_arms").crossJoin(count(o.subtract(c), "only_original")).crossJoin(count(c.subtract(o), "only_cot"))  # single rows


@query("sidecar_check", r"""with raw as (select raw_id, regexp_replace(lower(regexp_replace(attempt_id, '\s+', '', 'g')), ':0+([0-9])', ':\1', 'g') as attempt from raw_responses),
    a as (select distinct attempt from rec), b as (select attempt, count(*) as n from raw group by 1)
    select (select count(*) from b where attempt not in (select attempt from a)) as orphans, (select count(distinct attempt) from rec where finish_reason is not null and attempt not in (select attempt from b where attempt is not null)) as missing,
           (select count(*) from b where n > 1) as repeated, (select count(*) from raw where attempt is null) as no_id""", "rec")
def sidecar_check(spark, d):
    """JN08: records and sidecar against each other by attempt, both ways."""
    r = views.records(spark, d).filter("attempt is not null")
    raw = table(spark, d, "raw_responses").select(ids.own_attempt(F.col("attempt_id")).alias("attempt"))
    per = raw.groupBy("attempt").agg(F.count(F.lit(1)).alias("n"))
    orphans = per.filter("attempt is not null").join(r.select("attempt"), "attempt", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    missing = r.filter("finish_reason is not null").select("attempt").distinct().join(per, "attempt", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    twice = per.agg(F.count_if(F.col("attempt").isNotNull() & (F.col("n") > 1)).alias("repeated"), F.coalesce(F.sum(F.when(F.col("attempt").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    return orphans.crossJoin(missing).crossJoin(twice)  # single rows


@query("version_diff", """select unit, u.field, u.old_value, u.new_value from (select unit, unnest([{'field': 'verdict', 'old_value': ov, 'new_value': nv}, {'field': 'finish_reason', 'old_value': of, 'new_value': nf}]) as u from (
    select unit, min_by(coalesce(verdict, ''), rec_seq) as ov, max_by(coalesce(verdict, ''), rec_seq) as nv, min_by(coalesce(finish_reason, ''), rec_seq) as of, max_by(coalesce(finish_reason, ''), rec_seq) as nf from rec group by 1)) where u.old_value <> u.new_value""", "rec")
def version_diff(spark, d):
    """ST06, JN09: fields that changed between a unit's first and last record."""
    r = views.records(spark, d).select("unit", "rec_seq", *[F.coalesce(c, F.lit("")).alias(c) for c in ("verdict", "finish_reason")])
    fields = ["verdict", "finish_reason"]
    first = reconcile.latest(r.withColumn("back", -F.col("rec_seq")), "unit", "back", fields)
    return reconcile.changed_fields(first, reconcile.latest(r, "unit", "rec_seq", fields), "unit", fields)


@query("verdict_transitions", """select ov as from_verdict, nv as to_verdict, count(*) as n from (select unit, min_by(coalesce(verdict, ''), rec_seq) as ov, max_by(coalesce(verdict, ''), rec_seq) as nv from rec group by 1 having count(*) > 1) group by 1, 2""", "rec")
def verdict_transitions(spark, d):
    """ST06: verdicts from the first to the last record of units recorded more than once."""
    v = F.coalesce("verdict", F.lit(""))
    per = views.records(spark, d).groupBy("unit").agg(F.min_by(v, "rec_seq").alias("from_verdict"), F.max_by(v, "rec_seq").alias("to_verdict"), F.count(F.lit(1)).alias("n"))
    return per.filter("n > 1").groupBy("from_verdict", "to_verdict").agg(F.count(F.lit(1)).alias("n"))


_EV = """ev as (select *, nullif(trim(coalesce(reasoning, ''), chr(10) || chr(9) || chr(13) || ' '), '') is not null or length(trim(split_part(coalesce(text, ''), chr(92) || 'boxed', 1), chr(10) || chr(9) || chr(13) || chr(11) || chr(12) || ' ')) >= 120 as has from rec),
base as (select model, item_id, max_by(verdict, rec_seq) as v, max_by(has, rec_seq) as has from ev where arm = 'original' and verdict in ('COMPLETE', 'NO_ANSWER') group by 1, 2),
fu as (select model, item_id, max_by(has, rec_seq) as fhas from ev where arm = 'cot' and verdict in ('COMPLETE', 'NO_ANSWER') group by 1, 2)"""


def _reasoned(spark, d):
    from ..functions import replies

    return views.records(spark, d).withColumn("has", replies.reasoning_evidence(F.col("text"), F.col("reasoning"))["has"])


@query("reasoning_coverage", f"""with {_EV}, s as (select model, case when has then 'from_base' when v <> 'COMPLETE' then 'not_a_candidate' when fhas is null then 'followup_not_run' when fhas then 'after_followup' else 'absent_after_both' end as s from base left join fu using (model, item_id)),
    t as (select model, count(*) as units, count(*) filter (s = 'from_base') as from_base, count(*) filter (s = 'after_followup') as after_followup, count(*) filter (s = 'absent_after_both') as absent_after_both, count(*) filter (s = 'followup_not_run') as followup_not_run, count(*) filter (s = 'not_a_candidate') as not_a_candidate from s group by 1)
    select *, (from_base + after_followup) / nullif(units - followup_not_run, 0) as rate_over_asked, from_base / nullif(units, 0) as unprompted_rate from t""", "rec")
def reasoning_coverage(spark, d):
    """JN10, AG11, TX19, TX20: where reasoning came from, over what was asked."""
    r = _reasoned(spark, d).filter(F.col("verdict").isin(*verdicts.SCOREABLE)).withColumn("k", F.concat_ws("\x00", "model", "item_id"))
    base = reconcile.latest(r.filter("arm = 'original'"), "k", "rec_seq", ["model", "verdict", "has"])
    follow = reconcile.latest(r.filter("arm = 'cot'"), "k", "rec_seq", ["has"]).withColumnRenamed("has", "fhas")
    state = F.when(F.col("has"), "from_base").when(F.col("verdict") != "COMPLETE", "not_a_candidate").when(F.col("fhas").isNull(), "followup_not_run").when(F.col("fhas"), "after_followup").otherwise("absent_after_both")
    out = base.join(follow, "k", "left").withColumn("s", state).groupBy("model").agg(
        F.count(F.lit(1)).alias("units"), *[F.count_if(F.col("s") == s).alias(s) for s in ("from_base", "after_followup", "absent_after_both", "followup_not_run", "not_a_candidate")]
    )
    asked = F.col("units") - F.col("followup_not_run")
    return out.withColumn("rate_over_asked", scalars.share(F.col("from_base") + F.col("after_followup"), asked)).withColumn("unprompted_rate", scalars.share(F.col("from_base"), F.col("units")))


@query("followup_selection", f"""with {_EV} select case when model not in (select model from roster) then 'excluded_not_in_roster' when verdict = 'NO_ANSWER' then 'excluded_refusal' when verdict is null or verdict <> 'COMPLETE' then 'excluded_not_scoreable'
    when has then 'excluded_already_reasoned' when rn > 1 then 'excluded_duplicate' else 'selected' end as reason, count(*) as n
    from (select *, row_number() over (partition by model, item_id, verdict = 'COMPLETE' and not has and model in (select model from roster) order by rec_seq) as rn from ev) group by 1""", "rec")
def followup_selection(spark, d):
    """DQ09, WN06: who is asked again, every exclusion counted."""
    r = _reasoned(spark, d).join(table(spark, d, "roster").select("model", F.lit(True).alias("listed")), "model", "left")
    reason = (
        F.when(F.col("listed").isNull(), "excluded_not_in_roster").when(F.col("verdict") == "NO_ANSWER", "excluded_refusal")
        .when(F.coalesce(F.col("verdict") != "COMPLETE", F.lit(True)), "excluded_not_scoreable").when(F.col("has"), "excluded_already_reasoned").otherwise("selected")
    )
    counted = r.select("model", "item_id", reason.alias("reason")).groupBy("model", "item_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    # of each model and item the first is selected, the others are duplicates
    split = F.explode(F.when(F.col("reason") == "selected", F.array(F.struct(F.lit("selected").alias("reason"), F.lit(1).cast("bigint").alias("n")), F.struct(F.lit("excluded_duplicate").alias("reason"), (F.col("n") - 1).alias("n")))).otherwise(F.array(F.struct("reason", "n"))))
    return counted.select(split.alias("x")).groupBy("x.reason").agg(F.sum("x.n").alias("n")).filter("n > 0")


# ---- duplicates, conflicts, runs put together


@query("duplicates", "select attempt, count(*) as n from rec where attempt is not null group by 1 having count(*) > 1", "rec")
def duplicates(spark, d):
    """AG17."""
    return views.records(spark, d).filter("attempt is not null").groupBy("attempt").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("bought_twice", "select unit, count(distinct attempt) as attempts from rec where delivered group by 1 having count(distinct attempt) > 1", "rec")
def bought_twice(spark, d):
    """AG18: units delivered for more than one attempt."""
    return views.records(spark, d).filter("delivered").groupBy("unit").agg(F.count_distinct("attempt").alias("attempts")).filter("attempts > 1")


@query("verdict_conflicts", "select unit, count(verdict) as n, array_to_string(list_sort(list(distinct verdict)), ',') as verdicts from rec group by 1 having count(verdict) >= 2 and count(distinct verdict) > 1", "rec")
def verdict_conflicts(spark, d):
    """AG19."""
    out = views.records(spark, d).groupBy("unit").agg(F.count("verdict").alias("n"), F.array_sort(F.collect_set("verdict")).alias("v"))  # at most the known verdicts
    return out.filter((F.col("n") >= 2) & (F.size("v") > 1)).select("unit", "n", F.array_join("v", ",").alias("verdicts"))


@query("combine_latest", "select unit, max(rec_seq) as rec_seq, max_by(coalesce(verdict, ''), rec_seq) as verdict from rec group by 1", "rec")
def combine_latest(spark, d):
    """ST02, WN05: the last record of each unit over all batches."""
    r = views.records(spark, d).withColumn("verdict", F.coalesce("verdict", F.lit("")))
    return reconcile.latest(r.withColumn("s", F.col("rec_seq")), "unit", "s", ["rec_seq", "verdict"])


@query("combine_prefer_delivered", "select unit, max_by(rec_seq, (case when delivered then 1000000000000 else 0 end) + rec_seq) as rec_seq from rec group by 1", "rec")
def combine_prefer_delivered(spark, d):
    """WN05 with delivered replies before later undelivered ones."""
    r = views.records(spark, d)
    return reconcile.latest(r.withColumn("s", F.col("rec_seq")), "unit", "s", ["rec_seq"], delivered="delivered")


@query("ever_observed", "select model, count(distinct unit) as units from rec where verdict in ('COMPLETE', 'NO_ANSWER') group by 1", "rec")
def ever_observed(spark, d):
    """AG16, AG23."""
    return views.records(spark, d).filter(F.col("verdict").isin(*verdicts.SCOREABLE)).groupBy("model").agg(F.count_distinct("unit").alias("units"))


@query("run_tally", "select manifest_id, bench, arm, model, count(*) as answered, count(*) filter (verdict = 'COMPLETE') as complete, count(*) filter (verdict = 'NO_ANSWER') as no_answer, count(*) filter (verdict = 'TRUNCATED') as truncated, count(*) filter (verdict = 'UNDECIDED') as undecided from rec group by 1, 2, 3, 4", "rec")
def run_tally(spark, d):
    """AG35, AG32."""
    return views.records(spark, d).groupBy("manifest_id", "bench", "arm", "model").agg(
        F.count(F.lit(1)).alias("answered"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("COMPLETE", "NO_ANSWER", "TRUNCATED", "UNDECIDED")]
    )


@query("frequencies", "select coalesce(finish_reason, '-') as finish_reason, coalesce(verdict, '-') as verdict, count(*) as n from rec group by 1, 2", "rec")
def frequencies(spark, d):
    """AG12."""
    return views.records(spark, d).groupBy(F.coalesce("finish_reason", F.lit("-")).alias("finish_reason"), F.coalesce("verdict", F.lit("-")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# ---- money


@query("ledger_first_wins", "select attempt_id, min(entry_id) as entry_id, cast(round(min_by(actual, entry_id) * 10000000) as bigint) as actual_e7 from ledger group by 1")
def ledger_first_wins(spark, d):
    """SC16, WN06, SR03: replayed entries charge once."""
    return table(spark, d, "ledger").groupBy(ids.own_attempt(F.col("attempt_id")).alias("attempt_id")).agg(F.min("entry_id").alias("entry_id"), F.round(F.min_by("actual", "entry_id") * 10_000_000).cast("bigint").alias("actual_e7"))


_E7 = "led as (select *, cast(round(actual * 10000000) as bigint) as a7, case when estimated is not null and not isnan(estimated) then cast(round(estimated * 10000000) as bigint) end as e7 from (select *, row_number() over (partition by attempt_id order by entry_id) as rn from ledger) where rn = 1)"


def _ledger(spark, d):
    first = table(spark, d, "ledger").groupBy(ids.own_attempt(F.col("attempt_id")).alias("attempt_id")).agg(F.min_by(F.struct("entry_id", "model", "actual", "estimated", "batch_no"), "entry_id").alias("e"))
    e7 = lambda c: F.round(F.col(f"e.{c}") * 10_000_000).cast("bigint")
    return first.select("attempt_id", "e.entry_id", "e.model", "e.batch_no", e7("actual").alias("a7"), F.when(~F.isnan("e.estimated"), e7("estimated")).alias("e7"))


@query("ledger_reconcile", f"with {_E7} select model, count(*) as n, cast(sum(a7) as bigint) as actual_e7, cast(sum(e7) as bigint) as estimated_e7, sum(a7) filter (e7 is not null) / nullif(sum(e7), 0) as ratio from led group by 1")
def ledger_reconcile(spark, d):
    """AG20: what was charged against what was estimated; no ratio without an estimate."""
    out = _ledger(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("a7").alias("actual_e7"), F.sum("e7").alias("estimated_e7"), F.sum(F.when(F.col("e7").isNotNull(), F.col("a7"))).alias("known"))
    return out.withColumn("ratio", F.try_divide("known", "estimated_e7")).drop("known")


@query("running_spend", f"with {_E7}, r as (select *, sum(a7) over (order by entry_id) - a7 as b from led) select entry_id, cast(b as bigint) as spent_before_e7, b < 20000000 as admitted from r")
def running_spend(spark, d):
    """WN08: charges are admitted while the total before them is below the ceiling."""
    led = _ledger(spark, d)
    out = sequences.within_ceiling(led, "a7", [F.col("entry_id")], F.floor(F.col("entry_id") / 1000), 20_000_000)
    return out.select("entry_id", F.col("spent_before").cast("bigint").alias("spent_before_e7"), "admitted")


@query("billed_unledgered", "with a as (select attempt, max(cost_usd) as cost from rec where cost_usd > 0 group by 1) select attempt, cast(round(cost * 10000000) as bigint) as cost_e7 from a where attempt not in (select attempt_id from ledger where attempt_id is not null)", "rec")
def billed_unledgered(spark, d):
    """JN16: attempts that cost something and have no ledger entry."""
    billed = views.records(spark, d).filter("cost_usd > 0").groupBy("attempt").agg(F.max("cost_usd").alias("cost"))
    known = table(spark, d, "ledger").select(ids.own_attempt(F.col("attempt_id")).alias("attempt"))
    return billed.join(known, "attempt", "left_anti").select("attempt", F.round(F.col("cost") * 10_000_000).cast("bigint").alias("cost_e7"))


@query("record_costs", "select rec_seq, price_in is not null and price_out is not null as priced, (coalesce(usage.prompt_tokens, 0) * price_in + coalesce(usage.completion_tokens, 0) * price_out) / 1000000 as cost from records left join roster using (model)")
def record_costs(spark, d):
    """MF01, JN11: every record; a model without prices, or none on the roster, is not priced and has no cost rather than none to pay."""
    priced = F.col("price_in").isNotNull() & F.col("price_out").isNotNull()
    return table(spark, d, "records").join(table(spark, d, "roster").select("model", "price_in", "price_out"), "model", "left").select("rec_seq", priced.alias("priced"), scalars.token_cost(F.col("usage.prompt_tokens"), F.col("usage.completion_tokens"), F.col("price_in"), F.col("price_out")).alias("cost"))


@query("cost_ceilings", """select model, cap is null as uncapped, price_in is not null and price_out is not null as priced, (400 * price_in + coalesce(cap, context_tokens) * price_out) / 1000000 as highest_cost from roster""")
def cost_ceilings(spark, d):
    """MF02, JN12: the ceiling of one call, with the context as fallback for a missing cap; an unpriced model is kept and has no ceiling."""
    c = F.col
    return table(spark, d, "roster").select("model", c("cap").isNull().alias("uncapped"), (c("price_in").isNotNull() & c("price_out").isNotNull()).alias("priced"), scalars.highest_cost(F.coalesce("cap", "context_tokens"), c("price_in"), c("price_out")).alias("highest_cost"))


@query("context_fit", """select rec_seq, case when coalesce(cap, 0) = 0 or coalesce(context_tokens, 0) = 0 then cap else greatest(1, least(cap, context_tokens - (prompt_chars // 3 + 1) - 512)) end::bigint as servable from records left join roster using (model)""")
def context_fit(spark, d):
    """MF03: every record; a model off the roster has no ceiling."""
    return table(spark, d, "records").join(table(spark, d, "roster").select("model", "cap", "context_tokens"), "model", "left").select("rec_seq", scalars.servable_output(F.col("cap"), F.col("context_tokens"), F.col("prompt_chars")).alias("servable"))


@query("mean_tokens", "select coalesce(model, 'FLEET') as model, count(*) as calls, sum(usage.prompt_tokens) / count(*) as mean_in, sum(usage.completion_tokens) / count(*) as mean_out from records where usage.prompt_tokens > 0 and usage.completion_tokens > 0 group by rollup (model)")
def mean_tokens(spark, d):
    """AG21: per model and over all calls, not over models."""
    out = table(spark, d, "records").filter("usage.prompt_tokens > 0 and usage.completion_tokens > 0").rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("usage.prompt_tokens").alias("i"), F.sum("usage.completion_tokens").alias("o"))
    return out.select(F.coalesce("model", F.lit("FLEET")).alias("model"), "calls", (F.col("i") / F.col("calls")).alias("mean_in"), (F.col("o") / F.col("calls")).alias("mean_out"))


_MEANS = """m as (select model, sum(usage.prompt_tokens) / count(*) as mi, sum(usage.completion_tokens) / count(*) as mo from records where usage.prompt_tokens > 0 and usage.completion_tokens > 0 group by 1),
f as (select sum(usage.prompt_tokens) / count(*) as fi, sum(usage.completion_tokens) / count(*) as fo from records where usage.prompt_tokens > 0 and usage.completion_tokens > 0)"""


@query("cost_projection", f"with {_MEANS} select r.model, m.model is not null as measured, 1000 * ((coalesce(mi, fi) * price_in + coalesce(mo, fo) * price_out) / 1000000) as projected from roster r left join m using (model), f")
def cost_projection(spark, d):
    """AG22: a thousand calls at measured means; unmeasured models take the fleet's."""
    means = mean_tokens(spark, d)
    fleet = means.filter("model = 'FLEET'").select(F.col("mean_in").alias("fi"), F.col("mean_out").alias("fo"))
    joined = table(spark, d, "roster").join(means.filter("model <> 'FLEET'").withColumn("m", F.lit(True)), "model", "left").crossJoin(F.broadcast(fleet))  # one row
    return joined.select("model", F.col("m").isNotNull().alias("measured"), (1000 * scalars.token_cost(F.coalesce("mean_in", "fi"), F.coalesce("mean_out", "fo"), F.col("price_in"), F.col("price_out"))).alias("projected"))


@query("cost_concentration", f"with {_E7}, t as (select model, sum(a7) as s from led group by 1) select model, cast(s as bigint) as cost_e7, row_number() over (order by s desc, model) as place, s / sum(s) over () as share, sum(s) over (order by s desc, model) / sum(s) over () as running_share from t")
def cost_concentration(spark, d):
    """AG24: models by cost with running share; one row per model, so one window over all is small."""
    from pyspark.sql import Window

    per = _ledger(spark, d).groupBy("model").agg(F.sum("a7").alias("cost_e7"))
    all_ = Window.partitionBy(F.lit(1))
    by = all_.orderBy(F.desc("cost_e7"), "model").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("cost_e7").over(all_)
    return per.select("model", "cost_e7", F.row_number().over(all_.orderBy(F.desc("cost_e7"), "model")).cast("bigint").alias("place"), (F.col("cost_e7") / total).alias("share"), (F.sum("cost_e7").over(by) / total).alias("running_share"))
