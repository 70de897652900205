"""Queries on text, quality, sampling, sequences and profiles, registered with those of the evaluation."""

from __future__ import annotations

import difflib
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import ids
from ..functions import replies, scalars, verdicts
from ..operators import gates, ranking, sequences
from ..session import month_of, shared_folder, table
from ..sources import schema
from ..streaming import incremental
from . import views
from .evaluation import query

# ---- identity and scalars


@query("unit_ids", "select rec_seq, unit, attempt from rec", "rec")
def unit_ids(spark, d):
    """Identity of every record in own form (MF08, MF16)."""
    return views.records(spark, d).select("rec_seq", "unit", "attempt")


@query("prompt_hashes", "select u.manifest_id, u.unit, substr(sha256(i.prompt), 1, 16) as own_sha, u.prompt_sha = substr(sha256(i.prompt), 1, 16) as same from units u join items i using (item_id) where u.arm = 'original'", "units items")
def prompt_hashes(spark, d):
    """MF08, MF09: the hash of the item's prompt against the planned one; the native arm sends it unchanged."""
    own = ids.prompt_hash(F.col("prompt"))
    return views.units(spark, d).filter("arm = 'original'").join(views.items(spark, d).select("item_id", "prompt"), "item_id").select("manifest_id", "unit", own.alias("own_sha"), (F.col("prompt_sha") == own).alias("same"))


@query("key_drift", "select rec_seq, unit from rec where model is not null and unit <> substr(sha256(model || chr(0) || item_id || chr(0) || arm), 1, 16)", "rec")
def key_drift(spark, d):
    """DQ11: records whose unit is not the hash of their parts."""
    return views.records(spark, d).filter(F.col("unit") != ids.unit_hash(F.col("model"), F.col("item_id"), F.col("arm"))).select("rec_seq", "unit")


@query("monthly_calls", "select strftime(make_timestamp(cast(round(started_at * 1000000) as bigint)), '%Y-%m') as month, count(*) as n from records group by 1")
def monthly_calls(spark, d):
    """MF06: epoch seconds to months in UTC."""
    return table(spark, d, "records").groupBy(month_of(F.timestamp_micros(F.round(F.col("started_at") * 1_000_000).cast("bigint"))).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("providers", "select split_part(model, '/', 1) as provider, split_part(split_part(model, '/', 2), '-', 1) as family, count(*) as n from records group by 1, 2")
def providers(spark, d):
    """TX32."""
    name = F.substring_index(F.substring_index("model", "/", -1), "-", 1)
    return table(spark, d, "records").groupBy(F.substring_index("model", "/", 1).alias("provider"), name.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("fault_policies", """select case when classification like 'transport:%' then 'TRANSIENT' when http_status in (401, 402, 403) then 'TERMINAL_ACCOUNT'
    when http_status = 429 and regexp_matches(coalesce(error, ''), '(?i)budget|quota|credit|insufficient|spend|billing|payment|exceeded') and (retry_after_seen is null or isnan(retry_after_seen)) then 'TERMINAL_ACCOUNT'
    when http_status in (400, 404, 405, 412, 413, 422) then 'TERMINAL_REQUEST' else 'TRANSIENT' end as policy, coalesce(classification, '-') as classification, count(*) as n from faults group by 1, 2""")
def fault_policies(spark, d):
    """MF14."""
    c = F.col
    policy = scalars.fault_policy(c("http_status"), c("error_type"), c("error"), c("retry_after_seen"), F.coalesce(c("classification").startswith("transport:"), F.lit(False)))
    return table(spark, d, "faults").groupBy(policy.alias("policy"), F.coalesce("classification", F.lit("-")).alias("classification")).agg(F.count(F.lit(1)).alias("n"))


@query("gold_values")
def gold_values(spark, d):
    """MF15: ground truths, list literals or single values, one row per value."""
    return views.items(spark, d).filter("ground_truth is not null").select("item_id", F.posexplode(scalars.list_literal(F.col("ground_truth"))).alias("pos", "value"))


# ---- replies


@query("boxed_parse", r"""with b as (select rec_seq, regexp_extract_all(coalesce(text, ''), '\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}', 1) as x from records)
    select rec_seq, len(x) as n_boxes, regexp_replace(x[len(x)], '^\s+|\s+$', '', 'g') as raw_box, len(x) > 0 as compliant from b""")
def boxed_parse(spark, d):
    """TX01."""
    return table(spark, d, "records").select("rec_seq", replies.boxed(F.col("text")).alias("b")).select("rec_seq", F.col("b.n_boxes").cast("bigint").alias("n_boxes"), "b.raw_box", "b.compliant")


@query("boxed_answers", r"""with b as (select rec_seq, regexp_extract_all(coalesce(text, ''), '\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}', 1) as x from records),
    p as (select rec_seq, list_filter(list_transform(string_split(x[len(x)], ','), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') as a from b where len(x) > 0)
    select rec_seq, unnest(a) as answer from p""")
def boxed_answers(spark, d):
    """TX01, TX15: the parts of the last box."""
    return table(spark, d, "records").select("rec_seq", F.explode(replies.boxed(F.col("text"))["answer"]).alias("answer"))


@query("closing_probability")
def closing_probability(spark, d):
    """TX02: lookbehinds keep this from having an oracle in SQL; it is tested against a plain version."""
    return table(spark, d, "records").select("rec_seq", replies.closing_probability(F.col("text")).alias("p")).select("rec_seq", "p.*")


@query("loose_probability")
def loose_probability(spark, d):
    """TX03."""
    return table(spark, d, "records").select("rec_seq", replies.loose_probability(F.col("text")).alias("prob"))


@query("answer_lines")
def answer_lines(spark, d):
    """TX04 to TX06, TX10: the last lines, cleaned, last first."""
    return table(spark, d, "records").select("rec_seq", F.posexplode(replies.answer_lines(F.col("text"))).alias("pos", "line"))


@query("chain_steps", r"""select rec_seq, case when n > 0 then n else len(list_filter(string_split(t, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g') <> '')) end as steps
    from (select rec_seq, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '(?im)^\s*(?:step\s*)?\d+[.):]')) as n from records)""")
def chain_steps(spark, d):
    """TX09."""
    return table(spark, d, "records").select("rec_seq", replies.chain_steps(F.col("text")).cast("bigint").alias("steps"))


@query("answer_types", r"""select item_id, case when regexp_matches(prompt, '(?i)\\boxed\{\s*Yes\s*\}\s*or\s*\\boxed\{\s*No\s*\}') then 'binary' when len(o) >= 2 then 'multiple_choice' else 'free_text' end as kind, array_to_string(o, '') as options
    from (select item_id, prompt, list_sort(list_distinct(regexp_extract_all(prompt, '(?m)^\s*([A-Z])[.)]\s+\S', 1))) as o from items)""", "items")
def answer_types(spark, d):
    """TX11, TX12."""
    p = F.col("prompt")
    return views.items(spark, d).select("item_id", replies.answer_type(p).alias("kind"), F.array_join(replies.options_offered(p), "").alias("options"))


@query("interpreted_answers")
def interpreted_answers(spark, d):
    """TX13: whether the recorded box answers its item's question, with which value, and why not."""
    boxed = table(spark, d, "records").filter("bench = 'futurex' and parsed.n_boxes > 0").select("rec_seq", "item_id", "parsed.raw_box")
    return boxed.join(views.items(spark, d).select("item_id", "prompt"), "item_id").select("rec_seq", replies.interpreted(F.col("raw_box"), F.col("prompt")).alias("i")).select("rec_seq", "i.*")


@query("interpreted_probabilities", """select rec_seq, 'probability' as kind, coalesce(p between 0 and 1, false) as interpretable, p as value, case when p is null then 'none' when p not between 0 and 1 then 'outside' end as why
    from (select rec_seq, case when isnan(parsed.prob) then null else parsed.prob end as p from records where bench = 'btf3')""")
def interpreted_probabilities(spark, d):
    """TX14: whether a forecast's figure can be scored; forecasts are the records of this benchmark."""
    prob = F.when(~F.isnan("parsed.prob"), F.col("parsed.prob"))
    return table(spark, d, "records").filter("bench = 'btf3'").select("rec_seq", replies.interpreted_probability(prob).alias("i")).select("rec_seq", "i.*")


@query("reader_overruled")
def reader_overruled(spark, d):
    """TX24: the verdicts of readers, and what stands of them once the facts have been heard."""
    c = F.col
    r = views.records(spark, d).filter("completeness_by in ('layer2', 'layer1-deferred') and verdict is not null")
    return r.select("rec_seq", c("verdict").alias("said"), replies.reconciled(c("verdict"), c("text"), c("bench"), c("finish_reason")).alias("stands")).withColumn("overruled", c("said") != c("stands"))


@query("verdict_vocabulary", """select verdict, verdict in ('COMPLETE', 'NO_ANSWER', 'TRUNCATED', 'PROVIDER_ERROR', 'TRANSPORT_ERROR', 'SCHEMA_ERROR', 'UNDECIDED', 'EMPTY_HTTP', 'EMPTY_PARSE', 'EMPTY_CONFLICT', 'BUDGET_CAPPED') as known, count(*) as n from rec where verdict is not null group by 1""", "rec")
def verdict_vocabulary(spark, d):
    """PF09: each verdict that occurs, and whether the vocabulary has it; delivered() refuses one that it has not."""
    r = table(spark, d, "records").select(verdicts.current(F.col("completeness")).alias("verdict")).filter("verdict is not null")
    return r.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("verdict").isin(*verdicts.KNOWN))


@query("completeness_verdicts")
def completeness_verdicts(spark, d):
    """TX15 to TX17: the verdict from facts, in the order of its rules."""
    c = F.col
    return table(spark, d, "records").select("rec_seq", replies.completeness_verdict(c("text"), c("bench"), c("finish_reason"), c("usage")).alias("verdict"))


@query("stamp_drift")
def stamp_drift(spark, d):
    """DQ06, TX25: stored verdicts against those the facts give, where a reader left the rules alone."""
    c = F.col
    rederived = replies.completeness_verdict(c("text"), c("bench"), c("finish_reason"), c("usage"))
    r = views.records(spark, d).filter("completeness_by = 'layer1'").select(F.coalesce("verdict", F.lit("-")).alias("stored"), rederived.alias("rederived"))
    return r.groupBy("stored", "rederived").agg(F.count(F.lit(1)).alias("n"))


@query("ends_with_answer")
def ends_with_answer(spark, d):
    """TX18, TX22."""
    return table(spark, d, "records").select("rec_seq", replies.ends_with_answer(F.col("text")).alias("ends"))


@query("reasoning_sources", """select rec_seq, case when f <> '' and l then 'both' when f <> '' then 'reasoning_field' when l then 'visible_prose' else 'none' end as source, greatest(length(f), case when l then length(p) else 0 end) as chars
    from (select rec_seq, f, p, length(p) >= 120 as l from (select rec_seq, trim(coalesce(reasoning, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as f, trim(split_part(coalesce(text, ''), chr(92) || 'boxed', 1), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as p from records))""")
def reasoning_sources(spark, d):
    """TX19."""
    e = replies.reasoning_evidence(F.col("text"), F.col("reasoning"))
    return table(spark, d, "records").select("rec_seq", e.alias("e")).select(
        "rec_seq", F.when(F.size("e.source") == 2, "both").otherwise(F.coalesce(F.get("e.source", F.lit(0)), F.lit("none"))).alias("source"), F.col("e.chars").cast("bigint").alias("chars")
    )


@query("empty_cross_check", """select coalesce(finish_reason, '-') as finish_reason, coalesce(completion_tokens, 0) > 0 as billed, coalesce(length(reasoning), 0) > 0 as reasoned, count(*) as n from records where trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' group by 1, 2, 3""")
def empty_cross_check(spark, d):
    """TX21: empty replies against what was billed and reasoned."""
    r = table(spark, d, "records").filter(replies.stripped(F.coalesce("text", F.lit(""))) == "")
    return r.groupBy(F.coalesce("finish_reason", F.lit("-")).alias("finish_reason"), (F.coalesce("completion_tokens", F.lit(0)) > 0).alias("billed"), (F.coalesce(F.length("reasoning"), F.lit(0)) > 0).alias("reasoned")).agg(F.count(F.lit(1)).alias("n"))


@query("reply_classes")
def reply_classes(spark, d):
    """TX26 over the probability replies."""
    r = table(spark, d, "records").filter("bench = 'btf3'")
    return r.groupBy("arm", replies.reply_class(F.col("text"), F.col("finish_reason")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("choice_verdicts")
def choice_verdicts(spark, d):
    """TX07, TX08: option replies scored against the gold letter."""
    gold = views.items(spark, d).filter("bench = 'futurex'").select("item_id", F.get(scalars.list_literal(F.col("ground_truth")), F.lit(0)).alias("gold"))
    kind = F.when(F.col("gold").rlike("^[A-D]$"), "mcq").when(F.col("gold").rlike("^-?[0-9]+$"), "integer").otherwise("exact")
    r = table(spark, d, "records").select("rec_seq", "item_id", "text", "finish_reason").join(gold, "item_id")
    return r.select("rec_seq", kind.alias("kind"), replies.choice_verdict(kind, F.col("gold"), F.col("text"), F.col("finish_reason")).alias("v")).select("rec_seq", "kind", "v.*")


@query("arm_prompts", """select item_id, replace(prompt, 'The last thing you write', 'Reason step by step first.' || chr(10) || chr(10) || 'The last thing you write') as cot_prompt, contains(prompt, 'The last thing you write') as has_marker from items where bench = 'btf3'""", "items")
def arm_prompts(spark, d):
    """TX28: an arm's prompt by insertion before its marker; a missing marker is reported."""
    marker = F.lit("The last thing you write")
    return views.items(spark, d).filter("bench = 'btf3'").select(
        "item_id", F.replace("prompt", marker, F.concat(F.lit("Reason step by step first.\n\n"), marker)).alias("cot_prompt"), F.contains("prompt", marker).alias("has_marker")
    )


@query("tail_prompts", "select rec_seq, '[…] ' || right(text, 300) as tail from records where length(text) > 300")
def tail_prompts(spark, d):
    """TX31: the end of a reply for a reader, marked as such."""
    return table(spark, d, "records").filter(F.length("text") > 300).select("rec_seq", F.concat(F.lit("[…] "), F.right("text", F.lit(300))).alias("tail"))


@query("midsentence_cuts", """select rec_seq, substr(text, 1, greatest(1, cast(length(text) * (40 + rec_seq % 50) // 100 as bigint))) as cut from records where length(text) >= 200 and finish_reason = 'stop'""")
def midsentence_cuts(spark, d):
    """TX30: reproducibly cut replies, to test truncation readers."""
    at = F.greatest(F.lit(1), F.floor(F.length("text") * (40 + F.col("rec_seq") % 50) / 100)).cast("int")
    return table(spark, d, "records").filter((F.length("text") >= 200) & (F.col("finish_reason") == "stop")).select("rec_seq", F.substring("text", F.lit(1), at).alias("cut"))


@query("refusal_mining", r"""select rec_seq, length(text) as chars from records where length(text) between 1 and 400 and not regexp_matches(text, '\\boxed') and regexp_matches(text, '(?i)\b(cannot|can''t|unable|decline)\b')""")
def refusal_mining(spark, d):
    """PF15."""
    t = F.col("text")
    return table(spark, d, "records").filter(F.length(t).between(1, 400) & ~F.contains(t, F.lit("\\boxed")) & t.rlike(r"(?i)\b(cannot|can't|unable|decline)\b")).select("rec_seq", F.length(t).cast("bigint").alias("chars"))


@query("usable_sources", "select rec_seq from records where ok and compliant and length(text) > 200 and coalesce(usage.prompt_tokens, 0) > 0")
def usable_sources(spark, d):
    """PF12."""
    return table(spark, d, "records").filter("ok and compliant and length(text) > 200 and coalesce(usage.prompt_tokens, 0) > 0").select("rec_seq")


@query("suspicious_lengths", "select model, count(*) filter (completion_tokens > 12000) as n_long, max(completion_tokens) as most from records group by 1")
def suspicious_lengths(spark, d):
    """PF14: an observation only."""
    return table(spark, d, "records").groupBy("model").agg(F.count_if(F.col("completion_tokens") > 12000).alias("n_long"), F.max("completion_tokens").alias("most"))


# ---- items: filters, strata, rules, balance, draws


@query("anchor_filter", "select item_id from items where substr(end_time, 1, 10) >= '2026-02-16'", "items")
def anchor_filter(spark, d):
    """PF10, MF07: dates are compared as text, so mixed forms stay as they compare."""
    return views.items(spark, d).filter(F.substring("end_time", 1, 10) >= views.ANCHOR).select("item_id")


@query("eligible_items", "select item_id from items where field_chars <= 3000", "items")
def eligible_items(spark, d):
    """PF11: whole items within the length limit; nothing is cut to fit."""
    return views.items(spark, d).filter("field_chars <= 3000").select("item_id")


@query("length_bands", """with q as (select quantile_cont(prompt_chars, 1.0 / 3) as a, quantile_cont(prompt_chars, 2.0 / 3) as b from items where bench = 'btf3')
    select item_id, cast(prompt_chars > a as int) + cast(prompt_chars > b as int) as band, 'o' || outcome || '-L' || (cast(prompt_chars > a as int) + cast(prompt_chars > b as int)) as stratum from items, q where bench = 'btf3'""", "items")
def length_bands(spark, d):
    """AG27, WN07, PF17: tertile cuts, the band as the number of cuts exceeded, and the stratum."""
    x = views.items(spark, d).filter("bench = 'btf3'")
    cuts = x.agg(F.percentile("prompt_chars", 1 / 3).alias("a"), F.percentile("prompt_chars", 2 / 3).alias("b"))  # one row
    band = (F.col("prompt_chars") > F.col("a")).cast("int") + (F.col("prompt_chars") > F.col("b")).cast("int")
    return x.crossJoin(F.broadcast(cuts)).select("item_id", band.alias("band"), F.concat(F.lit("o"), "outcome", F.lit("-L"), band).alias("stratum"))


@query("rule_violations", r"""select item_id, rule from (
    select item_id, 'prompt_empty' as rule from bench_items where regexp_replace(prompt, '^\s+|\s+$', '', 'g') = '' union all
    select item_id, 'answer_leaked' from bench_items where bench = 'btf3' and regexp_matches(prompt, '\*\s*(0?\.\d+|0|1(?:\.0+)?)\s*\*') union all
    select item_id, 'template_unfilled' from bench_items where regexp_matches(prompt, '\{\{?[a-z_]+\}?\}') union all
    select item_id, 'end_time_before_anchor' from bench_items where substr(end_time, 1, 10) < '2026-02-16' union all
    select item_id, 'level_missing' from bench_items where bench = 'futurex' and item_level is null union all
    select item_id, 'stratum_missing' from bench_items where bench = 'btf3' and coalesce(stratum, '') = '' union all
    select item_id, 'item_id_duplicate' from bench_items group by item_id having count(*) > 1)""")
def rule_violations(spark, d):
    """DQ01, DQ02, TX29: rules per item and the rule over all of them."""
    c = F.col
    rules = {
        "prompt_empty": replies.stripped(c("prompt")) == "",
        "answer_leaked": (c("bench") == "btf3") & c("prompt").rlike(r"\*\s*(0?\.\d+|0|1(?:\.0+)?)\s*\*"),
        "template_unfilled": c("prompt").rlike(r"\{\{?[a-z_]+\}?\}"),
        "end_time_before_anchor": F.substring("end_time", 1, 10) < views.ANCHOR,
        "level_missing": (c("bench") == "futurex") & c("item_level").isNull(),
        "stratum_missing": (c("bench") == "btf3") & (F.coalesce(c("stratum"), F.lit("")) == ""),
    }
    return gates.violations(table(spark, d, "bench_items"), "item_id", rules)


_DRAW = "draw as (select * from items where bench = 'btf3' and stratum is not null order by sha256('draw:' || item_id), item_id limit 100)"


def _draw(spark, d):
    pool = views.items(spark, d).filter("bench = 'btf3' and stratum is not null")
    return pool, ranking.hash_draw(pool, 100, "draw", "item_id")


@query("hash_draw", f"with {_DRAW} select item_id, stratum from draw", "items")
def hash_draw(spark, d):
    """SA01: a draw that no partitioning changes."""
    return _draw(spark, d)[1].select("item_id", "stratum")


@query("nested_draw", f"with {_DRAW} select item_id from draw order by sha256('slice:' || item_id), item_id limit 20", "items")
def nested_draw(spark, d):
    """SA02: a slice of the draw, so a smaller study is part of the larger one."""
    return ranking.hash_draw(_draw(spark, d)[1], 20, "slice", "item_id").select("item_id")


@query("balance_gate", f"""with {_DRAW}, p as (select stratum, count(*) as n from items where bench = 'btf3' and stratum is not null group by 1), q as (select stratum, count(*) as n from draw group by 1)
    select p.stratum, p.n / (select sum(n) from p) as pool_share, coalesce(q.n / (select sum(n) from q), 0) as draw_share, abs(coalesce(q.n / (select sum(n) from q), 0) - p.n / (select sum(n) from p)) <= 0.1 as balanced from p left join q using (stratum)""", "items")
def balance_gate(spark, d):
    """AG36."""
    pool, draw = _draw(spark, d)
    return gates.balanced(pool, draw, "stratum", 0.1)


@query("reproduced_draw", f"""with {_DRAW}, again as (select item_id from items where bench = 'btf3' and stratum is not null order by sha256('draw:' || item_id), item_id limit 80)
    select count(*) as drawn, count(a.item_id) as common from draw left join again a using (item_id)""", "items")
def reproduced_draw(spark, d):
    """ST05: two draws with one seed are nested; their overlap is reported."""
    pool, draw = _draw(spark, d)
    again = ranking.hash_draw(pool, 80, "draw", "item_id").select("item_id", F.lit(True).alias("again"))
    return draw.join(again, "item_id", "left").agg(F.count(F.lit(1)).alias("drawn"), F.count("again").alias("common"))


@query("labelled_classes", """select verdict, rec_seq from (select verdict, rec_seq, row_number() over (partition by verdict order by sha256('gt:' || rec_seq), rec_seq) as rn from rec where verdict in ('COMPLETE', 'TRUNCATED', 'NO_ANSWER') and length(text) > 0)
    where rn <= case verdict when 'NO_ANSWER' then 10 else 25 end""", "rec")
def labelled_classes(spark, d):
    """SA03: a ground-truth set with exact class sizes, by hash order; top-n per class is pruned before the exchange."""
    r = views.records(spark, d).filter(F.col("verdict").isin("COMPLETE", "TRUNCATED", "NO_ANSWER") & (F.length("text") > 0)).select("verdict", "rec_seq", ranking.hash_order("gt", F.col("rec_seq")).alias("h"))
    top = r.withColumn("rn", F.row_number().over(Window.partitionBy("verdict").orderBy("h", "rec_seq"))).filter("rn <= 25")
    return top.filter((F.col("verdict") != "NO_ANSWER") | (F.col("rn") <= 10)).select("verdict", "rec_seq")


@query("set_hashes", """select bench, sha256(string_agg(digest, '' order by chunk)) as items_hash, cast(sum(n) as bigint) as n from (
    select bench, substr(sha256(item_id), 1, 3) as chunk, sha256(string_agg(item_id, ',' order by item_id)) as digest, count(*) as n from items group by 1, 2) group by 1""", "items")
def set_hashes(spark, d):
    """AG28: a hash that names a set of ids, whatever their order: a digest over the digests of 4,096 chunks, so no task holds the whole set."""
    chunk = F.substring(F.sha2("item_id", 256), 1, 3)
    parts = views.items(spark, d).groupBy("bench", chunk.alias("chunk")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"])
    return parts.groupBy("bench").agg(F.sha2(F.array_join(whole, ""), 256).alias("items_hash"), F.sum("n").alias("n"))


@query("effective_questions", "select bench, count(*) as clusters, cast(sum(n) as bigint) as items, cast(round(sum(n * log2(n + 1) / (n + 1)) * 1000) as bigint) as effective_e3 from (select bench, substr(end_time, 1, 7) as m, count(*) as n from items group by 1, 2) group by 1", "items")
def effective_questions(spark, d):
    """AG37: the correlated groups of items, and the effective number of questions: each of N weighs log2(N + 1) / (N + 1)."""
    n = F.col("n")
    return views.items(spark, d).groupBy("bench", F.substring("end_time", 1, 7).alias("m")).agg(F.count(F.lit(1)).alias("n")).groupBy("bench").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("items"), F.round(F.sum(n * F.log2(n + 1) / (n + 1)) * 1000).cast("bigint").alias("effective_e3")
    )


@query("committee", "select item_id, arm, count(bp) as votes, sum(bp) / (count(bp) * 100) as mean_forecast, count(*) filter (bp >= 50) * 2 > count(bp) as majority_yes from (select item_id, arm, cast(round(parsed.prob * 100) as bigint) as bp from records where parsed.prob is not null) group by 1, 2")
def committee(spark, d):
    """AG38 (an extension): mean and majority of all models on an item."""
    r = table(spark, d, "records").filter("parsed.prob is not null").select("item_id", "arm", F.round(F.col("parsed.prob") * 100).cast("bigint").alias("bp"))
    return r.groupBy("item_id", "arm").agg(F.count("bp").alias("votes"), (F.sum("bp") / (F.count("bp") * 100)).alias("mean_forecast"), (F.count_if(F.col("bp") >= 50) * 2 > F.count("bp")).alias("majority_yes"))


# ---- claims, profiles, acceptance

_CLAIM = ["text", "usage", "finish_reason", "completeness", "prompt_sha"]


@query("claim_gate", """select gap, count(*) as n from (select unnest(list_filter([case when coalesce(text, '') = '' then 'text' end, case when usage is null then 'usage' end, case when coalesce(finish_reason, '') = '' then 'finish_reason' end,
    case when coalesce(completeness, '') = '' then 'completeness' end, case when coalesce(prompt_sha, '') = '' then 'prompt_sha' end], lambda x: x is not null)) as gap from records) group by 1""")
def claim_gate(spark, d):
    """PF06, PF07, AG13: what keeps records out of a claim, field by field."""
    _, rejected = gates.admit(table(spark, d, "records"), _CLAIM)
    return rejected.select(F.explode("gaps").alias("gap")).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


@query("claim_admitted", "select rec_seq from records where coalesce(text, '') <> '' and usage is not null and coalesce(finish_reason, '') <> '' and coalesce(completeness, '') <> '' and coalesce(prompt_sha, '') <> ''")
def claim_admitted(spark, d):
    """PF07: the records a claim may speak of."""
    return gates.admit(table(spark, d, "records"), _CLAIM)[0].select("rec_seq")


_PROBES = ["completeness", "error", "failure_class", "finish_reason", "provider", "reasoning", "text", "usage"]


@query("schema_signatures", """select array_to_string(list_filter([case when coalesce(completeness, '') <> '' then 'completeness' end, case when coalesce(error, '') <> '' then 'error' end, case when coalesce(failure_class, '') <> '' then 'failure_class' end,
    case when coalesce(finish_reason, '') <> '' then 'finish_reason' end, case when coalesce(provider, '') <> '' then 'provider' end, case when coalesce(reasoning, '') <> '' then 'reasoning' end, case when coalesce(text, '') <> '' then 'text' end,
    case when usage is not null then 'usage' end], lambda x: x is not null), ',') as signature, count(*) as n from records group by 1""")
def schema_signatures(spark, d):
    """AG14: records grouped by which probe fields they carry."""
    r = table(spark, d, "records")
    sig = F.array_join(F.array_compact(F.array(*[F.when(gates.present(r, f), f) for f in _PROBES])), ",")
    return r.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query("field_presence", "select batch_no, bool_and(text is not null and text <> '') as all_text, bool_or(error is not null and error <> '') as any_error, bool_and(usage is not null) as all_usage from records group by 1")
def field_presence(spark, d):
    """AG15: per load batch, whether a field is always or ever there."""
    r = table(spark, d, "records")
    return r.groupBy("batch_no").agg(F.bool_and(gates.present(r, "text")).alias("all_text"), F.bool_or(gates.present(r, "error")).alias("any_error"), F.bool_and(gates.present(r, "usage")).alias("all_usage"))


@query("invariants", """select rule, count(*) as n from (select unnest(list_filter([case when compliant is not null and (verdict is null or verdict not in ('COMPLETE', 'NO_ANSWER')) then 'compliance_without_observation' end, case when verdict = 'COMPLETE' and compliant is not true then 'complete_not_compliant' end,
    case when verdict is null then 'verdict_missing' end, case when verdict = 'NO_ANSWER' and compliant then 'no_answer_compliant' end], lambda x: x is not null)) as rule from rec) group by 1""", "rec")
def invariants(spark, d):
    """DQ03, DQ05: records that contradict themselves."""
    v, c = F.col("verdict"), F.col("compliant")
    rules = {
        "compliance_without_observation": c.isNotNull() & ~F.coalesce(v.isin(*verdicts.SCOREABLE), F.lit(False)), "complete_not_compliant": (v == "COMPLETE") & ~F.coalesce(c, F.lit(False)),
        "verdict_missing": v.isNull(), "no_answer_compliant": (v == "NO_ANSWER") & c,
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in rules.items()]))
    return views.records(spark, d).select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("acceptance", """with s as (select count(*) as n, count(*) filter (delivered) as d, count(*) filter (verdict = 'COMPLETE') as c, count(distinct attempt) as a, count(usage) as u from rec)
    select 'delivered' as criterion, case when n = 0 then 'UNKNOWN' when d >= 0.9 * n then 'PASS' else 'FAIL' end as outcome from s union all select 'complete', case when n = 0 then 'UNKNOWN' when c >= 0.6 * n then 'PASS' else 'FAIL' end from s
    union all select 'once_each', case when n = 0 then 'UNKNOWN' when a = n then 'PASS' else 'FAIL' end from s union all select 'usage', case when u = 0 then 'UNKNOWN' when u >= 0.95 * n then 'PASS' else 'FAIL' end from s""", "rec")
def acceptance(spark, d):
    """DQ04: each criterion passes, fails or is unknown; unknown is not a pass."""
    s = views.records(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if("delivered").alias("d"), F.count_if(F.col("verdict") == "COMPLETE").alias("c"), F.count_distinct("attempt").alias("a"), F.count("usage").alias("u"))
    n = F.col("n")
    outcome = lambda known, ok: F.when(~known, "UNKNOWN").when(ok, "PASS").otherwise("FAIL")
    rows = [("delivered", n > 0, F.col("d") >= 0.9 * n), ("complete", n > 0, F.col("c") >= 0.6 * n), ("once_each", n > 0, F.col("a") == n), ("usage", F.col("u") > 0, F.col("u") >= 0.95 * n)]
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), outcome(a, b).alias("outcome")) for k, a, b in rows])).alias("x")).select("x.*")


@query("denominator_loss", """with s as (select model, count(*) as n, count(*) filter (verdict in ('COMPLETE', 'NO_ANSWER')) as o from rec group by 1) select model, (n - o) / n as loss, (n - o) / n > 0.34 as too_much from s order by loss desc, model limit 3""", "rec")
def denominator_loss(spark, d):
    """AG29, SO04: the models that lose most of their denominator."""
    s = views.records(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict").isin(*verdicts.SCOREABLE)).alias("o"))
    loss = (F.col("n") - F.col("o")) / F.col("n")
    return s.select("model", loss.alias("loss"), (loss > 0.34).alias("too_much")).orderBy(F.desc("loss"), "model").limit(3)


@query("coverage_overall", "select count(*) as n, count(*) filter (verdict in ('COMPLETE', 'NO_ANSWER')) as observed, count(*) filter (verdict in ('COMPLETE', 'NO_ANSWER')) >= 0.95 * count(*) as enough from rec", "rec")
def coverage_overall(spark, d):
    """AG29: whether the records as a whole are observed well enough for a rate over them."""
    observed = F.count_if(F.col("verdict").isin(*verdicts.SCOREABLE))
    return views.records(spark, d).agg(F.count(F.lit(1)).alias("n"), observed.alias("observed"), (observed >= 0.95 * F.count(F.lit(1))).alias("enough"))


@query("reasoning_rate", "with s as (select model, count(*) as n, count(*) filter (length(text) >= 120) as k from records where ok group by 1) select model, n, k, k / n as rate from s")
def reasoning_rate(spark, d):
    """DQ07: replies long enough to hold reasoning, by whole text."""
    s = table(spark, d, "records").filter("ok").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") >= 120).alias("k"))
    return s.withColumn("rate", scalars.share(F.col("k"), F.col("n")))


@query("wilson_floors", """with s as (select model, count(*) filter (compliant) as k, count(compliant) as n from records group by 1),
    u as (select model, k, n, case when n > 0 then (k / n + 3.8415999999999997 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8415999999999997 / (4 * n)) / n)) / (1 + 3.8415999999999997 / n) end as low from s)
    select model, k, n, low > 0.5 as above_half, cast(round(low * 1000000000) as bigint) as low_e9 from u""")
def wilson_floors(spark, d):
    """AG25: the lower end of the 95 % interval, in units of 1e-9, and whether it is above one half."""
    s = table(spark, d, "records").groupBy("model").agg(F.count_if("compliant").alias("k"), F.count("compliant").alias("n"))
    low = scalars.wilson_floor(F.col("k"), F.col("n"))
    return s.select("model", "k", "n", (low > 0.5).alias("above_half"), F.round(low * 1_000_000_000).cast("bigint").alias("low_e9"))


@query("index_percentiles", "select model, x[len(x) // 2 + 1] as p50_ms, x[cast(floor(len(x) * 0.95) as bigint) + 1] as p95_ms, x[len(x)] as most_ms from (select model, list_sort(list(ms)) as x from (select model, cast(round(duration_s * 1000) as bigint) as ms from records) where ms is not null group by 1)")
def index_percentiles(spark, d):
    """AG26: percentiles by index into the sorted values, taken from ranks, so no list is gathered."""
    rows = table(spark, d, "records").filter("duration_s is not null").select("model", F.round(F.col("duration_s") * 1000).cast("bigint").alias("ms"))
    per = rows.groupBy("model", "ms").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("model").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy("model"))
    ranked = per.withColumn("upto", upto).withColumn("n", n)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("ms")))
    return ranked.groupBy("model").agg(at(F.floor(F.col("n") / 2)).alias("p50_ms"), at(F.floor(F.col("n") * 0.95)).alias("p95_ms"), F.max("ms").alias("most_ms"))


@query("reader_scores", "select arm, count(*) filter (said and was) / nullif(count(*) filter (was), 0) as recall, count(*) filter (not said and not was) / nullif(count(*) filter (not was), 0) as specificity, count(*) filter (said and not was) as false_positives from (select arm, verdict = 'TRUNCATED' as said, finish_reason = 'length' as was from rec where verdict is not null and finish_reason is not null) group by 1", "rec")
def reader_scores(spark, d):
    """AG30: the reader's truncation verdicts against the provider's stop signal."""
    r = views.records(spark, d).filter("verdict is not null and finish_reason is not null").select("arm", (F.col("verdict") == "TRUNCATED").alias("said"), (F.col("finish_reason") == "length").alias("was"))
    s, w = F.col("said"), F.col("was")
    return r.groupBy("arm").agg(scalars.share(F.count_if(s & w), F.count_if(w)).alias("recall"), scalars.share(F.count_if(~s & ~w), F.count_if(~w)).alias("specificity"), F.count_if(s & ~w).alias("false_positives"))


@query("reader_disagreement", "select completeness_by, count(*) as n, count(*) filter (scoreable is distinct from (verdict in ('COMPLETE', 'NO_ANSWER'))) as differing from rec where verdict is not null group by 1", "rec")
def reader_disagreement(spark, d):
    """AG31: stored flags against what their verdict means, per reader."""
    r = views.records(spark, d).filter("verdict is not null")
    return r.groupBy("completeness_by").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("scoreable").eqNullSafe(F.col("verdict").isin(*verdicts.SCOREABLE))).alias("differing"))


@query("budget_probe", "select model, count(*) as n, count(*) filter (finish_reason = 'length') as capped, min(chars) filter (finish_reason = 'stop') as least, cast(median(chars) filter (finish_reason = 'stop') as double) as mid, max(chars) filter (finish_reason = 'stop') as most from records group by 1")
def budget_probe(spark, d):
    """AG33."""
    done = F.when(F.col("finish_reason") == "stop", F.col("chars"))
    r = table(spark, d, "records").select("model", "finish_reason", done.alias("done"))
    out = r.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("finish_reason") == "length").alias("capped"), F.min("done").alias("least"), F.max("done").alias("most"))
    return out.join(ranking.exact_median(r, ["model"], "done", "mid"), "model", "left")


@query("retry_ledger", "select coalesce(b.finish_reason, '-') as finish_reason, count(*) as tries, count(distinct rec_seq) as n_records, sum(b.completion_tokens)::bigint as tokens from (select rec_seq, unnest(budget_trace) as b from records) group by 1")
def retry_ledger(spark, d):
    """AG34: every try behind a record."""
    return table(spark, d, "records").select("rec_seq", F.explode("budget_trace").alias("b")).groupBy(F.coalesce("b.finish_reason", F.lit("-")).alias("finish_reason")).agg(F.count(F.lit(1)).alias("tries"), F.count_distinct("rec_seq").alias("n_records"), F.sum("b.completion_tokens").alias("tokens"))


@query("top_rates", "with s as (select model, count(*) filter (compliant) / nullif(count(compliant), 0) as rate from records group by 1) select model, rate from s order by rate desc nulls last, model limit 10")
def top_rates(spark, d):
    """SO01: best rates first, models without one last."""
    s = table(spark, d, "records").groupBy("model").agg(scalars.share(F.count_if("compliant"), F.count("compliant")).alias("rate"))
    return s.orderBy(F.desc_nulls_last("rate"), "model").limit(10)


@query("longest_truncated", "select rec_seq, chars from records where finish_reason = 'length' order by chars desc nulls last, rec_seq limit 20")
def longest_truncated(spark, d):
    """SO03, SO06."""
    return table(spark, d, "records").filter("finish_reason = 'length'").orderBy(F.desc_nulls_last("chars"), "rec_seq").limit(20).select("rec_seq", "chars")


@query("roster_order", "select row_number() over (order by coalesce(cutoff, ''), series, model) as pos, model from roster")
def roster_order(spark, d):
    """SO02, SO05: a fixed list by several keys."""
    return table(spark, d, "roster").select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.coalesce("cutoff", F.lit("")), "series", "model")).cast("bigint").alias("pos"), "model")


# ---- orders, runs, overlaps

_SPREAD = """r as (select unit, split_part(model, '/', 1) as provider, row_number() over (partition by split_part(model, '/', 1) order by sha256('spread:' || unit), unit) as rk, count(*) over (partition by split_part(model, '/', 1)) as n from plan),
s as (select unit, provider, row_number() over (order by floor(cast(2 * rk - 1 as double) * 1e9 / cast(2 * n as double)), provider, unit) as pos from r)"""


def _spread(spark, d):
    rows = views.plan(spark, d).select("unit", F.substring_index("model", "/", 1).alias("provider"))
    return sequences.even_spread(rows, "provider", "unit", "spread")


@query("even_spread", f"with {_SPREAD} select unit, provider, pos from s", "plan")
def even_spread(spark, d):
    """WN02."""
    return _spread(spark, d)


@query("longest_runs", """select model, provider_group, max(n) as longest from (select model, provider_group, i, count(*) as n from (select *, sum(s) over (partition by model order by started_at, rec_seq) as i from (
    select model, provider as provider_group, started_at, rec_seq, case when row_number() over (partition by model order by started_at, rec_seq) > 1 and provider is not distinct from lag(provider) over (partition by model order by started_at, rec_seq) then 0 else 1 end as s from records)) group by 1, 2, 3) group by 1, 2""")
def longest_runs(spark, d):
    """WN03: the longest burst each provider served a model."""
    r = table(spark, d, "records").select("model", F.col("provider").alias("provider_group"), "started_at", "rec_seq")
    return sequences.longest_runs(r, "provider_group", [F.col("started_at"), F.col("rec_seq")], ["model"], F.floor(F.col("started_at") / 604_800))


@query("peak_concurrency", """with e as (select provider_group, cast(round(started_at * 1000) as bigint) as t, 1 as d from records union all select provider_group, cast(round(ended_at * 1000) as bigint), -1 from records)
    select provider_group, cast(max(c) as bigint) as peak from (select provider_group, sum(d) over (partition by provider_group order by t, d rows unbounded preceding) as c, t, d from e) group by 1""")
def peak_concurrency(spark, d):
    """WN04: the most calls open at once per provider."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    r = table(spark, d, "records").select("provider_group", ms("started_at").alias("a"), ms("ended_at").alias("b"))
    return sequences.peak_overlap(r, ["provider_group"], "a", "b", 86_400_000)


_DEFECT = "verdict in ('TRUNCATED', 'EMPTY_HTTP', 'EMPTY_PARSE', 'EMPTY_CONFLICT', 'PROVIDER_ERROR', 'TRANSPORT_ERROR', 'SCHEMA_ERROR', 'BUDGET_CAPPED', 'UNDECIDED')"


@query("quarantine", f"""select rec_seq, case when coalesce(sum(case when {_DEFECT} then 1 else 0 end) over (partition by manifest_id, model order by started_at, rec_seq rows between unbounded preceding and 1 preceding), 0) >= 3 then 'QUARANTINED' else 'ACTIVE' end as state from rec""", "rec")
def quarantine(spark, d):
    """WN09, PF16, SR04: per run and model, records after the third defect."""
    defect = F.coalesce(F.col("verdict").isin(*verdicts.METHOD_DEFECT, "UNDECIDED"), F.lit(False))
    return sequences.quarantined(views.records(spark, d), ["manifest_id", "model"], defect, [F.col("started_at"), F.col("rec_seq")], 3, F.floor(F.col("started_at") / 604_800)).select("rec_seq", "state")


@query("recent_faults", "select model, fault_id from (select model, fault_id, row_number() over (partition by model order by ts desc, fault_id desc) as rn from faults) where rn <= 5")
def recent_faults(spark, d):
    """WN10."""
    w = Window.partitionBy("model").orderBy(F.desc("ts"), F.desc("fault_id"))
    return table(spark, d, "faults").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("model", "fault_id")


# ---- lineage and lookups


@query("plan_lineage", "select m.manifest_id, m.supersedes, m.reason is not null as has_reason, o.manifest_id is not null as known, o.items_hash = m.items_hash and o.roster_hash = m.roster_hash as same_plan, m.frozen_at > o.frozen_at as later from manifest m left join manifest o on o.manifest_id = m.supersedes where m.supersedes is not null")
def plan_lineage(spark, d):
    """DQ10, JN20: what replaces what, with a reason, a change and in order of time."""
    m = table(spark, d, "manifest")
    old = m.select(F.col("manifest_id").alias("supersedes"), F.col("items_hash").alias("oi"), F.col("roster_hash").alias("orh"), F.col("frozen_at").alias("of"), F.lit(True).alias("k"))
    j = m.filter("supersedes is not null").join(old, "supersedes", "left")
    return j.select("manifest_id", "supersedes", F.col("reason").isNotNull().alias("has_reason"), F.col("k").isNotNull().alias("known"), ((F.col("oi") == F.col("items_hash")) & (F.col("orh") == F.col("roster_hash"))).alias("same_plan"), (F.col("frozen_at") > F.col("of")).alias("later"))


@query("close_ids")
def close_ids(spark, d):
    """JN18: for each model that is not listed, up to three listed ones with a similar name, by the ratio of matching blocks.

    The roster is a fixed list; the strays are one row per unknown model.
    """
    listed = sorted(r["model"] for r in table(spark, d, "roster").select("model").distinct().collect())  # a fixed list

    @F.pandas_udf("array<string>")
    def nearest(names: pd.Series) -> pd.Series:
        return names.map(lambda n: difflib.get_close_matches(n, listed, n=3, cutoff=0.6))

    unknown = table(spark, d, "records").select("model").distinct().join(table(spark, d, "roster").select("model"), "model", "left_anti")
    return unknown.select("model", F.posexplode(nearest("model")).alias("place", "near"))


@query("roster_facts", "select model, weights = 'open' as is_open, coalesce(cap, context_tokens) as ceiling, case when cap is null then 'context' else 'declared' end as basis_of_cap, coalesce(field_sources['cap'], '-') as cap_source, cutoff < '2026-02-16' as before_anchor from roster")
def roster_facts(spark, d):
    """MF10, SC10: catalog rows with fallbacks and the source of a field."""
    c = F.col
    return table(spark, d, "roster").select(
        "model", (c("weights") == "open").alias("is_open"), F.coalesce("cap", "context_tokens").alias("ceiling"), F.when(c("cap").isNull(), "context").otherwise("declared").alias("basis_of_cap"),
        F.coalesce(F.try_element_at("field_sources", F.lit("cap")), F.lit("-")).alias("cap_source"), (c("cutoff") < views.ANCHOR).alias("before_anchor"),
    )


@query("envelope_violations", """with k as (select raw_id, json_valid(response) as ok, case when json_valid(response) then response else 'null' end as r from raw_responses),
    t as (select raw_id, ok, json_type(r) as top, json_type(r, '$.choices') as ch, coalesce(json_array_length(r, '$.choices'), 0) as n, json_type(r, '$.choices[0]') as c0, json_type(r, '$.choices[0].finish_reason') as fr, json_type(r, '$.choices[0].message') as msg,
        json_type(r, '$.choices[0].message.content') as co, json_type(r, '$.choices[0].message.tool_calls') as tc, coalesce(json_array_length(r, '$.choices[0].message.tool_calls'), 0) as ntc, json_type(r, '$.usage') as us from k),
    x as (select *, top = 'OBJECT' and ch = 'ARRAY' and n > 0 as listed, top = 'OBJECT' and ch = 'ARRAY' and n > 0 and c0 = 'OBJECT' as chosen, coalesce(top = 'OBJECT' and ch = 'ARRAY' and n > 0 and c0 = 'OBJECT' and msg = 'OBJECT', false) as spoken from t)
    select rule, count(*) as n from (select unnest(list_filter([case when not ok then 'envelope_not_json' end, case when ok and top <> 'OBJECT' then 'envelope_not_object' end, case when top = 'OBJECT' and (ch is null or ch = 'NULL') then 'choices_missing' end,
        case when top = 'OBJECT' and ch not in ('ARRAY', 'NULL') then 'choices_not_list' end, case when top = 'OBJECT' and ch = 'ARRAY' and n = 0 then 'choices_empty' end, case when listed and n <> 1 then 'choices_count_unexpected' end, case when listed and c0 <> 'OBJECT' then 'choice_not_object' end,
        case when chosen and fr is null then 'finish_reason_missing' end, case when chosen and coalesce(msg <> 'OBJECT', true) then 'message_missing' end, case when spoken and co is null then 'content_missing' end, case when spoken and co = 'ARRAY' then 'content_is_parts_array' end,
        case when spoken and co not in ('VARCHAR', 'NULL', 'ARRAY') then 'content_not_string' end, case when spoken and ((tc = 'ARRAY' and ntc > 0) or tc not in ('ARRAY', 'NULL')) then 'tool_calls_present' end, case when spoken and us not in ('OBJECT', 'NULL') then 'usage_not_object' end], lambda v: v is not null)) as rule from x) group by 1""")
def envelope_violations(spark, d):
    """MF11: how reply bodies break the rules of their form; any number of choices but one breaks one."""
    return schema.envelope_violations(table(spark, d, "raw_responses"), "raw_id", "response").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_replies")
def canonical_replies(spark, d):
    """MF12, MF13: what valid bodies say, from the one channel that counts."""
    return schema.canonical_replies(table(spark, d, "raw_responses"), "raw_id", "response").withColumnRenamed("row_id", "raw_id")


@query("post_run_review", """with s as (select model, item_id, arm, max_by(verdict, rec_seq) as reviewed from rec where completeness_by = 'layer2' and verdict is not null group by 1, 2, 3)
    select r.rec_seq, r.verdict as provisional, coalesce(s.reviewed, 'UNREVIEWED') as reviewed, coalesce(s.reviewed = r.verdict, false) as agreed from rec r left join s using (model, item_id, arm) where r.completeness_by = 'layer1-deferred' and r.verdict is not null""", "rec")
def post_run_review(spark, d):
    """JN23: a later reading beside the provisional verdict, which it never replaces; an unread reply is no agreement."""
    r = views.records(spark, d).filter("verdict is not null")
    keys = ["model", "item_id", "arm"]
    side = r.filter("completeness_by = 'layer2'").groupBy(*keys).agg(F.max_by("verdict", "rec_seq").alias("reviewed"))
    return r.filter("completeness_by = 'layer1-deferred'").join(side, keys, "left").select(
        "rec_seq", F.col("verdict").alias("provisional"), F.coalesce("reviewed", F.lit("UNREVIEWED")).alias("reviewed"), F.coalesce(F.col("reviewed") == F.col("verdict"), F.lit(False)).alias("agreed")
    )


@query("stream_ledger", "select attempt_id, min(entry_id) as entry_id from ledger group by 1")
def stream_ledger(spark, d):
    """SR01, SR03, SK03, SK05: the ledger read as a stream of files and stored once per attempt, in the shared folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    entries = table(spark, d, "ledger").select("attempt_id", "entry_id").schema
    stream = spark.readStream.schema(entries).parquet(f"{d}/ledger*")
    incremental.run_to_end(stream, incremental.first_wins_sink(spark, f"{base}/out", "attempt_id", "entry_id"), f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("attempt_id", "entry_id")


@query("local_budgets", "select model, context_tokens, case when context_tokens > 8192 then 4096 else greatest(256, context_tokens - (600 // 3 + 64)) end::bigint as budget from roster")
def local_budgets(spark, d):
    """MF04: output budgets for a prompt of 600 characters."""
    return table(spark, d, "roster").select("model", "context_tokens", scalars.local_budget(F.col("context_tokens"), F.lit(600)).alias("budget"))
