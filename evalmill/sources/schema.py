"""What a reply body has to look like, checked on variants inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "$.choices[0].message.content"


def _kind(v: Column, path: str) -> Column:
    """OBJECT, ARRAY, VOID (a JSON null), another type's name, or NULL if the path is absent."""
    at = v if path == "$" else F.try_variant_get(v, path, "variant")
    return F.regexp_extract(F.schema_of_variant(at), r"^(\w+)", 1)


def envelope_violations(df: DataFrame, row_id: str, text: str, choices: int = 1) -> DataFrame:
    """(row_id, rule, path) for each rule a body breaks; what cannot be looked at breaks no rule.

    A body is data whatever it looks like: a text that is no JSON breaks one rule, nothing raises.
    """
    v = F.col("v")
    parsed = df.select(F.col(row_id).alias("row_id"), F.try_parse_json(text).alias("v"))
    k = parsed.select(
        "row_id", v.isNotNull().alias("json"), _kind(v, "$").alias("top"), _kind(v, "$.choices").alias("choices"), F.size(F.try_variant_get(v, "$.choices", "array<variant>")).alias("n"),
        _kind(v, "$.choices[0]").alias("first"), _kind(v, "$.choices[0].finish_reason").alias("reason"), _kind(v, "$.choices[0].message").alias("message"), _kind(v, ANSWER).alias("content"),
        _kind(v, "$.choices[0].message.tool_calls").alias("calls"), F.size(F.try_variant_get(v, "$.choices[0].message.tool_calls", "array<variant>")).alias("n_calls"), _kind(v, "$.usage").alias("usage"),
    )
    c = F.col
    listed = (c("top") == "OBJECT") & (c("choices") == "ARRAY") & (c("n") > 0)
    chosen = listed & (c("first") == "OBJECT")
    spoken = chosen & F.coalesce(c("message") == "OBJECT", F.lit(False))
    # The names of the rules and the paths they look at.
    rules = [
        ("envelope_not_json", "$", ~c("json")),
        ("envelope_not_object", "$", c("json") & (c("top") != "OBJECT")),
        ("choices_missing", "choices", (c("top") == "OBJECT") & (c("choices").isNull() | (c("choices") == "VOID"))),
        ("choices_not_list", "choices", (c("top") == "OBJECT") & ~c("choices").isin("ARRAY", "VOID")),
        ("choices_empty", "choices", (c("top") == "OBJECT") & (c("choices") == "ARRAY") & (c("n") == 0)),
        ("choices_count_unexpected", "choices", listed & (c("n") != choices)),
        ("choice_not_object", "choices[0]", listed & (c("first") != "OBJECT")),
        ("finish_reason_missing", "choices[0].finish_reason", chosen & c("reason").isNull()),
        ("message_missing", "choices[0].message", chosen & F.coalesce(c("message") != "OBJECT", F.lit(True))),
        ("content_missing", ANSWER[2:], spoken & c("content").isNull()),
        ("content_is_parts_array", ANSWER[2:], spoken & (c("content") == "ARRAY")),
        ("content_not_string", ANSWER[2:], spoken & ~c("content").isin("STRING", "VOID", "ARRAY")),
        ("tool_calls_present", "choices[0].message.tool_calls", spoken & (((c("calls") == "ARRAY") & (c("n_calls") > 0)) | ~c("calls").isin("ARRAY", "VOID"))),
        ("usage_not_object", "usage", spoken & ~c("usage").isin("OBJECT", "VOID")),
    ]
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(path).alias("path"))) for rule, path, test in rules]))
    return k.select("row_id", F.explode(broken).alias("b")).select("row_id", "b.rule", "b.path")


def canonical_replies(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """row_id, text, reasoning, finish_reason of the bodies that break no rule, from the one channel that counts."""
    bad = envelope_violations(df, row_id, text).select("row_id").distinct()
    v = F.try_parse_json(text)
    get = lambda path: F.try_variant_get(v, path, "string")
    out = df.select(F.col(row_id).alias("row_id"), F.coalesce(get(ANSWER), F.lit("")).alias("text"), get("$.choices[0].message.reasoning").alias("reasoning"), get("$.choices[0].finish_reason").alias("finish_reason"))
    return out.join(bad, "row_id", "left_anti")
