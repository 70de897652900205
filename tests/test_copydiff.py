"""Differences between copies, and what is read out of reply bodies."""

import json

from evalmill.operators.copydiff import differing_fields
from evalmill.sources.envelope import reply_fields, reply_of

SIDE = "key string, pick bigint, usable boolean, expected boolean, a string, b double"


def _diff(spark, left, right):
    out = differing_fields(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE), ["a", "b"], "no_left", "no_right")
    return sorted((r["key"], r["field_name"]) for r in out.collect())


def test_states(spark):
    left = [("k1", 1, True, True, "x", 1.0), ("k2", 1, True, True, "x", None), ("k3", 1, True, False, "x", 1.0), ("k4", 1, True, True, "", 0.0), (None, 1, True, True, "x", 1.0)]
    right = [("k1", 1, True, False, "x", 1.0), ("k4", 1, True, False, None, None), ("k4", 2, True, False, "", 0.0), ("k5", 1, False, False, None, None), ("k2", 1, False, False, None, None)]
    assert _diff(spark, left, right) == [("k2", "no_right"), ("k4", "a"), ("k4", "b"), ("k5", "no_left")]


def test_empty_sides(spark):
    one = [("k", 1, True, True, "x", 1.0)]
    assert _diff(spark, [], []) == []
    assert _diff(spark, one, []) == [("k", "no_right")]
    assert _diff(spark, [], one) == [("k", "no_left")]


def test_bodies_in_all_forms():
    choice = {"index": 0, "message": {"content": "hi"}, "finish_reason": "stop"}
    usage = {"prompt_tokens": "12", "completion_tokens": 3.0, "completion_tokens_details": {"reasoning_tokens": None}}
    body = {"choices": [choice], "usage": usage}
    want = (True, "stop", "hi", 12.0, 3.0, None)
    for form in (body, [body], {"data": body}, {"choices": choice, "usage": usage}, {"choices": {"0": choice}, "usage": usage}, {"choices": json.dumps([choice]), "usage": json.dumps(usage)}):
        assert reply_fields(json.dumps(form)) == want, form
        assert reply_fields(json.dumps(json.dumps(form))) == want
    assert reply_fields(json.dumps(body)[:-5])[0] is False
    assert reply_of(None) == (False, None) and reply_of("") == (False, None) and reply_of("3") == (True, None)
    parts = {"choices": [{"message": {"content": [{"type": "text", "text": "a"}, None, {"type": "text", "text": "b"}]}}]}
    assert reply_fields(json.dumps(parts))[2] == "ab"
    assert reply_fields(json.dumps({"choices": [{"message": {"content": ""}}]}))[2] == ""
