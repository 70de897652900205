"""Nested records to flat tables."""

import json

import pytest

from evalmill.operators import nested
from evalmill.sources import envelope

CALL = {"id": "c1", "function": {"name": "f", "arguments": "{}"}}


def _elements(spark, bodies, paths=None):
    df = spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "raw_id bigint, response string")
    return sorted((r["row_id"], r["child_table"], tuple(r["ordinals"])) for r in nested.elements(nested.shred(df, "raw_id", "response", paths)).collect())


def test_forms_of_arrays(spark):
    msg = {"content": "x", "tool_calls": [None, CALL]}
    assert _elements(spark, [{"choices": [None, {"message": msg}]}]) == [(0, "choices", (1,)), (0, "tool_calls", (1, 1))]
    assert _elements(spark, [{"choices": {"message": {"tool_calls": CALL}}}]) == [(0, "choices", (0,)), (0, "tool_calls", (0, 0))]
    assert _elements(spark, [{"choices": {"0": {"message": {}}, "2": {"message": {}}}}]) == [(0, "choices", (0,)), (0, "choices", (2,))]
    assert _elements(spark, [{"choices": json.dumps([{"message": {"tool_calls": json.dumps([CALL])}}])}]) == [(0, "choices", (0,)), (0, "tool_calls", (0, 0))]
    assert _elements(spark, [json.dumps(json.dumps([{"choices": [{"message": {"content": [{"text": "a"}, None]}}]}]))]) == [(0, "choices", (0,)), (0, "content_parts", (0, 0))]


def test_nothing_to_find(spark):
    assert _elements(spark, [None, "", '{"choices": [{"mess', {"choices": None}, {"choices": []}, {"error": {}}, "[]", "5", {"choices": [{"message": {"content": None, "tool_calls": None}}]}]) == [(8, "choices", (0,))]


def test_flat_tables_keep_links(spark):
    body = {"id": "r", "usage": {"prompt_tokens": 4}, "choices": [{"finish_reason": "stop", "message": {"content": "a", "tool_calls": [CALL, {"id": "c2"}]}}, {"finish_reason": None, "message": {"content": "b"}}]}
    df = spark.createDataFrame([(7, json.dumps(body)), (8, "{")], "raw_id bigint, response string")
    s = nested.shred(df, "raw_id", "response")
    assert [tuple(r) for r in nested.flat_table(s, "", {"id": "id", "n": "usage.prompt_tokens"}, ()).collect()] == [(7, "r", "4")]
    rows = nested.flat_table(s, "choices[]", {"why": "finish_reason", "content": "message.content"}, ("pos",)).collect()
    assert sorted(map(tuple, rows)) == [(7, 0, "stop", "a"), (7, 1, None, "b")]
    rows = nested.flat_table(s, "choices[].message.tool_calls[]", {"id": "id", "name": "function.name"}, ("pos", "child")).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[:3]) == [(7, 0, 0, "c1", "f"), (7, 0, 1, "c2", None)]


def test_very_long_record(spark):
    big = {"choices": [{"message": {"content": "x" * 200_000, "annotations": [{"n": i} for i in range(3000)]}}]}
    assert len(_elements(spark, [big])) == 3001


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "raw_id string, response string, row_id int, triples string")
    assert nested.elements(nested.shred(df, "raw_id", "response")).collect() == []


def test_many_wrappers_and_great_depth(spark):
    body = {"choices": [{"message": {"tool_calls": [CALL]}}]}
    wrapped = body
    for i in range(20):
        wrapped = [wrapped] if i % 2 else {"data": wrapped}
    deep = '{"choices": [{"message": {"tool_calls": [' + '{"a": [' * 20_000 + "1" + "]}" * 20_000 + "]}}]}"
    assert _elements(spark, [wrapped, deep, deep[:-1]], nested.REPLY_TABLES) == [(i, t, at) for i in (0, 1) for t, at in (("choices", (0,)), ("tool_calls", (0, 0)))]


def test_stacked_reads_what_json_reads():
    docs = ["null", " 5 ", "-1.5e3", '"a\\u00e4\\n"', "[]", "{}", "[[], {}, [1, 2.0, true, false, null]]", '{"a": {"b": [1, {"c": "d"}]}, "a": 2}', "[NaN, -Infinity]", ' { "x" : [ ] , "y" : { } } ']
    for d in docs:
        assert repr(envelope.stacked(d)) == repr(json.loads(d)), d
    for d in ["", "[", "]", "{", "[1,]", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "1 2", "[}", "{]", "nul", '"a', "01", "{1: 2}", '{"a": [}', "[{]"]:
        for read in (envelope.stacked, json.loads):
            with pytest.raises(ValueError):
                read(d)


def test_keys_with_points_and_brackets(spark):
    body = {"usage.prompt_tokens": 9, "usage": {"prompt_tokens": 4, "x[]": 1}, "id": "r", "choices": [{"finish_reason": "stop", "finish_reason.x": "no"}]}
    df = spark.createDataFrame([(7, json.dumps(body))], "raw_id bigint, response string")
    for paths in (None, ["id", "usage.prompt_tokens", "choices[].finish_reason"]):
        s = nested.shred(df, "raw_id", "response", paths)
        assert [tuple(r) for r in nested.flat_table(s, "", {"id": "id", "n": "usage.prompt_tokens"}, ()).collect()] == [(7, "r", "4")]
        assert [tuple(r) for r in nested.flat_table(s, "choices[]", {"why": "finish_reason"}, ("pos",)).collect()] == [(7, 0, "stop")]
