"""The queries of the general problems against plain Python over the smallest tables."""

import json
import os
import re

import pyarrow.parquet as pq
import pytest

from evalmill.plans import problems

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def _table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def _attempt(r):
    own = re.sub(r"\s", "", r.get("attempt_id") or "").lower()
    if own:
        unit, no, kind = own.split(":")
        return f"{unit}:{int(no)}:{kind}"
    import hashlib

    unit = re.sub(r"\s", "", r["unit_id"] or "").lower() or hashlib.sha256("\x00".join((r["model"], r["item_id"], r["arm"])).encode()).hexdigest()[:16]
    return f"{unit}:{r['attempt_no']}:{r['attempt_kind'].lower()}"


def _load(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


def _reply(text):
    ok, x = _load(text)
    while True:
        if isinstance(x, str):
            x = json.loads(x)
        elif isinstance(x, list):
            x = x[0]
        elif isinstance(x, dict) and set(x) <= {"data", "body", "result"}:
            (x,) = x.values()
        else:
            return ok, x or {}


def _array(x):
    if isinstance(x, str):
        x = json.loads(x)
    if isinstance(x, dict):
        x = {int(k): v for k, v in x.items()} if all(k.isdigit() for k in x) else {0: x}
        return [(k, v) for k, v in sorted(x.items()) if v is not None]
    return [(i, v) for i, v in enumerate(x or []) if v is not None]


def test_p1(spark):
    best = {}
    for r in _table("records"):
        k = _attempt(r)
        best[k] = min(best.get(k, (r["delivered_at"], r["rec_seq"])), (r["delivered_at"], r["rec_seq"]))
    kept = {s for _, s in best.values()}
    want = sorted(r["rec_seq"] for r in _table("records") if r["rec_seq"] not in kept)
    assert sorted(r["rec_seq"] for r in problems.p1_found(spark, DATA).collect()) == want


def test_p3(spark):
    recs, raws = {}, {}
    for r in _table("records"):
        recs.setdefault(_attempt(r), r)
    for r in _table("raw_responses"):
        ok, body = _reply(r["response"])
        raws.setdefault(_attempt(r), []).append((ok, body, r["prompt_sha"]))
    want = set()
    for k in recs.keys() | raws.keys():
        whole = [(b, s) for ok, b, s in raws.get(k, []) if ok]
        if k not in recs:
            want.add((k, "missing_record"))
        elif not whole:
            if recs[k]["finish_reason"] is not None:
                want.add((k, "missing_raw"))
        else:
            (b, sha), r = whole[0], recs[k]
            first = ([v for _, v in _array(b.get("choices"))] or [{}])[0]
            content = (first.get("message") or {}).get("content")
            if isinstance(content, list):
                content = "".join(p["text"] for p in content if p)
            num = lambda x: None if x is None else float(x)
            u, v = b.get("usage") or {}, r["usage"] or {}
            details = lambda x: (x.get("completion_tokens_details") or {}).get("reasoning_tokens")
            pairs = {
                "finish_reason": (first.get("finish_reason"), r["finish_reason"]), "text": (content, r["text"]), "prompt_sha": (sha, r["prompt_sha"]), "reasoning_tokens": (num(details(u)), num(details(v))),
                "prompt_tokens": (num(u.get("prompt_tokens")), num(v.get("prompt_tokens"))), "completion_tokens": (num(u.get("completion_tokens")), num(v.get("completion_tokens"))),
            }
            want |= {(k, f) for f, (x, y) in pairs.items() if x != y}
    got = [(r["attempt_id"], r["field_name"]) for r in problems.p3_found(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_p4(spark):
    want = []
    for r in _table("raw_responses"):
        ok, b = _reply(r["response"])
        for i, choice in _array(b.get("choices")) if ok else ():
            want.append((r["raw_id"], "choices", i, -1))
            message = choice.get("message") or {}
            for field in ("tool_calls", "reasoning_details", "annotations"):
                want += [(r["raw_id"], field, i, j) for j, _ in _array(message.get(field))]
            if isinstance(message.get("content"), list):
                want += [(r["raw_id"], "content_parts", i, j) for j, _ in _array(message["content"])]
    assert sorted(map(tuple, problems.p4_found(spark, DATA).collect())) == sorted(want)
