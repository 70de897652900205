"""Reply parsers against plain Python on adversarial literals."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalmill.functions import replies, scalars, verdicts

TEXTS = [
    None, "", "  ", "\\boxed{A}", "\\boxed{A, B}", "first \\boxed{A} then \\boxed{\\text{Yes}}.", "\\boxed{}", "\\boxed {B}", "my estimate is *0.35*", "Final answer: 0.8",
    "a 0.7 chance of that. I cannot give a final figure.", "35%", "0.15", "1", "1.0", "1.5", "version 2.35", "**Probability: 0.30 (30%)**", "x\n\n0.42  \n", "*2* and *0.2*",
    "12.5\n.5", "I cannot answer", "It is about", "- 1. first\n2) second\nStep 3: third", "1. first\n2. second", "line\r\n0.25\r\n", "0.3*.", "p = 1_", "So 0.4, or 0.6 of it",
]


def _rows(spark, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def _closing(t):
    t = (t or "").rstrip()
    if not t:
        return None, False
    if m := re.search(r"(?<![\d.])(0?\.\d+|0|1(?:\.0+)?)[*_`\s]*[.]?$", t.splitlines()[-1].strip()):
        return float(m[1]), True
    found = [float(x) for x in re.findall(r"(?<![\d.])(0?\.\d+|0|1(?:\.0+)?)(?![\d.])", t)]
    return (found[-1] if found else None), False


def test_closing_probability(spark):
    assert [(r["prob"], r["compliant"]) for r in _rows(spark, replies.closing_probability(F.col("t")))] == [_closing(t) for t in TEXTS]


def test_boxed(spark):
    got = _rows(spark, replies.boxed(F.col("t")))
    for t, r in zip(TEXTS, got):
        boxes = re.findall(r"\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}", t or "")
        assert r["n_boxes"] == len(boxes) and r["compliant"] == bool(boxes)
        if boxes:
            assert r["raw_box"] == boxes[-1].strip() and r["answer"] == [x.strip() for x in boxes[-1].split(",") if x.strip()]


def test_chain_steps_and_lines(spark):
    for t, n in zip(TEXTS, _rows(spark, replies.chain_steps(F.col("t")))):
        steps = len(re.findall(r"^\s*(?:step\s*)?\d+[.):]", t or "", flags=re.I | re.M))
        assert n == (steps or len([x for x in (t or "").split("\n") if x.strip()])), t
    assert _rows(spark, replies.answer_lines(F.col("t")))[5] == ["first \\boxed{A} then \\boxed{\\text{Yes}}."]


def test_loose_probability(spark):
    got = dict(zip(TEXTS, _rows(spark, replies.loose_probability(F.col("t")))))
    assert got["my estimate is *0.35*"] == 0.35 and got["*2* and *0.2*"] == 0.2 and got["35%"] is None and got["12.5\n.5"] == 0.5 and got["1"] == 1.0


def test_verdict_ladder(spark):
    rows = [
        ("x", "btf3", "error", 5, "PROVIDER_ERROR"), ("0.5", "btf3", "stop", None, "UNDECIDED"), ("0.5", "btf3", "stop", 0, "PROVIDER_ERROR"), ("", "btf3", "length", 5, "TRUNCATED"), ("  ", "btf3", "stop", 5, "EMPTY_HTTP"),
        ("so it is 0.5", "btf3", "stop", 5, "COMPLETE"), ("It is about", "btf3", "stop", 5, "TRUNCATED"), ("I cannot say.", "btf3", "stop", 5, "NO_ANSWER"), ("I cannot say", "futurex", "stop", 5, "NO_ANSWER"),
        ("\\boxed{A}", "futurex", "stop", 5, "UNDECIDED"), ("\\boxed{ }", "futurex", "stop", 5, "NO_ANSWER"), ("**12%**", "futurex", None, 5, "NO_ANSWER"),
    ]
    df = spark.createDataFrame([(t, b, f, None if p is None else (p,), w) for t, b, f, p, w in rows], "t string, b string, f string, u struct<prompt_tokens:int>, w string")
    for r in df.select("t", "w", replies.completeness_verdict(F.col("t"), F.col("b"), F.col("f"), F.col("u")).alias("v")).collect():
        assert r["v"] == r["w"], r


def test_interpretation(spark):
    choice, binary = "Options:\nA. one\nB. two\n", "say \\boxed{Yes} or \\boxed{No}"
    rows = [("", choice, "empty"), ("maybe", choice, "hedge"), ("a", choice, None), ("Z", choice, "not_offered"), ("A and B", choice, "all_options"), ("yes.", binary, None), ("A", binary, "not_yes_or_no"), ("x", "free", "too_short"), ("\\text{Rome}", "free", None)]
    df = spark.createDataFrame(rows, "b string, p string, w string")
    for r in df.select("w", replies.interpreted(F.col("b"), F.col("p")).alias("i")).collect():
        assert r["i"]["why"] == r["w"]


def test_capability_verdicts(spark):
    rows = [("mcq", "B", "The answer is **B**", "stop", "OK", True), ("mcq", "B", "none here", "stop", "NOPARSE", None), ("integer", "007", "= 1,000\n7", "stop", "OK", True), ("integer", "7", "7", "length", "TRUNCATED", None), ("exact", " Rome ", "x\nit is Rome, I think", "stop", "OK", True), ("exact", "Rome", "Paris", "stop", "OK", False), ("essay", "x", "x", "stop", "UNSCORED", None), ("mcq", None, "x", "stop", "UNSCORED", None), ("mcq", "A", " ", "stop", "EMPTY", None)]
    df = spark.createDataFrame(rows, "k string, g string, t string, f string, s string, c boolean")
    for r in df.select("s", "c", replies.choice_verdict(F.col("k"), F.col("g"), F.col("t"), F.col("f")).alias("v")).collect():
        assert (r["v"]["status"], r["v"]["correct"]) == (r["s"], r["c"])


def test_evidence_and_endings(spark):
    df = spark.createDataFrame([("x" * 120 + "\\boxed{A}", None), ("\\boxed{A}.", " r "), ("a \\boxed{} ", ""), (None, None), ("I think \\boxed{A} is wrong.", None)], "t string, r string")
    got = [(r["e"]["has"], r["e"]["source"], r["e"]["chars"], r["x"]) for r in df.select(replies.reasoning_evidence(F.col("t"), F.col("r")).alias("e"), replies.ends_with_answer(F.col("t")).alias("x")).collect()]
    assert got == [(True, ["visible_prose"], 120, True), (True, ["reasoning_field"], 1, True), (False, [], 0, False), (False, [], 0, False), (False, [], 0, False)]


def test_scalars(spark):
    df = spark.createDataFrame([("['a', 'b']",), ("7",), ("[broken",)], "g string")
    assert [r[0] for r in df.select(scalars.list_literal(F.col("g"))).collect()] == [["a", "b"], ["7"], ["[broken"]]
    df = spark.createDataFrame([(0, 0), (9, 10), (5, 10)], "k int, n int")
    got = [r[0] for r in df.select(scalars.wilson_floor(F.col("k"), F.col("n"))).collect()]
    assert got[0] is None and abs(got[1] - 0.5958) < 1e-3 and got[2] < 0.5
    df = spark.createDataFrame([(None, None, "x"), (100, 0, "x"), (100, 10_000, "x"), (9000, 1000, "x" * 3000)], "c int, w int, p string")
    assert [r[0] for r in df.select(scalars.servable_output(F.col("c"), F.col("w"), F.length("p"))).collect()] == [None, 100, 100, 1]


def test_unobserved_is_not_false(spark):
    df = spark.createDataFrame([("COMPLETE", None), ("NO_ANSWER", None), ("TRUNCATED", None), (None, "stop"), (None, None), ("EMPTY_HTTP", "stop")], "v string, f string")
    got = [tuple(r) for r in df.select(verdicts.compliant(F.col("v")), verdicts.delivered(F.col("v"), F.col("f"))).collect()]
    assert got == [(True, True), (False, True), (None, True), (None, True), (None, False), (None, False)]


@pytest.mark.parametrize("seed", [0])
def test_closing_probability_on_generated(spark, seed):
    texts: list[str] = []

    @settings(max_examples=150, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet="01.5*_ \n%aA", max_size=14))
    def collect(t):
        texts.append(t)

    collect()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r["v"]["prob"], r["v"]["compliant"]) for r in df.select("i", replies.closing_probability(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [_closing(t) for t in texts]


def test_reader_and_extractor(spark):
    rows = [("Verdict: COMPLETE", "COMPLETE"), ("x\nverdict: unclear (not complete)", "UNDECIDED"), ("verdict: complete or truncated", None), ("verdict: complete\nverdict: truncated", None), ("complete", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, w string")
    assert all(r["v"] == r["w"] for r in df.select("w", replies.reader_verdict(F.col("t")).alias("v")).collect())
    df = spark.createDataFrame([("so\nPROB: 0.35 ",), ("prob: none",), ("PROB: 1.7",), ("0.3",), ("",)], "t string")
    assert [(r["p"]["readable"], r["p"]["prob"]) for r in df.select(replies.extracted_probability(F.col("t")).alias("p")).collect()] == [(True, 0.35), (True, None), (False, None), (False, None), (False, None)]


def test_readers_do_not_contradict_facts(spark):
    rows = [
        ("TRUNCATED", "It rises.\\boxed{A}", "futurex", "stop", "COMPLETE"), ("TRUNCATED", "It rises.\\boxed{A} so", "futurex", "stop", "TRUNCATED"), ("TRUNCATED", "\\boxed{ }", "futurex", "stop", "TRUNCATED"),
        ("TRUNCATED", "\\boxed{A}", "futurex", "length", "TRUNCATED"), ("TRUNCATED", "\\boxed{A}", "futurex", None, "TRUNCATED"), ("NO_ANSWER", "\\boxed{A}", "futurex", "stop", "NO_ANSWER"),
        ("TRUNCATED", "So I say\n0.42", "btf3", "stop", "COMPLETE"), ("TRUNCATED", "0.42 or so it", "btf3", "stop", "TRUNCATED"), ("TRUNCATED", None, "futurex", "stop", "TRUNCATED"), (None, "\\boxed{A}", "futurex", "stop", None),
    ]
    df = spark.createDataFrame(rows, "v string, t string, b string, f string, want string")
    got = df.select("want", replies.reconciled(F.col("v"), F.col("t"), F.col("b"), F.col("f")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_values_of_answers(spark):
    ask = "Which?\nA. one\nB. two\nC. three\n"
    rows = [("yes.", "Will it happen? Answer Yes or No.", None), ("b, A", ask, "A,B"), ("D", ask, "D"), ("\\text{Arlon}", "Who wins the prize?", "Arlon"), ("", "Who?", None)]
    df = spark.createDataFrame(rows, "box string, prompt string, want string")
    out = df.select("box", "want", replies.interpreted(F.col("box"), F.col("prompt")).alias("i")).select("box", "want", "i.*").collect()
    assert [r["value"] for r in out][1:] == [r["want"] for r in out][1:]
    assert out[0]["value"] in ("Yes", "yes.") and out[0]["interpretable"] == (out[0]["value"] == "Yes") or out[0]["kind"] == "free_text"
    probs = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (-0.1,), (None,), (float("nan"),)], "p double").select(replies.interpreted_probability(F.col("p")).alias("i")).select("i.*").collect()
    assert [r["why"] for r in probs] == [None, None, "outside", "outside", "none", "none"]


def test_unknown_verdicts_are_refused(spark):
    from evalmill.functions import verdicts

    known = spark.createDataFrame([("COMPLETE", None), ("EMPTY", "stop"), (None, "stop"), (None, None)], "v string, f string").select(verdicts.delivered(F.col("v"), F.col("f")).alias("d"))
    assert [r["d"] for r in known.collect()] == [True, False, True, False]
    with pytest.raises(Exception, match="unknown verdict: FINE"):
        spark.createDataFrame([("FINE", "stop")], "v string, f string").select(verdicts.delivered(F.col("v"), F.col("f")).alias("d")).collect()
