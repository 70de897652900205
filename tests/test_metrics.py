"""Metrics against plain versions."""

import random

from evalmill.operators import metrics, ranking, reconcile, sequences
from pyspark.sql import functions as F


def _auc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_with_ties(spark):
    rnd = random.Random(1)
    rows = [(g, rnd.choice([None, *range(6)]), rnd.choice([0, 0, 1, None])) for g in "abc" for _ in range(80)] + [("one", 3, 1)]
    out = {r["g"]: r["roc_auc"] for r in metrics.rank_auc(spark.createDataFrame(rows, "g string, s int, y int"), ["g"], "s", "y").collect()}
    for g in "abc":
        assert abs(out[g] - _auc([(s, y) for h, s, y in rows if h == g and s is not None and y is not None])) < 1e-12
    assert out["one"] is None


def test_undefined_rates(spark):
    df = spark.createDataFrame([("a", 10, 0), ("a", 20, 0), ("b", None, 1)], "g string, bp int, y int")
    r = metrics.confusion(df, ["g"], "bp", "y", 50).collect()
    assert len(r) == 1 and r[0]["precision"] is None and r[0]["recall"] is None and r[0]["f1"] == 0.0 and r[0]["accuracy"] == 1.0


def test_buckets_partition_the_plan(spark):
    plan = spark.createDataFrame([(u, "m") for u in "abcdef"], "unit string, model string")
    last = spark.createDataFrame([("a", "COMPLETE"), ("b", "NO_ANSWER"), ("c", "EMPTY_PARSE"), ("d", None), ("zz", "COMPLETE")], "unit string, verdict string")
    cut = spark.createDataFrame([("e",), ("e",), ("a",)], "unit string")
    r = reconcile.compliance(reconcile.census(plan, last, cut), ["model"]).first()
    assert (r["planned"], r["observed"], r["needs_inspection"], r["unobserved"], r["censored"], r["missing"], r["complied"]) == (6, 2, 1, 1, 1, 1, 1)
    assert r["rate"] == 0.5 and abs(r["lower_bound"] - 1 / 6) < 1e-12


def test_latest_prefers_delivered(spark):
    df = spark.createDataFrame([("u", 1, "COMPLETE", True), ("u", 2, "PROVIDER_ERROR", False), (None, 3, "COMPLETE", True)], "unit string, seq int, verdict string, delivered boolean")
    assert [tuple(r) for r in reconcile.latest(df, "unit", "seq", ["verdict"]).collect()] == [("u", "PROVIDER_ERROR")]
    assert [tuple(r) for r in reconcile.latest(df, "unit", "seq", ["verdict"], delivered="delivered").collect()] == [("u", "COMPLETE")]


def test_chunked_ranks_and_sums(spark):
    rows = [("ab"[i % 2], i, None if i % 7 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    for parts in (1, 7):
        ranked = ranking.chunked_rank(df.repartition(parts), ["g"], [F.col("k")], F.floor(F.col("k") / 9)).collect()
        assert all(r["rank"] == r["k"] // 2 + 1 and r["group_size"] == 100 for r in ranked)
        summed = ranking.chunked_sum(df.repartition(parts), "v", [F.col("k")], F.floor(F.col("k") / 9)).collect()
        assert all(r["running"] == sum(i for i in range(r["k"] + 1) if i % 7) for r in summed)


def test_peak_and_runs(spark):
    df = spark.createDataFrame([("p", 0, 10), ("p", 5, 12), ("p", 10, 11), ("q", 1, 2)], "g string, a int, b int")
    assert {r["g"]: r["peak"] for r in sequences.peak_overlap(df, ["g"], "a", "b", 4).collect()} == {"p": 2, "q": 1}
    rows = spark.createDataFrame([("m", i, v) for i, v in enumerate(["x", "x", None, None, None, "x"])], "m string, i int, v string")
    assert {r["v"]: r["longest"] for r in sequences.longest_runs(rows, "v", [F.col("i")], ["m"], F.floor(F.col("i") / 2)).collect()} == {"x": 2, None: 3}
    rnd = random.Random(8)
    seq = [("m", i, rnd.choice(["x", "x", "y", None])) for i in range(300)]
    want, run = {}, 0
    for k, (_, _, v) in enumerate(seq):
        run = run + 1 if k and seq[k - 1][2] == v else 1
        want[v] = max(want.get(v, 0), run)
    for width in (1, 7, 1000):
        got = sequences.longest_runs(spark.createDataFrame(seq, "m string, i int, v string"), "v", [F.col("i")], ["m"], F.floor(F.col("i") / width))
        assert {r["v"]: r["longest"] for r in got.collect()} == want


def test_exact_median(spark):
    rows = [("a", v) for v in (5, 1, 9, None)] + [("b", v) for v in (1, 2, 300, 4000)] + [("c", None)]
    got = {r["g"]: r["m"] for r in ranking.exact_median(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", "m", 8).collect()}
    assert got == {"a": 5.0, "b": 151.0}


def test_quarantine_and_ceiling(spark):
    df = spark.createDataFrame([("m", i, i in (1, 2, 4)) for i in range(7)], "m string, i int, bad boolean")
    out = {r["i"]: r["state"] for r in sequences.quarantined(df, ["m"], F.col("bad"), [F.col("i")], 3, F.floor(F.col("i") / 2)).collect()}
    assert [out[i] for i in range(7)] == ["ACTIVE"] * 5 + ["QUARANTINED"] * 2
    spend = spark.createDataFrame([(i, 4) for i in range(5)], "i int, v int")
    got = {r["i"]: r["admitted"] for r in sequences.within_ceiling(spend, "v", [F.col("i")], F.floor(F.col("i") / 2), 9).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False}
