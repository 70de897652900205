"""Gates, sampling and lineage: each can fail."""

import pytest
from pyspark.sql import functions as F

from evalmill.operators import gates, ranking
from evalmill.sources import provenance


def test_admission(spark):
    df = spark.createDataFrame([(1, "x", [1], 0.0), (2, "", [1], 1.0), (3, None, [], None)], "i int, s string, a array<int>, d double")
    good, bad = gates.admit(df, ["s", "a", "d"])
    assert [r["i"] for r in good.collect()] == [1]
    assert {r["i"]: r["gaps"] for r in bad.collect()} == {2: ["s"], 3: ["s", "a", "d"]}
    assert gates.admit(df, ["nowhere"])[0].count() == 0
    with pytest.raises(gates.GateError):
        gates.admit(df, [])
    with pytest.raises(gates.GateError):
        gates.require_admitted(df, ["nowhere"])


def test_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    out = sorted((r["k"], r["rule"]) for r in gates.violations(df, "k", {"big": F.col("v") > 1, "none": F.col("v").isNull()}).collect())
    assert out == [("a", "big"), ("a", "k_duplicate"), ("b", "none")]
    with pytest.raises(gates.GateError):
        gates.require_none(df, "rows")
    assert gates.guard(df, lambda d: d.filter("v > 9"), "big") is df


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(300).select(F.concat(F.lit("i"), "id").alias("item_id"), (F.col("id") % 3).cast("string").alias("s"))
    draws = [sorted(r["item_id"] for r in ranking.hash_draw(df.repartition(n), 40, "seed", "item_id").collect()) for n in (1, 9)]
    assert draws[0] == draws[1] and len(draws[0]) == 40
    other = sorted(r["item_id"] for r in ranking.hash_draw(df, 40, "other", "item_id").collect())
    assert other != draws[0]
    one = df.filter("s = '0'").limit(40)
    assert {r["s"]: r["balanced"] for r in gates.balanced(df, one, "s", 0.1).collect()} == {"0": False, "1": False, "2": False}


def test_lineage():
    old = {"id": "a", "roster_hash": "r", "items_hash": "i", "arms": ["x"]}
    new = provenance.supersede(old, {"id": "b", "roster_hash": "r2", "items_hash": "i", "arms": ["x"]}, "roster change")
    assert new["supersedes"] == "a" and new["history"] == ["a"]
    with pytest.raises(gates.GateError):
        provenance.supersede(old, dict(old, id="b"), "again")
    with pytest.raises(gates.GateError):
        provenance.supersede(old, new, None)
