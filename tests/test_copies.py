"""Repeated deliveries."""

from datetime import datetime

from pyspark.sql import functions as F

from evalmill import ids
from evalmill.operators import copies

T = [datetime(2026, 1, 1, h) for h in range(5)]
SCHEMA = "rec_seq bigint, attempt string, at timestamp, salt string, key int, g string"


def _rank(df, salts=4):
    out = copies.rank_copies(df, F.col("attempt"), [F.col("at")], F.col("rec_seq"), salts=salts)
    return {r["row_id"]: r["is_first"] for r in out.collect()}


def test_first_by_time_then_id(spark):
    rows = [(1, "a", T[2], "x", 0, ""), (2, "a", T[1], "x", 0, ""), (3, "a", T[1], "x", 0, ""), (4, "b", None, "x", 0, ""), (5, "b", T[0], "x", 0, "")]
    assert _rank(spark.createDataFrame(rows, SCHEMA)) == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_no_identity_is_no_copy(spark):
    rows = [(1, None, T[0], "x", 0, ""), (2, None, T[0], "x", 0, "")]
    assert _rank(spark.createDataFrame(rows, SCHEMA)) == {1: True, 2: True}


def test_empty_and_hot_key(spark):
    assert _rank(spark.createDataFrame([], SCHEMA)) == {}
    hot = spark.range(2000).select(F.col("id").alias("rec_seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("attempt"), F.lit(T[0]).alias("at"), F.lit("").alias("salt"), F.lit(0).alias("key"), F.lit("").alias("g"))
    for salts in (1, 16):
        assert sum(not v for v in _rank(hot, salts).values()) == 666


def test_batches_admit_only_what_is_new(spark):
    rows = spark.createDataFrame([(1, "a", T[0], "", 0, ""), (2, "b", T[1], "", 0, ""), (3, "b", T[0], "", 0, ""), (4, None, T[0], "", 0, "")], SCHEMA)
    stored = spark.createDataFrame([("a",), (None,)], "attempt string")
    out = copies.admit_batch(rows, stored, F.col("attempt"), F.col("attempt"), [F.col("at")], F.col("rec_seq"))
    # a NULL key joins with nothing, so such rows are admitted
    assert sorted(r["row_id"] for r in out.collect()) == [3, 4]


def test_identity_forms(spark):
    unit = "0123456789abcdef"
    rows = [(f" {unit.upper()}\t", f"{unit}:01:FIRST ", "m", "i", "a", 1, "first"), (None, f"{unit}:1:first", "m", "i", "a", 1, "first"), (unit, None, "m", "i", "a", 1, "First"), (None, None, "m", "i", "a", 2, "retry"), ("", "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "unit_id string, attempt_id string, model string, item_id string, arm string, attempt_no int, attempt_kind string")
    out = [tuple(r) for r in df.select(ids.record_unit(), ids.record_attempt()).collect()]
    import hashlib

    made = hashlib.sha256(b"m\x00i\x00a").hexdigest()[:16]
    assert out[:3] == [(unit, f"{unit}:1:first")] * 3
    assert out[3] == (made, f"{made}:2:retry")
    assert out[4] == (None, None)
