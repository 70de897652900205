"""Queries that must cover everything they are named for."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_plan_grid_crosses_every_item(spark):
    items = spark.read.parquet(f"{DATA}/bench_items.parquet").select("item_id").distinct().count()
    models = spark.read.parquet(f"{DATA}/roster.parquet").count()
    grid = entry.queries()["plan_grid"](spark, DATA)
    assert grid.count() == grid.select("unit").distinct().count() == 2 * models * items
