"""The registered queries of this subpackage over the smallest tables."""

import os

import pytest

from evalmill.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"

COLUMNS = {
    "p5_found": ["item_id"], "p6_found": ["rec_seq", "defect"], "p7_found": ["rec_seq"], "p10_found": ["doc_id", "subject"],
}


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len({tuple(r) for r in rows}) == len(rows)
