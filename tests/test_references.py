"""Orphan references against a plain version."""

import random

from evalmill.operators import references

REFS = "ref_table string, ref_column string, ref_key string, ref_month string, domain string, fk string, t bigint"
PARENTS = "domain string, fk string, t_from bigint, t_until bigint"


def _plain(refs, parents):
    out = set()
    for name, col, key, month, domain, fk, t in refs:
        own = [(a if a is not None else -(2**63), b) for dom, k, a, b in parents if dom == domain and k == fk and fk is not None]
        at = t if t is not None else -(2**63)
        if any(a <= at and (b is None or at < b) for a, b in own):
            continue
        state = "missing" if not own else "deleted" if any(a <= at for a, _ in own) else "late"
        out.add((name, col, key, state, month))
    return out


def _run(spark, refs, parents, **kw):
    out = references.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), **kw)
    return {(r["ref_table"], r["ref_column"], r["ref_key"], r["ref_state"], r["ref_month"]) for r in out.collect()}


def test_against_plain(spark):
    rnd = random.Random(3)
    parents = [("d", f"k{rnd.randrange(12)}", rnd.choice([None, *range(0, 50, 5)]), rnd.choice([None, *range(20, 80, 5)])) for _ in range(60)]
    refs = [("t", "c", str(i), "2026-01", rnd.choice(["d", "d", "e"]), rnd.choice([None, *[f"k{j}" for j in range(16)]]), rnd.choice([None, *range(0, 90, 5)])) for i in range(300)]
    want = _plain(refs, parents)
    assert _run(spark, refs, parents) == want
    # keys split over salts give the same
    assert _run(spark, refs, parents, hot_rows=3) == want


def test_edges(spark):
    refs = [("t", "c", "at", "m", "d", "k", 10), ("t", "c", "end", "m", "d", "k", 20), ("t", "c", "before", "m", "d", "k", 9)]
    assert _run(spark, refs, [("d", "k", 10, 20), ("d", "k", 10, 20)]) == {("t", "c", "end", "deleted", "m"), ("t", "c", "before", "late", "m")}


def test_empty(spark):
    assert _run(spark, [], [("d", "k", 1, None)]) == set()
    assert _run(spark, [("t", "c", "1", None, "d", "k", 1)], []) == {("t", "c", "1", "missing", None)}


def test_repeated_references_each_count(spark):
    refs = spark.createDataFrame([("t", "c", "1", "m", "d", "x", 1)] * 3, REFS)
    out = references.orphan_references(refs, spark.createDataFrame([], PARENTS))
    assert out.count() == 3
    assert references.orphan_report(out).first()["n_orphans"] == 3


def test_other_columns_do_not_matter(spark):
    refs = spark.createDataFrame([("t", "c", "1", "m", "d", "x", 1, 5, "z", 7)], REFS + ", salts int, h_fk string, open int")
    parents = spark.createDataFrame([("d", "x", 0, None, 3, 4)], PARENTS + ", salts int, known int")
    assert references.orphan_references(refs, parents).count() == 0
