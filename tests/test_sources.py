"""Sources, sinks and incremental forms, with a malformed line in each source."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from evalmill.operators.gates import GateError
from evalmill.sources import provenance, readers, sinks
from evalmill.streaming import incremental

SCHEMA = StructType().add("id", StringType()).add("n", IntegerType()).add("ok", BooleanType())


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "run_a.jsonl").write_text('{"id":"a","n":1,"ok":true}\n\n{"id":"b","n":2,"ok":null}\n')
    (tmp_path / "run_b.jsonl").write_text('{"id":"c","n":3,"ok":false}\n{"id":"d","n":\n')
    return tmp_path


def test_policies(spark, files):
    good, bad = str(files / "run_a.jsonl"), str(files / "run_b.jsonl")
    assert readers.strict_jsonl(spark, good, SCHEMA).count() == 2
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, bad, SCHEMA).collect()
    assert {r["id"] for r in readers.lenient_jsonl(spark, [good, bad], SCHEMA).collect()} == {"a", "b", "c"}
    rows, n = readers.counted_jsonl(spark, [good, bad], SCHEMA)
    assert n == 1 and rows.select("id").count() == 3
    with pytest.raises(GateError):
        readers.corpus(spark, [good, bad], SCHEMA)
    assert [r["id"] for r in readers.corpus(spark, good, SCHEMA, ok_only=True).collect()] == ["a"]


def test_file_part_gzip_and_required(spark, files):
    (files / "run_c.jsonl.gz").write_bytes(gzip.compress(b'{"id":"z","n":9,"ok":true}\n'))
    df = readers.with_file_part(readers.lenient_jsonl(spark, str(files), SCHEMA), "arm", r"run_(\w)\.")
    assert {(r["id"], r["arm"]) for r in df.select("id", "arm").collect()} == {("a", "a"), ("b", "a"), ("c", "b"), ("z", "c")}
    assert readers.require_values(df, "arm", ["a", "c"]) is df
    with pytest.raises(GateError):
        readers.require_values(df, "arm", ["x"])


def test_versions_lists_regions(spark, tmp_path):
    assert readers.latest_version(["records.jsonl", "records.v2.jsonl", "records.v10.jsonl", "records.vx.jsonl"], "records") == "records.v10.jsonl"
    assert readers.latest_version(["records.jsonl"], "records") == "records.jsonl"
    (tmp_path / "ids.txt").write_text("# models\na/x | X\n\nb/y\n")
    assert sorted(map(tuple, readers.id_list(spark, str(tmp_path / "ids.txt")).collect())) == [("a/x", "X"), ("b/y", None)]
    (tmp_path / "twice.txt").write_text("a\na\n")
    with pytest.raises(GateError):
        readers.id_list(spark, str(tmp_path / "twice.txt"))
    (tmp_path / "doc.md").write_text("head\n<!-- BEGIN -->\nbody\n<!-- END -->\n")
    assert readers.region(spark, str(tmp_path / "doc.md"), "<!-- BEGIN -->", "<!-- END -->").first()["region"] == "body"
    (tmp_path / "sets.json").write_text(json.dumps({"sets": {"m": [{"id": "1", "q": "?"}], "n": []}}))
    assert [tuple(r) for r in readers.item_sets(spark, str(tmp_path / "sets.json"), "id:string,q:string").collect()] == [("m", "1", "?")]
    with pytest.raises(GateError):
        readers.require_fresh(spark.range(3), spark.range(2))


def test_sinks_round_trip(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    sinks.to_csv([a, b], str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).collect())) == [("1", "x"), ("2", None)]
    sinks.to_jsonl(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["s"] == "x"
    for run in ("r1", "r2"):
        sinks.append_run(a.withColumn("run", F.lit(run)), str(tmp_path / "t"), ["run"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_version(a, str(tmp_path / "v"), 2)
    sinks.write_version(b, str(tmp_path / "v"), 10)
    assert sinks.read_latest(spark, str(tmp_path / "v")).first()["i"] == 2
    with pytest.raises(Exception):
        sinks.write_version(a, str(tmp_path / "v"), 2)
    assert "x" in sinks.text_table(a, {"i": 4, "s": 6}) and "| 1 | x |" in sinks.markdown_table(a)
    assert sinks.text_table(spark.range(201), {"id": 4}).endswith("(1 more rows)") and "more rows" not in sinks.markdown_table(spark.range(200))


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "plan.json")
    sinks.write_once(spark, path, {"id": "a"})
    with pytest.raises(GateError):
        sinks.write_once(spark, path, {"id": "b"})
    with pytest.raises(GateError):
        sinks.write_once(spark, path, {"id": "b"}, supersede="a")
    sinks.write_once(spark, path, {"id": "b", "supersedes": "a"}, supersede="a")
    assert json.loads((tmp_path / "plan.json").read_text())["id"] == "b"
    made = provenance.bundle(spark, {"plan": path}, {"plan": "b"})
    provenance.verify(spark, made, {"plan": path})
    (tmp_path / ".plan.json.crc").unlink()
    (tmp_path / "plan.json").write_text("{}")
    with pytest.raises(GateError):
        provenance.verify(spark, made, {"plan": path})


def test_stream_equals_batch_over_restart(spark, tmp_path):
    src, target, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    src.mkdir()
    schema = StructType.fromDDL("attempt_id string, seq int")
    files = [[("a", 1), ("b", 2)], [("a", 3), ("c", 4)], [("b", 5), ("d", 6), ("d", 7)]]
    for i, rows in enumerate(files):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"attempt_id": a, "seq": s}) for a, s in rows))
        sink = incremental.first_wins_sink(spark, target, "attempt_id", "seq")
        incremental.run_to_end(incremental.journal_stream(spark, str(src), schema, 1), sink, ckpt)
    got = sorted((r["attempt_id"], r["seq"]) for r in spark.read.parquet(target).collect())
    every = spark.createDataFrame([r for f in files for r in f], "attempt_id string, seq int")
    assert got == sorted((r["attempt_id"], r["seq"]) for r in readers.replayed_journal(every, "attempt_id", "seq").collect())
    # a batch that is delivered again adds nothing
    incremental.first_wins_sink(spark, target, "attempt_id", "seq")(every, 99)
    assert spark.read.parquet(target).count() == 4


def test_keyed_states(spark, tmp_path):
    src = tmp_path / "ev"
    src.mkdir()
    rows = [("m", 1, "bad"), ("m", 2, "good"), ("m", 3, "bad"), ("m", 4, "bad"), ("m", 5, "good"), ("n", 1, "good"), ("n", 2, "fault"), ("o", 1, "fault"), ("o", 2, "good")]
    for i in range(3):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"model": m, "seq": s, "kind": k}) for m, s, k in rows[i * 3 : i * 3 + 3]))
    stream = spark.readStream.schema("model string, seq bigint, kind string").option("maxFilesPerTrigger", 1).json(str(src))
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r["model"]] = (r["defects"], r["state"])

    incremental.dispatch_states(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = incremental.states_of(spark.createDataFrame(rows, "model string, seq bigint, kind string"))
    assert seen == {r["model"]: (r["defects"], r["state"]) for r in batch.collect()}


def test_resume_set(spark):
    plan = spark.createDataFrame([("a",), ("b",)], "unit string")
    stored = spark.createDataFrame([("a", True), ("b", False)], "unit string, delivered boolean")
    assert [r["unit"] for r in incremental.todo_of(plan, stored).collect()] == ["b"]
