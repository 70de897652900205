"""Columns that have nothing to do with an operator, under names it uses inside."""

from pyspark.sql import functions as F

from evalmill.llm import mixing, packing, pairs, residue, subjects, tokens, truncation


def _with(df, *names):
    return df.withColumns({n: F.lit("x") for n in names})


def test_clashing_columns(spark):
    texts = spark.createDataFrame([(1, "s", "The judge dismissed the appeal."), (2, "s", None), (3, None, "")], "doc_id bigint, source string, text string")
    other = _with(texts, "row_id", "mask", "subject", "tokens", "_text", "key", "closed", "body", "w1", "shard", "k", "bin", "salt", "rank", "u0")
    sizes = tokens.sized(other.drop("tokens"), "text", ["doc_id", "source"])
    assert sorted((r["doc_id"], r["tokens"] > 0) for r in sizes.collect()) == [(1, True), (2, False), (3, False)]
    extra = _with(sizes, "shard", "k", "bin", "salt", "rank", "copies", "u0", "place")
    assert packing.packed(extra, [("c", 4)]).count() >= 3
    targets = _with(spark.createDataFrame([("s", 1.0, 1)], "source_name string, target_share double, max_repeats int"), "n_documents", "tokens")
    assert [r["doc_id"] for r in mixing.mixed(extra, targets).collect()] == [1]
    rows = _with(texts.select(F.col("doc_id").alias("row_id"), "text"), "body", "closed", "ss", "w1", "exact", "name")
    assert truncation.truncated_texts(rows).collect() == []
    assert residue.residue_rows(_with(texts, "key", "n_spans"), "doc_id", "text").collect() == []
    replies = _with(texts.select(F.col("doc_id").alias("row_id"), F.lit("i").alias("item_id"), "text"), "bare", "open", "pieces", "scores", "language", "prompt")
    items = _with(spark.createDataFrame([("i", "Will the judge dismiss the appeal?")], "item_id string, prompt string"), "language", "scores", "text")
    assert {(r["row_id"], r["defect"]) for r in pairs.defective_pairs(replies, items, rows).collect()} == {(2, "empty"), (3, "empty")}
    labels = _with(spark.createDataFrame([(9, "law")], "doc_id bigint, subject string"), "mask", "b", "text")
    areas = _with(spark.createDataFrame([("law", "Law", "judge and appeal")], "subject string, subject_name string, description string"), "n")
    assert isinstance(subjects.document_subjects(other, labels, areas).collect(), list)
