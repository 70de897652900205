"""Queries of the problems tagged llm over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from . import mixing, packing, pairs, residue, subjects, tokens, truncation


# ---- 5. template residue and error-page text


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """item_id of the items whose prompt holds residue, once each."""
    return residue.residue_rows(table(spark, d, "bench_items"), "item_id", "prompt").select(F.col("key").alias("item_id")).distinct()


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each such prompt is residue."""
    found = residue.residue_rows(table(spark, d, "bench_items"), "item_id", "prompt")
    return found.groupBy(F.col("key").alias("item_id")).agg(F.max("n_spans").alias("n_spans"), F.max("covered").alias("covered"))


# ---- 6. broken prompt and response pairs


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """rec_seq and defect of the replies delivered as ok to items of bench_items."""
    records = table(spark, d, "records").select(F.col("rec_seq").alias("row_id"), "item_id", "text", "ok")
    items = table(spark, d, "bench_items").select("item_id", "prompt")
    found = pairs.defective_pairs(records.filter("ok").drop("ok"), items, records.select("row_id", "text"))
    return found.select(F.col("row_id").alias("rec_seq"), "defect")


# ---- 7. text cut off by field limits


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """rec_seq of the records whose text was cut."""
    rows = table(spark, d, "records").select(F.col("rec_seq").alias("row_id"), "text")
    return truncation.truncated_texts(rows).select(F.col("row_id").alias("rec_seq"))


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often the replies of each provider are cut."""
    rows = table(spark, d, "records").select(F.col("rec_seq").alias("row_id"), F.col("provider").alias("source"), "text")
    return truncation.truncation_rates(rows).withColumnRenamed("source", "provider")


# ---- 8. filling fixed-capacity containers


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """The containers of each text, for every kind of container."""
    documents = table(spark, d, "documents")
    return packing.packed(tokens.sized(documents, "text", ["doc_id"]), _capacities(spark, d), n_texts=documents.count())


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.fill_report(p8_packed(spark, d))


def _capacities(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    # the short fixed list of container kinds
    return [(r["container_kind"], r["capacity_tokens"]) for r in table(spark, d, "pack_capacities").collect()]


# ---- 9. mixing sources to target weights


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The documents used and how often."""
    sizes = cut_lineage(tokens.sized(table(spark, d, "documents"), "text", ["doc_id", "source"]))  # needed three times
    return mixing.mixed(sizes, table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    sizes = cut_lineage(tokens.sized(table(spark, d, "documents"), "text", ["doc_id", "source"]))
    return mixing.share_report(sizes, table(spark, d, "mix_targets"), mixing.mixed(sizes, table(spark, d, "mix_targets")))


# ---- 10. subject area of each document


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and subject of every document without labels."""
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and subject-bearing sentences per source and subject."""
    documents = table(spark, d, "documents")
    found = subjects.mixtures(documents, *subjects.fit(documents, table(spark, d, "subject_labels"), table(spark, d, "subject_areas")))
    return documents.select("doc_id", "source").join(found, "doc_id").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


QUERIES = {f.__name__: f for f in (p5_found, p5_coverage, p6_found, p7_found, p7_rates, p8_packed, p8_fill, p9_mixed, p9_shares, p10_found, p10_composition)}
ORACLE: dict[str, str] = {}
