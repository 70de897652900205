"""Mixing sources to target shares by systematic sampling.

Every document of a source has the same expected number of copies: the source's target tokens over
its own. Along the documents of a source, ordered by size, the expected copies are summed up, one
random offset per source is added, and a document comes out once per integer boundary it crosses; its
copies are the expected number rounded down or up, and over the offsets they are that number on
average. The sums are taken in two steps, over chunks of (source, size, salt) and inside each chunk,
with as many salts as the source's number of documents needs, so a source that holds any share of all
rows is spread.

Defined cases: sources without targets, NULL sources and documents without tokens are not used;
targets with NULL or non-positive share or repeats take no part; targets without documents get
nothing and the others keep their ratios; repeated documents count each; no usable source gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of one source and size that one task may order; a source of more has more salts.
CHUNK = 500_000
SEED = 20_260_101


def rates(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per usable source: target_share, max_repeats, source_tokens, expected_copies.

    The total is the largest at which no source needs more than its repeats.
    """
    clean = targets.filter("source_name is not null and target_share > 0 and max_repeats > 0").groupBy("source_name").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = texts.filter("source is not null and tokens > 0").groupBy(F.col("source").alias("source_name")).agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_documents"))
    both = clean.join(have, "source_name", "left")  # one row per target source
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")).over(everything)  # sources without documents set no bound
    expected = F.least(F.col("max_repeats").cast("double"), F.col("target_share") * total / F.col("source_tokens"))
    return both.withColumn("expected_copies", expected)


def mixed(texts: DataFrame, targets: DataFrame, seed: int = SEED, salts: int | None = None) -> DataFrame:
    """(doc_id, source_name, tokens, copies) of every document used, copies >= 1; texts: doc_id, source, tokens.

    texts is read three times: cut its lineage where the sizes are costly. salts: parts of each source, by its size where not given.
    """
    parts = F.lit(salts) if salts else F.ceil(F.col("n_documents") / CHUNK)
    plan = rates(texts, targets).filter("source_tokens > 0").select("source_name", "expected_copies", parts.cast("bigint").alias("parts"))
    # sizes above 64 tokens are binned to two leading digits in base 2, so there are few chunks
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.col("tokens").cast("double"))) - 5).cast("bigint"))
    chunked = (
        texts.filter("source is not null and tokens > 0")
        .select("doc_id", F.col("source").alias("source_name"), "tokens")
        .join(F.broadcast(plan), "source_name")  # one row per target source, a list made by hand
        .withColumn("bin", (F.floor(F.col("tokens") / step) * step).cast("bigint"))
        .withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "parts").cast("int"))
        .drop("parts")
    )
    counts = chunked.groupBy("source_name", "bin", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_name").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source_name", "bin", "salt").orderBy("tokens", "doc_id")
    place = chunked.withColumn("place", F.row_number().over(inside)).join(starts, ["source_name", "bin", "salt"])
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "source_name"), F.lit(1 << 30)) / (1 << 30)
    reached = lambda n: F.floor(n * F.col("expected_copies") + offset + 1e-9)
    rank = F.col("start") + F.col("place")
    copies = (reached(rank) - reached(rank - 1)).cast("int")
    return place.select("doc_id", "source_name", "tokens", copies.alias("copies")).filter("copies > 0")


def share_report(texts: DataFrame, targets: DataFrame, mix: DataFrame) -> DataFrame:
    """Per target source: target_share, max_repeats, what it has and gives, the most copies of a document, and the actual share."""
    used = mix.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_used"), F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per target source
    return (
        rates(texts, targets).join(used, "source_name", "left").fillna(0, ["n_documents", "source_tokens", "n_used", "used_tokens", "most_copies"])
        .withColumn("actual_share", F.col("used_tokens") / F.sum("used_tokens").over(everything))
        .select("source_name", "target_share", "actual_share", "max_repeats", "most_copies", "n_documents", "n_used", "source_tokens", "used_tokens")
    )
