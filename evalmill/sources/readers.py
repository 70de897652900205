"""Reading stored run data, with a stated policy for lines that do not parse."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.gates import GateError

CORRUPT = "_corrupt"


def _with_corrupt(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


def strict_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines (also gzipped); blank lines are skipped, a malformed line fails the job that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def lenient_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines with malformed ones left out: for resume sets, where an incomplete last line is normal."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def counted_jsonl(spark: SparkSession, paths: str | list[str], schema: StructType) -> tuple[DataFrame, int]:
    """(rows, number of malformed lines)."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = parsed.filter(F.col(f"r.{CORRUPT}").isNotNull()).count()
    return parsed.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT), bad


def corpus(spark: SparkSession, paths: str | list[str], schema: StructType, ok_only: bool = False) -> DataFrame:
    """Many files as one corpus: malformed lines are counted, then refused."""
    rows, bad = counted_jsonl(spark, paths, schema)
    if bad:
        raise GateError(f"{bad} malformed line(s) in {paths}")
    return rows.filter(F.col("ok").eqNullSafe(F.lit(True))) if ok_only else rows


def with_file_part(df: DataFrame, column: str, pattern: str, default: str | None = None) -> DataFrame:
    """df with a column taken from the name of the file each row came from."""
    part = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    return df.withColumn(column, F.when(part != "", part).otherwise(F.lit(default)))


def require_values(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """df, refused if it is empty or an expected value never occurs."""
    seen = {r[0] for r in df.filter(F.col(column).isin(expected)).select(column).distinct().collect()}  # at most the expected values
    if lacking := [e for e in expected if e not in seen]:
        raise GateError(f"no row with {column} in {lacking}")
    return df


def latest_version(names: list[str], stem: str, suffix: str = ".jsonl") -> str:
    """The name with the highest number of ``stem.v<N>suffix``, else ``stem suffix`` itself. Numbers compare as numbers."""
    pattern = re.compile(rf"{re.escape(stem)}\.v(\d+){re.escape(suffix)}$")
    versions = [(int(m[1]), n) for n in names if (m := pattern.fullmatch(n))]
    return max(versions)[1] if versions else f"{stem}{suffix}"


def require_fresh(base: DataFrame, derived: DataFrame) -> DataFrame:
    """derived, refused if it has another number of rows than what it was derived from."""
    n, m = base.count(), derived.count()
    if n != m:
        raise GateError(f"the derived version has {m} rows, its base {n}: derive it again")
    return derived


def item_sets(spark: SparkSession, path: str, item: str) -> DataFrame:
    """A document {"sets": {name: [item, ...]}} as one row per item with its set's name."""
    doc = spark.read.schema(f"sets map<string, array<struct<{item}>>>").option("multiLine", True).json(path)
    return doc.select(F.explode("sets").alias("benchmark", "rows")).select("benchmark", F.explode("rows").alias("i")).select("benchmark", "i.*")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, family) of a text list: comments and blank lines skipped, ``id | family`` split; an id given twice is refused."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    out = spark.read.text(path).select(line.alias("l")).filter("l <> ''").select(
        F.trim(F.substring_index("l", "|", 1)).alias("id"), F.nullif(F.trim(F.get(F.split("l", r"\|"), F.lit(1))), F.lit("")).alias("family")
    )
    twice = [r["id"] for r in out.groupBy("id").count().filter("count > 1").limit(5).collect()]
    if twice:
        raise GateError(f"listed more than once: {twice}")
    return out


def region(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """(path, region): the part of each document between two marker lines, NULL without them."""
    between = rf"(?s){re.escape(begin)}\s*\n(.*?)\n?\s*{re.escape(end)}"
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.when(F.col("value").rlike(between), F.regexp_extract("value", between, 1)).alias("region"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files, for manifests of what was used."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def replayed_journal(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first entry of each key by seq; an aggregate, so replays are reduced before the exchange."""
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("e")).select(key, "e.*")
