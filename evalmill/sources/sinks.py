"""Writing results: plain files, versions, and documents that are written once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import GateError


def to_csv(parts: list[DataFrame], path: str) -> None:
    """Tables one below the other as CSV with a header; columns that a part lacks are empty."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def to_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; NULL fields are left out."""
    df.write.mode("overwrite").json(path)


def append_run(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Rows added to a table partitioned by benchmark and run, so later reads prune."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """A derived copy under version=N; an existing version is never overwritten."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The highest version under root."""
    top = spark.read.parquet(root).agg(F.max("version").alias("v")).first()["v"]
    return spark.read.parquet(f"{root}/version={top}")


def write_once(spark: SparkSession, path: str, document: dict, supersede: str | None = None) -> None:
    """A small document under path; one that is there is only replaced if the caller names its id and the
    new one declares ``supersedes`` it, and the old one is kept beside it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        old = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        if supersede is None or supersede != old.get("id") or document.get("supersedes") != supersede:
            raise GateError(f"{path} holds {old.get('id')!r} already; name it and declare that it is superseded")
        fs.rename(target, hadoop.Path(f"{path}.{old['id']}.history"))
    stream = fs.create(target, False)
    stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
    stream.close()


def _first(df: DataFrame, limit: int) -> tuple[list, str | None]:
    """At most ``limit`` rows, and a note of how many more there are."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], f"({df.count() - limit} more rows)" if len(rows) > limit else None


def text_table(df: DataFrame, widths: dict[str, int], limit: int = 200) -> str:
    """A fixed-width table of the first rows, for people; a last line says how many rows it leaves out."""
    cells = [F.rpad(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("-")), 1, w), w, " ") for c, w in widths.items()]
    head = " ".join(c[:w].ljust(w) for c, w in widths.items())
    rows, more = _first(df.select(F.concat_ws(" ", *cells)), limit)
    return "\n".join([head, *[r[0] for r in rows], *([more] if more else [])])


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """The first rows as Markdown; a last line says how many rows it leaves out."""
    rows, more = _first(df, limit)
    cell = lambda v: "-" if v is None else str(v).replace("|", r"\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows], *(["", more] if more else [])])
