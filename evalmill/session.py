"""Session helpers: table loading and lineage cutting through the cluster's shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where none is named, a local master, whose executors are this machine, uses one beside Spark's own
    scratch files; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"{sc.getConf().get('spark.local.dir', '/tmp')}/evalmill-{sc.applicationId}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of df in the shared folder; survives the loss of any executor.

    Spark deletes it once df is no longer used, if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df as a table in the shared folder, for work that ends inside the block; it is deleted then."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions than there are cores.

    For costly work per row on small files; a table of many files is left as it is, without a shuffle.
    df must be read without a shuffle, as counting its partitions would run one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def utc(ts):
    """A timestamp column moved so that formatting it in the session's zone prints UTC."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def month_of(ts):
    """YYYY-MM of a timestamp in UTC, whatever the session's zone; NULL stays NULL."""
    return F.date_format(utc(ts), "yyyy-MM")
