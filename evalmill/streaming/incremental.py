"""Incremental forms: append-only sources, idempotent sinks, and a state machine per key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def journal_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New files of an append-only directory of JSON lines; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def first_wins_sink(spark: SparkSession, target: str, key: str, seq: str):
    """A foreachBatch function that stores each key once, whatever is replayed.

    Each batch is reduced to one row per key and anti-joined with what is stored, so a restarted
    batch adds nothing twice; rows are written under their batch, and a batch that was half written
    is written over.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != key]
        first = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("e")).select(key, "e.*")
        hadoop = spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(target)
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
            stored = spark.read.parquet(target).filter(F.col("batch_id") != batch_id)
            first = first.join(stored.select(key), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def run_to_end(stream: DataFrame, sink, checkpoint: str) -> None:
    """Everything that is there now, in micro-batches; a later call goes on from the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def todo_of(plan: DataFrame, stored: DataFrame, unit: str = "unit") -> DataFrame:
    """Planned units that no stored, delivered record answers; the resume set of a batch."""
    return plan.join(stored.filter("delivered").select(unit), unit, "left_anti")


STATE = "defects int, state string"


def dispatch_states(events: DataFrame, limit: int = 3) -> DataFrame:
    """Per model: PAUSED by a fault, QUARANTINED from the limit-th bad reply, ACTIVE otherwise.

    events: model, seq, kind (fault, bad, good). One row per model and micro-batch with its state and
    the bad replies so far. QUARANTINED is final; a good reply resumes a paused model. The state is two
    values per model.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        defects, current = state.get if state.exists else (0, "ACTIVE")
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind in rows["kind"]:
            if kind == "bad":
                defects += 1
            if current == "QUARANTINED" or defects >= limit:
                current = "QUARANTINED"
            elif kind == "fault":
                current = "PAUSED"
            else:
                current = "ACTIVE"
        state.update((int(defects), current))
        out: dict[str, Any] = {"model": [key[0]], "last_seq": [int(rows["seq"].max())], "defects": [int(defects)], "state": [current]}
        yield pd.DataFrame(out)

    return events.groupBy("model").applyInPandasWithState(step, "model string, last_seq bigint, defects int, state string", STATE, "update", GroupStateTimeout.NoTimeout)


def states_of(events: DataFrame, limit: int = 3) -> DataFrame:
    """The same in one batch: (model, defects, state), by ordered aggregates."""
    e = events.groupBy("model").agg(F.count_if(F.col("kind") == "bad").alias("defects"), F.max_by("kind", "seq").alias("last"))
    state = F.when(F.col("defects") >= limit, "QUARANTINED").when(F.col("last") == "fault", "PAUSED").otherwise("ACTIVE")
    return e.select("model", F.col("defects").cast("int").alias("defects"), state.alias("state"))


class Progress(StreamingQueryListener):
    """Says how far a stream is, every so many rows."""

    def __init__(self, say=print, every: int = 20):
        self.say, self.every, self.rows, self.said = say, every, 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """Nothing yet."""

    def onQueryProgress(self, event) -> None:  # noqa: N802
        """Counts the batch's rows."""
        self.rows += event.progress.numInputRows
        if self.rows - self.said >= self.every:
            self.said = self.rows
            self.say(f"{self.rows} rows, batch {event.progress.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Nothing to say."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """The total."""
        self.say(f"{self.rows} rows in all")
