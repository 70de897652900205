"""Filling containers of fixed capacity with texts of varying length.

Best-fit decreasing: texts in order of size, each into the open container with the least room that
still holds it, found in logarithmic time by a segment tree over the remaining capacities. Texts are
spread by hash over shards of about SHARD texts, each packed on its own, so the largest task has one
size whatever the corpus; a shard leaves at most its last containers partly filled.

Defined cases: a text larger than the capacity fills containers of its own and only its rest is
packed with others; a text without tokens needs no container and comes out with NULL; equal sizes are
taken in order of doc_id; repeated texts are packed each; no texts give an empty result; a NULL
or non-positive capacity is no container.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that are packed together.
SHARD = 20_000


class RoomTree:
    """Segment tree over the remaining capacities 0..capacity: which have an open container."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.open = bytearray(2 * self.size)

    def set(self, room: int, there: bool) -> None:
        """Note whether a container with this room is open."""
        i = room + self.size
        self.open[i] = there
        i //= 2
        while i:
            there = self.open[2 * i] or self.open[2 * i + 1]
            if self.open[i] == there:
                break
            self.open[i] = there
            i //= 2

    def tightest(self, need: int) -> int:
        """The least room >= need of an open container, -1 if there is none."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def pack(sizes: list[int], capacity: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """(for each text its (container, tokens) pieces, the fill of each container), by best fit decreasing."""
    pieces: list[list[tuple[int, int]]] = [[] for _ in sizes]
    fill: list[int] = []
    rests = []
    for i, n in enumerate(sizes):
        for _ in range(n // capacity):  # a full container holds nothing else
            pieces[i].append((len(fill), capacity))
            fill.append(capacity)
        if n % capacity:
            rests.append((-(n % capacity), i))
    tree, open_by_room = RoomTree(capacity), [[] for _ in range(capacity + 1)]
    for minus, i in sorted(rests):
        n = -minus
        room = tree.tightest(n)
        if room < 0:
            room = capacity
            c = len(fill)
            fill.append(0)
        else:
            c = open_by_room[room].pop()
            if not open_by_room[room]:
                tree.set(room, False)
        fill[c] += n
        pieces[i].append((c, n))
        left = room - n
        if left:
            if not open_by_room[left]:
                tree.set(left, True)
            open_by_room[left].append(c)
    return pieces, fill


def packed(texts: DataFrame, capacities: list[tuple[str, int]], shard: int = SHARD, n_texts: int | None = None) -> DataFrame:
    """(container_kind, capacity, doc_id, piece, container, tokens, container_fill) of (doc_id, tokens).

    container is unique within its kind: shard number, then number in the shard. capacities is a
    short fixed list. n_texts: how many texts there are, where that is known without finding their sizes.
    """
    kinds = [(str(k), int(c)) for k, c in capacities if k is not None and c is not None and c > 0]
    n = texts.count() if n_texts is None else n_texts
    shards = max(1, -(-n // shard))
    doc_type = dict(texts.dtypes)["doc_id"]
    of_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in kinds])) if kinds else None
    schema = f"container_kind string, capacity int, doc_id {doc_type}, piece int, container bigint, tokens bigint, container_fill bigint"
    if of_kind is None:
        return texts.sparkSession.createDataFrame([], schema)
    spread = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn("k", of_kind).select("k.*", "shard", "doc_id", "tokens")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        capacity, number = t.column("capacity")[0].as_py(), t.column("shard")[0].as_py()
        pieces, fill = pack(t.column("tokens").to_pylist(), capacity)
        at, piece, container, size, full = [], [], [], [], []
        for i, own in enumerate(pieces):
            for j, (c, n) in enumerate(own or [(None, 0)]):
                at.append(i)
                piece.append(j)
                container.append(None if c is None else (number << 32) + c)
                size.append(n)
                full.append(None if c is None else fill[c])
        rows = t.take(pa.array(at, pa.int64()))
        return pa.table({
            "container_kind": rows.column("container_kind"), "capacity": rows.column("capacity"), "doc_id": rows.column("doc_id"),
            "piece": pa.array(piece, pa.int32()), "container": pa.array(container, pa.int64()), "tokens": pa.array(size, pa.int64()), "container_fill": pa.array(full, pa.int64()),
        })

    return spread.groupBy("container_kind", "shard").applyInArrow(run, schema)


def fill_report(packing: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, the containers that tokens alone would need, and the share of room used.

    No packing, in shards or as a whole, needs fewer than least_containers, so n_containers - least_containers
    bounds what the shards lose.
    """
    per = packing.filter("container is not null").groupBy("container_kind", "capacity", "container").agg(F.sum("tokens").alias("tokens"))
    return per.groupBy("container_kind", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("tokens").alias("tokens"), F.ceil(F.sum("tokens") / F.first("capacity")).cast("bigint").alias("least_containers"),
    ).withColumn("fill_share", F.col("tokens") / (F.col("n_containers") * F.col("capacity")))
