"""Deeply nested records into related flat tables.

Each record is walked once into triples (path, value, ordinals): the path names every repeated
ancestor with ``[]``, the ordinals are the element's places in them. Triples of one repeated ancestor
make one table, pivoted so that each path below it is a column; the ordinals are the link to the
parent row. Records are walked inside one Arrow batch and never shuffled whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.envelope import decoded, positioned, reply_of

#: What a triple's value is: an element of an array, a null in its place, or a value below it.
ELEMENT, NULL_ELEMENT, VALUE = "element", "null", "value"

#: The repeated ancestors of a reply body and the table each becomes.
REPLY_TABLES = {
    "choices[]": "choices",
    "choices[].message.tool_calls[]": "tool_calls",
    "choices[].message.reasoning_details[]": "reasoning_details",
    "choices[].message.annotations[]": "annotations",
    "choices[].message.content[]": "content_parts",
}
#: Paths that stand for arrays in whatever form they are delivered; content only when it is no text.
_ARRAYS = {p[:-2] for p in REPLY_TABLES} - {"choices[].message.content"}
_OBJECTS = {"choices[].message", "usage", "usage.completion_tokens_details"}


def _scalar(x) -> str | None:
    return x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False)


def _step(key: str) -> str:
    """A key as one step of a path: points and brackets of its own are escaped."""
    return re.sub(r"([\\.\[\]])", r"\\\1", key) if any(c in key for c in "\\.[]") else key


def leading(paths: Iterable[str]) -> set[str]:
    """The paths and all that lead to them."""
    out = {""}
    for p in paths:
        out |= {p[: m.start()] for m in re.finditer(r"(?<!\\)\.|\[\]", p)} | {p[: m.end()] for m in re.finditer(r"\[\]", p)} | {p}
    return out


def walk_reply(body: dict, within: set[str] | None = None) -> Iterator[tuple[str, str, str | None, tuple[int, ...]]]:
    """(path, kind, value, ordinals) in document order; of the paths within, where given, and not of what lies beside or below them."""
    stack: list[tuple[str, object, tuple[int, ...]]] = [("", body, ())]
    while stack:
        path, x, at = stack.pop()
        if within is not None and path not in within:
            continue
        if path in _OBJECTS:
            x = decoded(x)
        if isinstance(x, list) or path in _ARRAYS or (path == "choices[].message.content" and isinstance(x, dict)):
            # what stands for no array (null, text) has no elements
            inner = f"{path}[]"
            for i, e in reversed(positioned(x)):
                stack.append((inner, e, (*at, i)))
        elif path.endswith("[]") and x is None:
            yield path, NULL_ELEMENT, None, at
        else:
            if path.endswith("[]"):
                yield path, ELEMENT, None if isinstance(x, dict) else _scalar(x), at
            if isinstance(x, dict):
                for k, v in reversed(x.items()):
                    stack.append((f"{path}.{_step(k)}" if path else _step(k), v, at))
            elif not path.endswith("[]"):
                yield path, VALUE, _scalar(x), at


def shred(df: DataFrame, row_id: str, text: str, paths: Iterable[str] | None = None, walk: Callable = walk_reply) -> DataFrame:
    """row_id, complete, triples: array<struct<path, kind, value, ordinals>>, one row per input row.

    A text that is not one complete JSON document (NULL and empty included) has complete false and no
    triples; a complete one that holds no object has none either. Only the two columns named are read,
    and, where paths are named, only the triples on the way to them are made; name them where records
    may nest thousands deep, as a path is as long as its depth.
    """
    triple = "struct<path:string,kind:string,value:string,ordinals:array<int>>"
    kind = pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("ordinals", pa.list_(pa.int32()))])
    id_type = dict(df.dtypes)[row_id]
    within = None if paths is None else leading(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            complete, ends, paths, kinds, values, places, place_ends = [], [0], [], [], [], [], [0]
            for s in b.column(1).to_pylist():
                ok, body = reply_of(s)
                complete.append(ok)
                for path, what, value, at in walk(body, within) if body is not None else ():
                    paths.append(path)
                    kinds.append(what)
                    values.append(value)
                    places.extend(at)
                    place_ends.append(len(places))
                ends.append(len(paths))
            ordinals = pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(places, pa.int32()))
            flat = pa.StructArray.from_arrays(
                [pa.array(paths, pa.string()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), ordinals], fields=list(kind)
            )
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(complete, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                names=["row_id", "complete", "triples"],
            )

    return df.select(F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"row_id {id_type}, complete boolean, triples array<{triple}>"
    )


def elements(shredded: DataFrame, tables: dict[str, str] = REPLY_TABLES) -> DataFrame:
    """row_id, child_table, ordinals: every non-null element of each repeated ancestor.

    An element has exactly one triple of its own, so no grouping over rows is needed.
    """
    names = F.create_map(*[F.lit(x) for kv in tables.items() for x in kv])
    own = F.filter("triples", lambda t: (t["kind"] == ELEMENT) & t["path"].isin(list(tables)))
    return shredded.select("row_id", F.explode(own).alias("t")).select("row_id", names[F.col("t.path")].alias("child_table"), F.col("t.ordinals").alias("ordinals"))


def flat_table(shredded: DataFrame, ancestor: str, columns: dict[str, str], positions: tuple[str, ...]) -> DataFrame:
    """One flat table: row_id, the positions of the row and of its parents, and the columns.

    ancestor: the repeated path, or "" for one row per record. columns: name to the path below the
    ancestor. Missing paths and nulls both give NULL. The pivot runs over the record's own triples,
    sorted into a map by ordinals, so records are not shuffled.
    """
    prefix = f"{ancestor}." if ancestor else ""
    wanted = [f"{prefix}{p}" for p in columns.values()]
    if not ancestor:
        lookup = F.map_from_entries(F.transform(F.filter("triples", lambda t: t["path"].isin(wanted)), lambda t: F.struct(t["path"], t["value"])))
        return shredded.filter("complete").select("row_id", lookup.alias("m")).select("row_id", *[F.col("m")[w].alias(c) for c, w in zip(columns, wanted)])
    # the key of a value is its path and the place of its row
    key = lambda t, path: F.concat_ws("|", path, F.array_join(t["ordinals"].cast("array<string>"), ","))
    lookup = F.map_from_entries(F.transform(F.filter("triples", lambda t: t["path"].isin(wanted)), lambda t: F.struct(key(t, t["path"]), t["value"])))
    rows = F.filter("triples", lambda t: (t["kind"] == ELEMENT) & (t["path"] == ancestor))
    out = shredded.filter("complete").select("row_id", lookup.alias("m"), F.explode(rows).alias("t"))
    return out.select(
        "row_id",
        *[F.col("t.ordinals")[i].alias(p) for i, p in enumerate(positions)],
        *[F.col("m")[key(F.col("t"), F.lit(w))].alias(c) for c, w in zip(columns, wanted)],
    )
