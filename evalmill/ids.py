"""Identity of units and attempts as Column expressions.

A unit is the first 16 hex digits of sha256 over model, NUL, item_id, NUL, arm. An attempt is
``unit_id:attempt_no:attempt_kind``. Rows may write either in another case, with blanks around or
inside, or with a zero-padded number, or lack one of them; these functions give the one own form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator hashed between the parts of a unit.
NUL = "\x00"


def _bare(c: Column) -> Column:
    """Lower case, without any white space; NULL when nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)[\s\p{C}]+", "")), F.lit(""))


def unit_hash(model: Column, item_id: Column, arm: Column) -> Column:
    """The unit_id of (model, item_id, arm); NULL if any part is NULL."""
    joined = F.concat(model, F.lit(NUL), item_id, F.lit(NUL), arm)
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 16)


def prompt_hash(prompt: Column) -> Column:
    """The first 16 hex digits of sha256 over the prompt."""
    return F.substring(F.sha2(prompt.cast("binary"), 256), 1, 16)


def own_unit(unit_id: Column, attempt_id: Column | None = None, parts: tuple[Column, Column, Column] | None = None) -> Column:
    """unit_id in the own form: as written, else the attempt's first part, else hashed from its parts."""
    options = [_bare(unit_id)]
    if attempt_id is not None:
        options.append(F.nullif(F.substring_index(_bare(attempt_id), ":", 1), F.lit("")))
    if parts is not None:
        options.append(unit_hash(*parts))
    return F.coalesce(*options)


def own_attempt(attempt_id: Column, unit: Column | None = None, no: Column | None = None, kind: Column | None = None) -> Column:
    """attempt_id in the own form; where it is NULL, rebuilt from the unit in own form, number and kind."""
    written = F.regexp_replace(_bare(attempt_id), r":0+(?=\d)", ":")
    if unit is None:
        return written
    rebuilt = F.concat(unit, F.lit(":"), no.cast("string"), F.lit(":"), _bare(kind))
    return F.coalesce(written, rebuilt)


def record_unit() -> Column:
    """own_unit over the columns of records."""
    return own_unit(F.col("unit_id"), F.col("attempt_id"), (F.col("model"), F.col("item_id"), F.col("arm")))


def record_attempt() -> Column:
    """own_attempt over the columns of records."""
    return own_attempt(F.col("attempt_id"), record_unit(), F.col("attempt_no"), F.col("attempt_kind"))
