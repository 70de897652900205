"""All queries of the core by name, with their oracles."""

from __future__ import annotations

from . import evaluation, problems, quality  # noqa: F401 - quality registers its queries


def queries() -> dict:
    """name -> (spark, sf_dir) -> DataFrame."""
    return evaluation.QUERIES | problems.QUERIES


def oracle_sql() -> dict:
    """name -> DuckDB SQL."""
    return evaluation.ORACLE | problems.ORACLE
