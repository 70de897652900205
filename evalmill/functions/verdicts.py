"""The verdict vocabulary and predicates over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The verdicts, what each means, and how they fall into buckets.
SCOREABLE = ("COMPLETE", "NO_ANSWER")
NEEDS_INSPECTION = ("EMPTY_PARSE", "EMPTY_CONFLICT")
UNDELIVERED = ("PROVIDER_ERROR", "TRANSPORT_ERROR", "EMPTY_HTTP")
METHOD_DEFECT = ("TRUNCATED", "EMPTY_HTTP", "EMPTY_PARSE", "EMPTY_CONFLICT", "PROVIDER_ERROR", "TRANSPORT_ERROR", "SCHEMA_ERROR", "BUDGET_CAPPED")
KNOWN = ("COMPLETE", "NO_ANSWER", "TRUNCATED", "PROVIDER_ERROR", "TRANSPORT_ERROR", "SCHEMA_ERROR", "UNDECIDED", "EMPTY_HTTP", "EMPTY_PARSE", "EMPTY_CONFLICT", "BUDGET_CAPPED")
BUCKETS = ("OBSERVED", "NEEDS_INSPECTION", "UNOBSERVED", "CENSORED", "MISSING")


def current(verdict: Column) -> Column:
    """The verdict with its old name for an empty reply replaced."""
    return F.when(verdict == "EMPTY", F.lit("EMPTY_HTTP")).otherwise(verdict)


def bucket(verdict: Column) -> Column:
    """OBSERVED, NEEDS_INSPECTION or UNOBSERVED; a NULL verdict is unobserved."""
    return F.when(verdict.isin(*SCOREABLE), "OBSERVED").when(verdict.isin(*NEEDS_INSPECTION), "NEEDS_INSPECTION").otherwise("UNOBSERVED")


def delivered(verdict: Column, finish_reason: Column) -> Column:
    """Whether the provider handed the model's output back; without a verdict a finish reason decides.

    A verdict outside the vocabulary is an error where it is read, never an answer.
    """
    unknown = F.raise_error(F.concat(F.lit("unknown verdict: "), verdict)).cast("boolean")
    return F.when(verdict.isNull(), finish_reason.isNotNull()).when(verdict.isin(*KNOWN, "EMPTY"), ~verdict.isin(*UNDELIVERED, "EMPTY")).otherwise(unknown)


def compliant(verdict: Column) -> Column:
    """True, false or NULL for unobserved: never false for what was not seen."""
    return F.when(verdict == "COMPLETE", True).when(verdict == "NO_ANSWER", False)
