"""Costs, ceilings, fault classes and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens kept free in a context, the allowance for a prompt, statuses by meaning.
CONTEXT_MARGIN = 512
PROMPT_ALLOWANCE = 400
LONG_CONTEXT = 8192
FIXED_BUDGET = 4096
ACCOUNT_STATUS = (401, 402, 403)
REQUEST_STATUS = (400, 404, 405, 412, 413, 422)
RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_TYPES = ("rate_limit_exceeded", "provider_overloaded", "timeout", "server", "provider_unavailable", "unmapped")
EXHAUSTED = r"(?i)budget|quota|credit|insufficient|spend|billing|payment|exceeded"
#: z of the 95 % interval.
Z95 = 1.96


def token_cost(prompt_tokens: Column, completion_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a call at prices per million tokens; unreported tokens cost nothing."""
    zero = F.lit(0)
    return (F.coalesce(prompt_tokens, zero) * price_in + F.coalesce(completion_tokens, zero) * price_out) / 1_000_000


def highest_cost(max_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """The most a call can cost with this many output tokens."""
    return (F.lit(PROMPT_ALLOWANCE) * price_in + max_tokens * price_out) / 1_000_000


def servable_output(ceiling: Column, context: Column, prompt_chars: Column) -> Column:
    """The largest output that fits beside the prompt; NULL or 0 limits pass the ceiling through."""
    room = context - (F.floor(prompt_chars / 3) + 1) - CONTEXT_MARGIN
    none = ceiling.isNull() | (ceiling == 0) | context.isNull() | (context == 0)
    return F.when(none, ceiling).otherwise(F.greatest(F.lit(1), F.least(ceiling, room))).cast("bigint")


def local_budget(context: Column, prompt_chars: Column) -> Column:
    """Output tokens for a local model: a fixed number if its context is long, else what the prompt leaves, 256 at least."""
    return F.when(context > LONG_CONTEXT, F.lit(FIXED_BUDGET)).otherwise(F.greatest(F.lit(256), context - (F.floor(prompt_chars / 3) + 64))).cast("bigint")


def fault_policy(status: Column, error_type: Column, error: Column, retry_after: Column, transport: Column) -> Column:
    """TRANSIENT, TERMINAL_ACCOUNT or TERMINAL_REQUEST; the first rule that holds decides."""
    gone = (status == 429) & F.coalesce(error, F.lit("")).rlike(EXHAUSTED) & (retry_after.isNull() | F.isnan(retry_after))
    return (
        F.when(transport, "TRANSIENT").when(status.isin(*ACCOUNT_STATUS) | gone, "TERMINAL_ACCOUNT")
        .when(status.isin(*REQUEST_STATUS), "TERMINAL_REQUEST").otherwise("TRANSIENT")
    )


def wilson_floor(hits: Column, n: Column) -> Column:
    """Lower end of the 95 % Wilson interval; NULL without observations."""
    p = hits / n
    z2 = Z95 * Z95
    return F.when(n > 0, (p + z2 / (2 * n) - Z95 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n))


def share(part: Column, whole: Column) -> Column:
    """part / whole; NULL without a whole."""
    return F.when(whole > 0, part / whole)


def list_literal(text: Column) -> Column:
    """The values of a list literal in single or double quotes; any other text is one value."""
    listed = text.rlike(r"^\s*\[.*\]\s*$")
    parsed = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    return F.when(listed & parsed.isNotNull(), parsed).otherwise(F.array(F.regexp_replace(text, r"^\s+|\s+$", "")))
