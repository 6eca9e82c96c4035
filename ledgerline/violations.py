"""Violations are rows; stopping on them is a separate, explicit action."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """Raised by ``assert_empty``; carries a few example rows."""


def violation(rule: str, key: Column, detail: Column | str) -> list[Column]:
    """Columns of the common violation schema (rule, key, detail)."""
    if isinstance(detail, str):
        detail = F.lit(detail)
    return [F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def assert_empty(violations: DataFrame | list[DataFrame], what: str, examples: int = 5) -> None:
    """Raise if there is any violation; only ``examples`` rows reach the driver.

    Whether there is one is asked without columns, so what only describes a violation is not worked out for a sound table.
    Several tables of violations are asked one after the other, so that the driver holds the plan of one of them.
    """
    parts = violations if isinstance(violations, list) else [violations]
    if all(part.isEmpty() for part in parts):
        return
    rows = reduce(DataFrame.unionByName, parts).limit(examples).collect()
    if rows:
        raise ValidationError(f"{what}: " + "; ".join(str(row.asDict()) for row in rows))


def failed_rules(rules: dict[str, Column]) -> Column:
    """Array of the names of rules that do not hold, in the order given.

    Each value states the condition that must be true; null counts as failed.
    """
    parts = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*parts))


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """Text of the first check whose condition is true, else null."""
    result = None
    for condition, reason in checks:
        text = F.lit(reason)
        result = F.when(condition, text) if result is None else result.when(condition, text)
    return result
