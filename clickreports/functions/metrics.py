"""Conditional counts and sums, safe ratios, time distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickreports.config import FUNNEL_STEPS, PURCHASE


def is_event(name: str) -> Column:
    return F.col("event_name") == F.lit(name)


def is_purchase() -> Column:
    return is_event(PURCHASE)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for NULL)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def distinct_if(condition: Column, column: str | Column) -> Column:
    """Distinct values of ``column`` among rows meeting ``condition``.

    Two or more of these in one aggregate make Spark expand every input row, so
    the reports count in two steps instead (see ``operators.cells``).
    """
    return F.countDistinct(F.when(condition, _col(column)))


def sum_if(condition: Column, column: str | Column) -> Column:
    """Sum over rows meeting ``condition``; 0, not NULL, when there are none."""
    return F.sum(F.when(condition, _col(column)).otherwise(F.lit(0)))


def pct(part: str, whole: str) -> Column:
    """``part`` in percent of ``whole``, one decimal; 0 when ``whole`` is 0 or NULL.

    This and the other ratios take SQL expressions, most often column names: a report
    has many of them, and each is one call to the JVM that way.
    """
    return F.expr(f"coalesce(cast(round(100.0 * ({part}) / nullif({whole}, 0), 1) AS double), 0.0D)")


def drop_pct(part: str, previous: str) -> Column:
    """Loss from ``previous`` to ``part`` in percent, one decimal; 0 when undefined."""
    return pct(f"{previous} - {part}", previous)


def ratio(total: str, count: str, digits: int) -> Column:
    """``total / count`` rounded half up; 0 when ``count`` is 0 or NULL."""
    return F.expr(f"coalesce(round(cast({total} AS double) / nullif({count}, 0), {digits}), 0.0D)")


def money(amount: str) -> Column:
    """Exact decimal amount as the DOUBLE the reports show."""
    return F.expr(f"coalesce(cast({amount} AS double), 0.0D)")


def mean_hours(seconds: str) -> Column:
    """Mean of integer seconds in hours, one decimal; 0 without rows.

    Sums whole seconds first, so the result does not depend on row order.
    """
    return F.expr(f"coalesce(round(cast(sum({seconds}) AS double) / count({seconds}) / 3600.0D, 1), 0.0D)")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    return F.unix_timestamp(_col(end)) - F.unix_timestamp(_col(start))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def zero_if_null(column: str | Column) -> Column:
    return F.coalesce(_col(column), F.lit(0))


def iso_date(column: str | Column) -> Column:
    return F.date_format(_col(column), "yyyy-MM-dd")


def reached_steps() -> Column:
    """Aggregate: bit i is set when some row is funnel step i."""
    cases = " ".join(f"WHEN '{event}' THEN {1 << i}" for i, (event, _) in enumerate(FUNNEL_STEPS))
    return F.expr(f"bit_or(CASE event_name {cases} ELSE 0 END)")


def reached(bits: str, position: int) -> str:
    """SQL: 1 when step ``position`` is set in a ``reached_steps`` value, else 0."""
    return f"shiftright({bits}, {position}) & 1"


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
