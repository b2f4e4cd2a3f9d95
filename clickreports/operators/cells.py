"""Two-step distinct counting: one row per (user, value), then counts of rows.

The first step combines on the map side and shuffles on (uid, value), so neither a
hot user nor a hot value gathers its events in one task. The second step counts the
now unique rows, again combined on the map side. The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = "source_group"


def user_cells(events: DataFrame, by: Sequence[str], *measures: Column) -> DataFrame:
    """One row per user and combination of ``by``, with ``measures`` aggregated."""
    keys = ["uid", *by]
    return events.groupBy(*keys).agg(*measures) if measures else events.select(*keys).distinct()


def attribute(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Add each user's first-touch source and ever-purchaser flag.

    Every uid has exactly one row in ``users``, so this neither drops nor repeats
    rows. The strategy is left to the planner.
    """
    return rows.join(users.select("uid", "first_source", "is_purchaser"), "uid")


def by_first_source(rows: DataFrame) -> DataFrame:
    """Name a pre-aggregate's first-touch source as the per-source reports do.

    Where the rows also hold the event's own group, the user's first one replaces it.
    """
    return rows.drop(SOURCE).withColumnRenamed("first_source", SOURCE)


def over_sources(
    counts: DataFrame, by: Sequence[str], by_source: bool, lowest: Sequence[str] = ()
) -> DataFrame:
    """Per-source counts as they are, or added up over the sources.

    A user has one first-touch source, so counts of users add up; ``lowest`` columns
    take the minimum. Both forms of a report share the costly step below this one, and
    Spark runs it once when they are part of one query.
    """
    if by_source:
        return counts
    measures = [name for name in counts.columns if name not in (SOURCE, *by)]
    return counts.groupBy(*by).agg(
        *[F.expr(f"{'min' if name in lowest else 'sum'}({name}) AS {name}") for name in measures]
    )


def distinct_orders(purchases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct transactions per ``by``; purchases without an id are no orders."""
    ids = purchases.where(F.col("transaction_id").isNotNull()).select(*by, "transaction_id").distinct()
    return ids.groupBy(*by).agg(F.count(F.lit(1)).alias("orders"))


def merge_counts(by: Sequence[str], *parts: DataFrame) -> DataFrame:
    """Put per-``by`` measures of several aggregates side by side; absent ones are 0.

    A union and a sum rather than joins: NULL keys meet, and no side is repeated.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    measures = [name for name in merged.columns if name not in by]
    return merged.groupBy(*by).agg(*[F.expr(f"coalesce(sum({name}), 0) AS {name}") for name in measures])
