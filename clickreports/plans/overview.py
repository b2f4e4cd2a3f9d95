"""Totals, headline figures, funnels, event graph and journeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickreports import config
from clickreports.functions import metrics as M
from clickreports.functions.categories import or_default
from clickreports.operators.cells import SOURCE, by_first_source, over_sources
from clickreports.operators.sequences import common_journeys, link_nodes, transition_links
from clickreports.plans.marts import Marts


def meta(m: Marts) -> DataFrame:
    """Number of events and users, and the days covered."""
    users = m.users.agg(F.sum("event_count").alias("total_events"), F.count(F.lit(1)).alias("total_users"))
    days = m.user_hours.select("event_date").distinct()
    both = users.unionByName(days, allowMissingColumns=True)
    return both.agg(
        M.zero_if_null(F.max("total_events")).alias("total_events"),
        M.zero_if_null(F.max("total_users")).alias("total_users"),
        F.min("event_date").alias("date_from"),
        F.max("event_date").alias("date_to"),
        F.count("event_date").alias("num_days"),
    )


def kpi(m: Marts, by_source: bool = False) -> DataFrame:
    """Headline figures of all users, or of the users first touched by each source.

    ``purchases`` counts purchasers. The per-source form adds ``total_users_joined``,
    a count that takes a user once per purchase event (at least once), and the
    conversion rate over it.
    """
    seconds = "unix_timestamp({}) - unix_timestamp({})".format
    to_first = f"if(first_touch < first_purchase_ts, {seconds('first_purchase_ts', 'first_touch')}, NULL)"
    to_second = seconds("second_purchase_ts", "first_purchase_ts")
    users, buyers = "count(*)", "sum(is_purchaser)"
    joined = "sum(greatest(purchase_count, 1))"
    figures = [
        F.expr(f"{users} AS total_users"),
        M.pct(buyers, users).alias("conversion_rate"),
        F.expr(f"coalesce({buyers}, 0) AS purchases"),
        M.ratio("sum(event_count)", users, 1).alias("avg_events_per_user"),
        M.mean_hours(to_first).alias("avg_hours_to_first_purchase"),
        M.mean_hours(to_second).alias("avg_hours_to_repeat"),
        M.pct("count_if(purchase_count > 1)", buyers).alias("repeat_purchase_pct"),
    ]
    if not by_source:
        return m.users.agg(*figures)
    return by_first_source(m.users).groupBy(SOURCE).agg(
        *figures,
        F.expr(f"{joined} AS total_users_joined"),
        M.pct(buyers, joined).alias("conversion_rate_joined"),
    )


def funnel(m: Marts) -> DataFrame:
    """Distinct users per step in any order, share of all users, loss per step."""
    counts = m.users.agg(F.count(F.lit(1)).alias("total_users"), *_step_counts())
    return drop_off(counts, first_step_drop=False)


def funnel_source_counts(m: Marts) -> DataFrame:
    """Users and funnel steps by the source of the event itself.

    A user whose events came from several sources counts in each of them.
    """
    per_user = m.user_dimensions.groupBy("source_group", "uid").agg(F.bit_or("steps").alias("steps"))
    return per_user.groupBy("source_group").agg(F.count(F.lit(1)).alias("total_users"), *_step_counts())


def funnel_by_source(m: Marts, by_source: bool = False) -> DataFrame:
    """One row per event-level source, with a column per step."""
    counts = funnel_source_counts(m)
    named = counts.select(
        *([F.col("source_group")] if by_source else []),
        F.col("source_group").alias("source"),
        "total_users",
        *[F.col(event).alias(label) for event, label in config.FUNNEL_STEPS],
    )
    return named


def funnel_per_source(m: Marts) -> DataFrame:
    """The funnel steps of each event-level source; the first step can lose users too."""
    return drop_off(funnel_source_counts(m), first_step_drop=True)


def drop_off(counts: DataFrame, first_step_drop: bool) -> DataFrame:
    """Turn step columns into one row per step with its share and its loss.

    ``counts`` has ``total_users`` and one column per funnel event; all other columns
    are kept. The row of all users comes first.
    """
    event, label = config.FUNNEL_TOTAL_STEP
    rows = [_step(0, label, event, "total_users", None)]
    previous = "total_users"
    for number, (event, label) in enumerate(config.FUNNEL_STEPS, start=1):
        rows.append(_step(number, label, event, event, previous if number > 1 or first_step_drop else None))
        previous = event
    kept = [name for name in counts.columns if name != "total_users" and name not in dict(config.FUNNEL_STEPS)]
    return counts.select(*kept, F.inline(F.array(*rows)))


def sankey_links(
    m: Marts,
    min_users: int = config.LIMITS.transition_min_users,
    limit: int = config.LIMITS.transition_links,
    limit_first: bool = False,
) -> DataFrame:
    return transition_links(m.user_transitions, min_users, limit, limit_first=limit_first)


def sankey_nodes(
    m: Marts,
    min_users: int = config.LIMITS.transition_min_users,
    limit: int = config.LIMITS.transition_links,
    limit_first: bool = False,
) -> DataFrame:
    return link_nodes(sankey_links(m, min_users, limit, limit_first))


def journeys(
    m: Marts, steps: int = config.LIMITS.journey_steps, limit: int = config.LIMITS.journey_paths
) -> DataFrame:
    return common_journeys(m.events, steps, limit)


def event_distribution(m: Marts, by_source: bool = False) -> DataFrame:
    """Events and users per event name."""
    counts = by_first_source(m.user_event_names).groupBy(SOURCE, F.col("event_name").alias("event")).agg(
        F.sum("events").alias("events"), F.count(F.lit(1)).alias("users")
    )
    return over_sources(counts, ["event"], by_source)


def platform_distribution(m: Marts, merge_labels: bool = False) -> DataFrame:
    """Users, and users who purchased there, per platform.

    Groups by the raw value, so blank and missing platforms give a row each, both
    labelled unknown; ``merge_labels`` groups by the label instead.
    """
    label = or_default("platform", config.UNKNOWN, blank_too=True)
    rows = m.user_dimensions.withColumn("platform_key", label if merge_labels else F.col("platform"))
    per_user = rows.groupBy("platform_key", "uid").agg(F.max("purchased").alias("purchased"))
    counted = per_user.groupBy("platform_key").agg(
        F.count(F.lit(1)).alias("users"), F.sum("purchased").alias("purchasers")
    )
    return counted.withColumn("platform", or_default("platform_key", config.UNKNOWN, blank_too=True))


def _step_counts() -> list[Column]:
    return [
        F.expr(f"coalesce(sum({M.reached('steps', position)}), 0) AS {event}")
        for position, (event, _) in enumerate(config.FUNNEL_STEPS)
    ]


def _step(number: int, label: str, event: str, users: str, previous: str | None) -> Column:
    return F.struct(
        F.lit(number).alias("step_no"),
        F.lit(label).alias("step"),
        F.lit(event).alias("event"),
        F.col(users).alias("users"),
        (F.lit(100.0) if users == "total_users" else M.pct(users, "total_users")).alias("pct_of_total"),
        (F.lit(0.0) if previous is None else M.drop_pct(users, previous)).alias("drop_off_pct"),
    )
