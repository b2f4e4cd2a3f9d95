"""Users, orders and revenue over days, weekdays and hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickreports.functions import metrics as M
from clickreports.functions.categories import day_name
from clickreports.operators.cells import SOURCE, by_first_source, distinct_orders, merge_counts, over_sources
from clickreports.plans.marts import Marts


def daily_trend(m: Marts, by_source: bool = False) -> DataFrame:
    """Users, users who purchased that day, and their share, per day."""
    days = _people(m, by_source, date="event_date")
    return days.withColumn("conv_rate", M.pct("purchases", "users"))


def revenue_trend(m: Marts, by_source: bool = False) -> DataFrame:
    """Revenue and orders per day, counting only purchases with a transaction id."""
    days = _revenue_and_orders(m, by_source, "order_revenue", date="event_date")
    aov = M.ratio("revenue", "orders", 0)
    return days.withColumn("aov", aov).withColumn("revenue", M.money("revenue"))


def hourly_heatmap(m: Marts, by_source: bool = False) -> DataFrame:
    """Users, orders and revenue per weekday and hour."""
    return _activity(m, by_source, day="day_of_week", hour="event_hour").drop("purchases")


def hourly_revenue(m: Marts, by_source: bool = False) -> DataFrame:
    """Revenue and orders per hour."""
    hours = _revenue_and_orders(m, by_source, "revenue", hour="event_hour")
    return hours.withColumn("revenue", M.money("revenue"))


def day_of_week(m: Marts, by_source: bool = False) -> DataFrame:
    """Users, orders, revenue and share of users purchasing per weekday."""
    days = _activity(m, by_source, day="day_of_week")
    return (
        days.withColumn("day_name", day_name("day"))
        .withColumn("cvr", M.pct("purchases", "users"))
        .drop("purchases")
    )


def _activity(m: Marts, by_source: bool, **names: str) -> DataFrame:
    """Users, purchasing users, revenue and orders per key."""
    people = _people(m, by_source, F.sum("revenue").alias("revenue"), **names)
    both = merge_counts(_keys(by_source, names), people, _orders(m, by_source, names))
    return both.withColumn("revenue", M.money("revenue"))


def _people(m: Marts, by_source: bool, *sums, **names: str) -> DataFrame:
    """Distinct users and purchasing users per key, with further sums."""
    keys = [SOURCE, *names]
    per_user = _named(m.user_hours, names).groupBy(*keys, "uid").agg(F.max("purchased").alias("purchased"), *sums)
    counts = per_user.groupBy(*keys).agg(F.count(F.lit(1)).alias("users"), F.sum("purchased").alias("purchases"), *sums)
    return over_sources(counts, list(names), by_source)


def _revenue_and_orders(m: Marts, by_source: bool, revenue: str, **names: str) -> DataFrame:
    sums = _named(m.user_hours, names).groupBy(SOURCE, *names).agg(F.sum(revenue).alias("revenue"))
    sums = over_sources(sums, list(names), by_source)
    return merge_counts(_keys(by_source, names), sums, _orders(m, by_source, names))


def _orders(m: Marts, by_source: bool, names: dict[str, str]) -> DataFrame:
    return distinct_orders(_named(m.purchases, names), _keys(by_source, names))


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Expose the key columns under their report names."""
    return by_first_source(rows).withColumns({new: F.col(old) for new, old in names.items()})


def _keys(by_source: bool, names: dict[str, str]) -> list[str]:
    return [SOURCE, *names] if by_source else list(names)
