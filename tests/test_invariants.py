"""Relations between reports that hold on any data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickreports import report
from clickreports.functions import metrics as M
from clickreports.plans import overview
from verification import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def m(spark):
    return registry.marts(spark, SF)


def total(frame, column):
    return frame.agg(F.sum(column)).first()[0]


def test_users_add_up(m):
    users = report(m, "meta").first().total_users
    assert total(report(m, "kpi", True), "total_users") == users
    assert total(report(m, "visit_frequency"), "users") == users
    engaged = report(m, "engagement_distribution")
    assert total(engaged, "purchasers") + total(engaged, "non_purchasers") == users
    assert total(report(m, "new_vs_returning"), "users") == total(report(m, "session_depth_cvr"), "users") <= users
    purchasers = report(m, "kpi").first().purchases
    assert total(report(m, "purchase_frequency"), "users") == purchasers
    assert all(row.users <= users for row in report(m, "funnel").collect())


def test_revenue_adds_up(m):
    revenue = total(report(m, "hourly_heatmap"), "revenue")
    for name in ("hourly_revenue", "day_of_week", "revenue_by_source"):
        assert total(report(m, name), "revenue") == revenue, name
    assert total(report(m, "revenue_trend"), "revenue") <= revenue


# Report, key columns, measures that add up over first-touch sources.
ADDITIVE = [
    ("daily_trend", ["date"], ["users", "purchases"]),
    ("purchase_frequency", ["purchases"], ["users"]),
    ("revenue_trend", ["date"], ["revenue"]),
    ("hourly_heatmap", ["day", "hour"], ["users", "revenue"]),
    ("new_vs_returning", ["type"], ["users", "revenue", "purchasers"]),
    ("session_depth_cvr", ["bucket"], ["users", "purchasers"]),
    ("engagement_distribution", ["bucket"], ["purchasers", "non_purchasers"]),
    ("hourly_revenue", ["hour"], ["revenue"]),
    ("day_of_week", ["day"], ["users", "revenue"]),
    ("device_category_cvr", ["device_category"], ["users", "purchasers"]),
    ("os_cvr", ["os"], ["users", "purchasers"]),
    ("page_path_cvr", ["path"], ["visitors", "purchasers"]),
    ("event_distribution_full", ["event"], ["events", "users"]),
    ("visit_frequency", ["bucket"], ["users"]),
]


@pytest.mark.parametrize(("name", "keys", "measures"), ADDITIVE)
def test_sources_add_up_to_the_overall_report(m, name, keys, measures):
    summed = report(m, name, True).groupBy(*keys).agg(*[F.sum(x).alias(x) for x in measures])
    columns = [*keys, *measures]
    overall = report(m, name).select(*columns).collect()
    assert sorted(map(tuple, summed.select(*columns).collect())) == sorted(map(tuple, overall))


def test_journeys_and_links(m):
    for row in report(m, "journeys").collect():
        assert 1 <= row.steps == len(row.path) <= 10
        assert all(a != b for a, b in zip(row.path, row.path[1:]))
    from clickreports.config import EVENT_DEPTH

    links = overview.sankey_links(m, min_users=5).collect()
    assert links and all(EVENT_DEPTH[r.source] < EVENT_DEPTH[r.target] for r in links)


def test_two_step_counts_equal_naive_distinct_counts(m):
    naive = m.events.groupBy(F.col("event_date").alias("date")).agg(
        F.countDistinct("uid").alias("users"), M.distinct_if(M.is_purchase(), "uid").alias("purchases")
    )
    two_step = report(m, "daily_trend").select("date", "users", "purchases")
    assert sorted(map(tuple, naive.collect())) == sorted(map(tuple, two_step.collect()))
