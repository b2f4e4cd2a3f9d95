"""Reports over small hand-made tables with results worked out by hand."""

from __future__ import annotations

import pytest

from clickreports import BY_SOURCE, OVERALL, report
from clickreports.operators import users
from clickreports.plans import dimensions, overview, segments, trends
from clickreports.sources.store import Store

DAY = "2024-01-0{} {:02d}:00:00"


def buy(uid, day=1, hour=0, rev=100, txn=None, **more):
    return {"uid": uid, "name": "purchase", "ts": DAY.format(day, hour), "rev": rev, "txn": txn, **more}


def see(uid, day=1, hour=0, name="page_view", **more):
    return {"uid": uid, "name": name, "ts": DAY.format(day, hour), **more}


def table(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_first_touch_goes_by_time_then_row_key_with_unknown_times_first(events):
    rows = [
        see("U1", day=2, traffic_source_source="google"),
        see("U1", day=1, traffic_source_source=None),
        see("U2", id=20, traffic_source_source="facebook"),
        see("U2", id=10, traffic_source_source="bing"),
        see("U3", traffic_source_source="bing"),
        {"uid": "U3", "ts": None, "traffic_source_source": "newsletter"},
    ]
    found = dict(table(users.first_touch(events(rows)), "uid", "source_group"))
    assert found == {"U1": "Direct", "U2": "Search", "U3": "Others"}


def test_purchase_sequence_breaks_ties_by_row_key(events):
    rows = [buy("U1", id=9), buy("U1", id=7), buy("U1", day=2, id=1), see("U2")]
    found = table(users.purchase_sequence(events(rows)), "uid", "purchase_seq", "event_id")
    assert found == [("U1", 1, 7), ("U1", 2, 9)]
    assert table(users.purchasers(events(rows)), "uid") == [("U1",)]


def test_kpi(marts):
    rows = [
        see("U1", hour=0),
        buy("U1", hour=2),
        buy("U1", hour=5),
        buy("U2", hour=1),  # first event: no time to first purchase
        see("U3", hour=1),
        see("U3", hour=2),
    ]
    row = report(marts(rows), "kpi").first()
    assert row.asDict() == {
        "total_users": 3,
        "conversion_rate": 66.7,
        "purchases": 2,
        "avg_events_per_user": 2.0,
        "avg_hours_to_first_purchase": 2.0,
        "avg_hours_to_repeat": 3.0,
        "repeat_purchase_pct": 50.0,
    }


def test_kpi_per_source_gives_true_and_joined_user_counts(marts):
    rows = [see("U1"), buy("U2"), *[buy("U3", hour=h) for h in (1, 2, 3)]]
    row = report(marts(rows), "kpi", by_source=True).first()
    assert (row.source_group, row.total_users, row.purchases) == ("Direct", 3, 2)
    assert (row.total_users_joined, row.conversion_rate, row.conversion_rate_joined) == (5, 66.7, 40.0)


def test_kpi_counts_two_purchase_rows_of_one_transaction_as_a_repeat(marts):
    row = report(marts([buy("U1", txn="T1"), buy("U1", hour=1, txn="T1")]), "kpi").first()
    assert (row.repeat_purchase_pct, row.avg_hours_to_repeat) == (100.0, 1.0)


def test_two_attributions(marts):
    m = marts([see("U1", hour=0), see("U1", hour=1, traffic_source_source="google", name="purchase")])
    assert table(report(m, "funnel_by_source"), "source", "total_users", "Purchase") == [
        ("Direct", 1, 0),
        ("Search", 1, 1),
    ]
    assert table(report(m, "kpi", by_source=True), "source_group", "purchases") == [("Direct", 1)]


def test_funnel_with_a_step_nobody_reaches(marts):
    m = marts([see("U1", name="view_item_list"), see("U2", name="view_cart"), see("U3"), see("U4")])
    rows = report(m, "funnel").collect()
    assert [(r.step, r.users, r.pct_of_total, r.drop_off_pct) for r in rows][:5] == [
        ("Total Users", 4, 100.0, 0.0),
        ("View Items", 1, 25.0, 0.0),
        ("Add to Cart", 0, 0.0, 100.0),
        ("View Cart", 1, 25.0, 0.0),  # after an empty step: undefined, shown as 0
        ("Begin Checkout", 0, 0.0, 100.0),
    ]
    per_source = report(m, "funnel", by_source=True).collect()
    assert per_source[1].drop_off_pct == 75.0  # the first step counts against all users here


def test_empty_table(spark, marts):
    m = marts([see("X1")], Store(spark))
    meta = report(m, "meta").first()
    assert (meta.total_events, meta.total_users, meta.num_days, meta.date_from) == (0, 0, 0, None)
    assert report(m, "kpi").first().conversion_rate == 0
    assert [r.users for r in report(m, "funnel").collect()] == [0] * 7
    for name in OVERALL.keys() - {"meta", "kpi", "funnel"}:
        assert report(m, name).count() == 0, name
    for name in BY_SOURCE:
        assert report(m, name, by_source=True).count() == 0, name


def test_meta(marts):
    row = report(marts([see("U1"), see("U1", day=3), see("U2", day=3)]), "meta").first()
    assert (row.total_events, row.total_users, str(row.date_from), str(row.date_to), row.num_days) == (
        3,
        2,
        "2024-01-01",
        "2024-01-03",
        2,
    )


def test_blank_and_missing_platforms_are_two_unknown_rows(marts):
    m = marts([see("U1", platform=""), see("U2"), see("U2", platform="WEB"), buy("U3", platform="WEB")])
    columns = ("platform", "users", "purchasers")
    assert table(report(m, "platform_distribution"), *columns) == [
        ("Unknown", 1, 0),
        ("Unknown", 1, 0),
        ("WEB", 2, 1),
    ]
    merged = overview.platform_distribution(m, merge_labels=True)
    assert table(merged, *columns) == [("Unknown", 2, 0), ("WEB", 2, 1)]


def test_purchaser_here_and_ever(marts):
    m = marts([see("U1", day=1, platform="IOS", os="iOS"), buy("U1", day=2, platform="WEB", os="mac")])
    assert table(report(m, "platform_distribution"), "platform", "purchasers") == [("IOS", 0), ("WEB", 1)]
    assert table(report(m, "os_cvr"), "os", "purchasers", "cvr") == [("iOS", 1, 100.0), ("mac", 1, 100.0)]
    assert table(report(m, "daily_trend"), "purchases", "conv_rate") == [(0, 0.0), (1, 100.0)]


def test_dimension_labels(marts):
    m = marts([see("U1"), see("U2", os="Unknown")])
    assert table(report(m, "os_cvr"), "os", "users") == [("Unknown", 1), ("Unknown", 1)]
    merged = dimensions.dimension_cvr(m, "os", "os", merge_labels=True)
    assert table(merged, "os", "users") == [("Unknown", 2)]
    assert table(report(m, "traffic_source_medium_cvr"), "medium", "users") == [("(not set)", 2)]


def test_top_values_break_ties_by_key(marts):
    rows = [see(f"U{u}", browser_final=f"b{b:02d}") for b in range(20) for u in range(2)]
    rows.append(see("U9", browser_final="b19"))
    found = [r.browser for r in report(marts(rows), "browser_cvr").collect()]
    assert found == ["b19", *[f"b{b:02d}" for b in range(14)]]


def test_revenue_needs_a_transaction_only_in_the_trend(marts):
    m = marts([buy("U1", rev=10, txn="T1"), buy("U1", rev=20, txn="T1"), buy("U2", rev=40)])
    assert table(report(m, "revenue_trend"), "revenue", "orders", "aov") == [(30.0, 1, 30.0)]
    assert table(report(m, "hourly_revenue"), "revenue", "orders") == [(70.0, 1)]
    assert table(report(m, "hourly_heatmap"), "users", "revenue", "orders") == [(2, 70.0, 1)]


def test_days_without_purchases_stay(marts):
    m = marts([see("U1", day=1), buy("U1", day=2, txn="T")])
    found = [(str(r.date), r.revenue, r.orders, r.aov) for r in report(m, "revenue_trend").collect()]
    assert found == [("2024-01-01", 0.0, 0, 0.0), ("2024-01-02", 100.0, 1, 100.0)]


def test_unknown_hour_is_a_group_of_its_own(marts):
    m = marts([{"uid": "U1", "name": "purchase", "ts": None, "rev": 5, "txn": "T"}])
    assert table(report(m, "hourly_revenue"), "hour", "revenue", "orders") == [(None, 5.0, 1)]


def test_order_shared_by_two_sources_is_split_per_source(marts):
    m = marts([buy("U1", rev=60, txn="T"), buy("U2", rev=60, txn="T", traffic_source_source="google")])
    columns = ("bucket", "orders", "avg_value")
    assert table(report(m, "aov_distribution"), *columns) == [("100-499", 1, 120.0)]
    assert table(report(m, "aov_distribution", by_source=True), "source_group", *columns) == [
        ("Direct", "0-99", 1, 60.0),
        ("Search", "0-99", 1, 60.0),
    ]
    assert table(report(m, "revenue_by_source"), "source", "revenue", "orders") == [
        ("Direct", 60.0, 1),
        ("Search", 60.0, 1),
    ]
    assert table(segments.order_values(m), "transaction_id", "order_value") == [("T", 120)]


def test_sessions(marts):
    m = marts(
        [
            see("U1", ga_session_number=1),
            see("U1", ga_session_number=7),
            buy("U2", ga_session_number=2),
            see("U3"),
            see("U4", ga_session_number=0),
        ]
    )
    assert table(report(m, "new_vs_returning"), "type", "users", "revenue", "purchasers", "cvr") == [
        ("New", 1, 0.0, 0, 0.0),
        ("Returning", 1, 100.0, 1, 100.0),
    ]
    rows = report(m, "session_depth_cvr").collect()
    assert [(r.bucket, r.users, r.purchasers) for r in rows] == [("2", 1, 1), ("6-10", 1, 0)]


def test_engagement_buckets_follow_their_own_order(marts):
    m = marts(
        [
            see("U1", engagement_time_msec=700_000),
            see("U2", engagement_time_msec=6_000),
            see("U2", engagement_time_msec=6_000),
            buy("U3", engagement_time_msec=15_000),
        ]
    )
    rows = report(m, "engagement_distribution").collect()
    assert [tuple(r) for r in rows] == [("10-30s", 1, 1), ("10m+", 0, 1)]


def test_pseudo_ids_with_none_sort_by_their_smallest_count(marts):
    rows = [see("U0")]
    for count in (1, 2, 3, 5, 10, 11):
        rows += [see(f"U{count}", user_pseudo_id=f"P{i}") for i in range(count)]
    found = [tuple(r) for r in report(marts(rows), "visit_frequency").collect()]
    assert found == [("4-5", 2), ("1", 1), ("2", 1), ("3", 1), ("6-10", 1), ("11+", 1)]


def test_purchase_frequency(marts):
    m = marts([buy("U1"), buy("U2"), buy("U2", hour=1), see("U3")])
    assert [tuple(r) for r in report(m, "purchase_frequency").collect()] == [(1, 1), (2, 1)]


def test_day_of_week(marts):
    m = marts([see("U1", day=7), buy("U2", day=7, txn="T"), see("U1", day=1)])
    assert [tuple(r) for r in report(m, "day_of_week").collect()] == [
        (1, "Sun", 2, 1, 100.0, 50.0),
        (2, "Mon", 1, 0, 0.0, 0.0),
    ]


def test_top_items(marts):
    m = marts(
        [
            buy("U1", rev=10, txn="T1", first_item_name="a"),
            buy("U2", rev=10, txn="T1", first_item_name="a"),
            buy("U2", rev=30, first_item_name="b"),
            see("U3", first_item_name="c"),
            see("U3", first_item_name=""),
            buy("U4", rev=99),
        ]
    )
    assert [tuple(r) for r in report(m, "top_items").collect()] == [
        ("b", 30.0, 0, 1),
        ("a", 20.0, 1, 2),
        ("c", 0.0, 0, 0),
    ]


def test_referrers_count_a_user_once_per_url_unless_exact(marts):
    m = marts(
        [
            see("U1", page_referrer="https://a.com/1"),
            see("U1", page_referrer="https://a.com/2"),
            buy("U2", page_referrer="https://a.com/1"),
            see("U3", page_referrer=""),
            see("U4"),
        ]
    )
    columns = ("domain", "users", "purchasers")
    assert table(report(m, "page_referrer_cvr"), *columns) == [("(direct)", 2, 0), ("a.com", 3, 1)]
    exact = dimensions.page_referrer_cvr(m, exact=True)
    assert table(exact, *columns) == [("(direct)", 2, 0), ("a.com", 2, 1)]


def test_referrers_are_summed_over_all_urls_unless_cut(marts):
    rows = [see(f"U{u}", page_referrer=f"https://d{d:02d}.com/") for d in range(60) for u in range(1 + (d < 50))]
    rows += [see("U1", page_referrer=f"https://many.com/{i}") for i in range(100)]
    m = marts(rows)
    overall = dict(table(report(m, "page_referrer_cvr"), "domain", "users"))
    assert overall["many.com"] == 100 and len(overall) == 20
    assert report(m, "page_referrer_cvr", k=None).count() == 61
    assert "many.com" not in dict(table(report(m, "page_referrer_cvr", urls=50), "domain", "users"))
    per_source = report(m, "page_referrer_cvr", by_source=True).collect()
    assert (per_source[0].domain, per_source[0].users, len(per_source)) == ("many.com", 100, 20)


def test_page_paths_leave_out_events_without_a_page(marts):
    m = marts([see("U1", page_location="https://s/cart"), buy("U1"), see("U2", page_location="https://s/")])
    assert [tuple(r) for r in report(m, "page_path_cvr").collect()] == [
        ("/cart", 1, 1, 100.0),
        ("/ (home)", 1, 0, 0.0),
    ]


def test_event_distribution(marts):
    m = marts([see("U1"), see("U1"), see("U2", name="login")])
    assert [tuple(r) for r in report(m, "event_distribution").collect()] == [("page_view", 2, 1), ("login", 1, 1)]


def test_unknown_report(marts):
    with pytest.raises(KeyError):
        report(marts([see("U1")]), "no_such_report")


def test_heatmap_columns(marts):
    assert set(trends.hourly_heatmap(marts([see("U1")])).columns) == {"day", "hour", "users", "orders", "revenue"}
