from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from clickreports import load_events, register
from clickreports.functions.categories import source_group
from clickreports.sources.events import EVENT_ID


def test_keeps_identified_users_since_the_first_day(spark, raw):
    table = raw(
        [
            {"uid": "U1", "ts": "2024-01-02 00:00:00"},
            {"uid": "U2", "ts": "2024-01-01 23:59:59"},
            {"uid": "u3", "ts": "2024-01-02 00:00:00"},
            {"uid": "G4", "ts": "2024-01-02 00:00:00"},
            {"uid": None, "ts": "2024-01-02 00:00:00"},
        ]
    )
    assert [r.uid for r in load_events(spark, table, "2024-01-02").collect()] == ["U1"]


def test_derives_types_hours_weekdays_and_zeros(events):
    row = events([{"ts": "2024-01-07 13:45:00", "traffic_source_source": "google"}]).first()
    assert (row.event_date, row.event_hour, row.day_of_week) == (dt.date(2024, 1, 7), 13, 1)  # a Sunday
    assert (row.revenue, row.engagement_msec, row.session_number) == (0, 0, None)
    assert row.source_group == "Search"


def test_both_bounds_reach_the_scan(spark, raw, tmp_path):
    path = f"{tmp_path}/raw"
    raw([{"uid": "U1"}]).write.parquet(path)
    view = load_events(spark, path, "2024-01-02").select("uid")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(user_id_final,U)" in plan
    assert "GreaterThanOrEqual(p_event_date,2024-01-02)" in plan
    read = plan.split("ReadSchema:")[1]
    assert "user_id_final" in read and "page_location" not in read


def test_prunes_days_of_a_partitioned_table(spark, raw, tmp_path):
    path = f"{tmp_path}/raw"
    days = [{"ts": f"2024-01-0{d} 10:00:00"} for d in (1, 2, 3)]
    raw(days).write.partitionBy("p_event_date").parquet(path)
    view = load_events(spark, path, "2024-01-03")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "p_event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert view.count() == 1


def test_text_dates_work_too(spark, raw):
    table = raw([{"ts": "2024-01-01 10:00:00"}, {"ts": "2024-01-02 10:00:00"}])
    text = table.withColumn("p_event_date", F.date_format("p_event_date", "yyyy-MM-dd"))
    assert [r.event_date for r in load_events(spark, text, "2024-01-02").collect()] == [dt.date(2024, 1, 2)]


def test_names_missing_and_mistyped_columns(spark, raw):
    table = raw([{}])
    with pytest.raises(ValueError, match="os, browser_final"):
        load_events(spark, table.drop("os", "browser_final"))
    with pytest.raises(ValueError, match="event_ts_th is string"):
        load_events(spark, table.withColumn("event_ts_th", F.lit("now")))


def test_no_date_keeps_old_rows(spark, raw):
    table = raw([{"ts": "1999-12-31 00:00:00"}, {"ts": "2030-01-01 00:00:00"}])
    assert load_events(spark, table).count() == 2
    assert load_events(spark, table, "2024-01-01").count() == 1


def test_ordered_operators_read_five_columns_at_most(spark, raw, tmp_path):
    from clickreports.operators import sequences, users

    raw([{}, {"name": "purchase"}]).write.parquet(f"{tmp_path}/events")
    table = spark.read.parquet(f"{tmp_path}/events")
    for src in (table, table.drop(EVENT_ID)):
        view = load_events(spark, src, "2024-01-01")
        for frame in (
            sequences.transition_links(sequences.user_transitions(view)),
            sequences.common_journeys(view),
            users.first_touch(view),
            users.purchase_sequence(view),
        ):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
            assert read and all(len(schema.split(",")) <= 5 for schema in read)


def test_is_a_named_view_for_sql(spark, events):
    register(events([{"uid": "U1"}, {"uid": "U2"}]))
    assert spark.sql("SELECT count(*) AS n FROM ga_events").first().n == 2


def test_source_groups(spark):
    expected = {
        None: "Direct",
        "": "Direct",
        "(direct)": "Direct",
        "(Direct)": "Others",
        "RichMenu_x": "LINE Richmenu",
        "my richmenu": "Others",
        "Google": "Search",
        "GoogleLine": "Search",
        "bing.com": "Search",
        "m.facebook.com": "Social",
        "TikTok": "Social",
        "online": "Social",
        "newsletter": "Others",
    }
    table = spark.createDataFrame([(s,) for s in expected], "source string")
    found = {r.source: r.g for r in table.select("source", source_group("source").alias("g")).collect()}
    assert found == expected
