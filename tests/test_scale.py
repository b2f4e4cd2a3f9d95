"""What must hold so that the plans survive large and uneven data."""

from __future__ import annotations

import re

import pytest

from clickreports import BY_SOURCE, OVERALL, report
from clickreports.operators import users
from clickreports.operators.cells import attribute, user_cells
from clickreports.plans.marts import Marts
from clickreports.sources.store import Store
from verification import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def m(spark):
    return registry.marts(spark, SF)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


ALL = [(name, False) for name in OVERALL] + [(name, True) for name in BY_SOURCE]


@pytest.mark.parametrize(("name", "by_source"), ALL)
def test_no_report_multiplies_rows_or_runs_python(m, name, by_source):
    plan = plan_of(report(m, name, by_source))
    for operator in ("Expand", "CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert operator not in plan
    # No window without a partition gathers a report's rows before they are aggregated.
    assert not re.search(r"Window \[[^\n]*\], \[\], \[", plan)


@pytest.mark.parametrize("name", sorted(OVERALL.keys() - {"journeys"}))
def test_reports_read_pre_aggregates_only(m, name):
    assert "raw_events" not in plan_of(report(m, name)), name


def test_profile_cuts_purchases_before_the_shuffle(m):
    plan = plan_of(users.purchase_sequence(m.events))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_top_values_per_source_are_cut_before_the_shuffle(m):
    plan = plan_of(report(m, "browser_cvr", by_source=True))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "TakeOrderedAndProject" in plan_of(report(m, "browser_cvr"))


def test_links_and_nodes_share_one_scan_of_the_events(m):
    from clickreports.operators.sequences import only_events, user_transitions
    from clickreports.config import EVENT_LABELS

    m.user_transitions  # noqa: B018
    for name, limits in (("sankey_links", {}), ("sankey_nodes", {}), ("sankey_links", {"min_users": 5})):
        plan = plan_of(report(m, name, **limits))
        assert "raw_events" not in plan and "user_transitions" in plan
    # The landed table itself: one scan and one shuffle of the events, used twice.
    pairs = user_transitions(only_events(m.events, EVENT_LABELS))
    pairs.collect()
    assert "ReusedExchange" in plan_of(pairs).split("== Initial Plan ==")[0]


def test_a_hot_user_is_split_when_cells_meet_users(spark, raw, tmp_path):
    """One user holds most (user, URL) pairs; adaptive execution splits its partition."""
    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key) for key in confs}
    try:
        for key, value in confs.items():
            spark.conf.set(key, value)
        pairs = spark.range(60_000).selectExpr(
            "CASE WHEN id % 3 = 0 THEN concat('U', id) ELSE 'U7' END AS uid",
            "concat('https://example.com/', sha1(string(id))) AS page_referrer",
        )
        store = Store(spark, f"{tmp_path}/store")
        people = pairs.selectExpr("uid", "'Direct' AS first_source", "0 AS is_purchaser").distinct()
        joined = attribute(user_cells(pairs, ["page_referrer"]), store.land("users", people))
        joined.write.parquet(f"{tmp_path}/joined")
        counted = joined.selectExpr("count(*) AS n", "count_if(uid = 'U7') AS hot").first()
        joined.collect()
        assert "skew=true" in plan_of(joined)
        assert (counted.n, counted.hot) == (60_000, 40_000)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


SAMPLE = ["kpi", "funnel", "daily_trend", "hourly_heatmap", "browser_cvr", "page_referrer_cvr", "top_items", "journeys"]


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_results_do_not_depend_on_partitions_or_row_order(spark, m, partitions):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.shuffle.partitions")
    shuffled = Marts(m.events.orderBy(F.rand(3)).repartition(5))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = {name: report(shuffled, name).collect() for name in SAMPLE}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {name: report(m, name).collect() for name in SAMPLE}


def test_without_a_store_the_plans_stay_lazy_and_agree(m):
    lazy = Marts(m.events)
    for name in ("kpi", "hourly_heatmap", "revenue_by_source", "page_path_cvr"):
        assert report(lazy, name).collect() == report(m, name).collect()


def test_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    from clickreports.sources.store import shared_folder

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_named_shared_folder_is_used():
    class Conf:
        def get(self, key, default=None):
            return "hdfs://shared/checkpoints/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    from clickreports.sources.store import shared_folder

    assert shared_folder(Session()) == "hdfs://shared/checkpoints"


def test_a_closed_store_leaves_nothing(spark, tmp_path):
    with Store(spark, f"{tmp_path}/store") as store:
        assert store.land("numbers", spark.range(3)).count() == 3
    assert not (tmp_path / "store").exists()


def test_section_rows_gather_nothing(m):
    from clickreports.plans.bundle import section_entries

    for name in ("event_distribution", "daily_trend", "device_category_cvr"):
        plan = plan_of(section_entries(m, name))
        assert "SinglePartition" not in plan and "collect_list" not in plan


def test_the_document_is_put_together_in_many_tasks(m):
    from clickreports.plans.bundle import bundle

    lines = bundle(m)
    plan = plan_of(lines)
    assert "SinglePartition" not in plan and "collect_list" not in plan and "Window" not in plan
    numbers = [r.line for r in lines.select("line").collect()]
    assert sorted(numbers) == list(range(len(numbers)))


def test_without_ids_a_hot_moment_is_a_row_per_name(spark):
    """A third of the events are one user's, at unknown time and of one name, and none has an id."""
    from pyspark.sql import functions as F

    from clickreports.operators import sequences

    number = F.col("id")
    rows = spark.range(0, 60_000, 1, 12).select(
        F.when(number % 3 == 0, "U0").otherwise(F.concat(F.lit("U"), number)).alias("uid"),
        F.when(number % 3 != 0, F.timestamp_seconds(F.lit(1_704_067_200) + number)).cast("timestamp_ntz").alias("event_ts"),
        F.lit("login").alias("event_name"),
    )
    before = {key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # The window's shuffle deals by user and slice, or by user: count the rows that meet.
        for key in (["uid", "slice"], ["uid"]):
            met = sequences.with_slice(sequences.run_lengths(rows)).repartition(*key)
            counts = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
            assert max(counts) <= 2 * sum(counts) / 16
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sequences.collapse_repeats(rows).where("uid = 'U0'").count() == 1


@pytest.mark.parametrize("known_times", [True, False])
def test_a_hot_user_in_one_hour_is_cut_in_slices(spark, events, known_times):
    """One user with a third of the events, all in an hour or all at unknown times."""
    from pyspark.sql import functions as F

    from clickreports.operators import sequences

    ids = spark.range(60_000).withColumnRenamed("id", "event_id")
    hot = F.col("event_id") % 3 == 0
    second = F.when(hot, F.col("event_id") / 60_000 * 3600).otherwise(F.col("event_id"))
    moment = F.timestamp_seconds(F.lit(1_704_067_200) + second).cast("timestamp_ntz")
    rows = ids.select(
        F.when(hot, F.lit("U0")).otherwise(F.concat(F.lit("U"), F.col("event_id"))).alias("uid"),
        (moment if known_times else F.when(~hot, moment)).alias("event_ts"),
        "event_id",
        F.lit("login").alias("event_name"),
    )
    sliced = sequences.with_slice(rows).groupBy("uid", "slice").count()
    # No window holds more than a small share of the hot user's 20,000 events.
    assert sliced.agg(F.max("count")).first()[0] <= 1400
