"""Every query by name, as a function of a session and a test-table folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickreports.config import EVENT_LABELS, PATH_SEPARATOR
from clickreports.functions import categories as C
from clickreports.functions import metrics as M
from clickreports.operators import sequences, users
from clickreports.plans import dimensions, overview, segments
from clickreports.plans.bundle import ALL, SANKEY_PARTS, SINGLE_ROW, bundle
from clickreports.plans.catalog import BY_SOURCE, OVERALL, Report, report
from clickreports.plans.marts import Marts
from clickreports.sources.events import load_events, register
from clickreports.sources.store import Store
from verification.oracle import DECIMALS
from verification.binding import DATE_FROM, raw_events

Query = Callable[[SparkSession, str], DataFrame]

VIEW_SQL = """SELECT uid, event_date, event_name, count(*) AS events, max(source_group) AS last_group
FROM ga_events GROUP BY uid, event_date, event_name"""

_OPEN: dict[tuple[str, str], tuple[Marts, DataFrame]] = {}


def marts(spark: SparkSession, sf_dir: str) -> Marts:
    """The test tables as an event table, with its pre-aggregates.

    The derived event table is written once per session and folder; the
    pre-aggregates follow as queries first ask for them.
    """
    return _opened(spark, sf_dir)[0]


def _opened(spark: SparkSession, sf_dir: str) -> tuple[Marts, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        store = Store(spark)
        raw = store.land("raw_events", raw_events(spark, sf_dir))
        _OPEN[key] = Marts(register(load_events(spark, raw)), store), raw
    return _OPEN[key]


def _base_view_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base view from a date on."""
    return load_events(spark, _opened(spark, sf_dir)[1], DATE_FROM)


def _over_marts(build: Callable[[Marts], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(marts(spark, sf_dir))


def _journeys(m: Marts) -> DataFrame:
    """The journeys report with each path as one text."""
    return report(m, "journeys").withColumn("path", F.array_join("path", PATH_SEPARATOR))


def _without_ids(m: Marts) -> DataFrame:
    """The events as a table without row key, their times cut to the hour so that many tie."""
    return m.events.drop("event_id").withColumn("event_ts", F.date_trunc("hour", "event_ts").cast("timestamp_ntz"))


def _listed(m: Marts) -> DataFrame:
    return sequences.only_events(m.events, EVENT_LABELS)


def _user_paths(m: Marts) -> DataFrame:
    paths = sequences.user_paths(sequences.first_steps(_listed(m), 10))
    return paths.withColumn("path", F.array_join("path", PATH_SEPARATOR))


def _user_profile(m: Marts) -> DataFrame:
    return m.users.drop("steps").withColumn("revenue", M.money("revenue"))


def _order_values(m: Marts) -> DataFrame:
    orders = segments.order_values(m).withColumn("bucket", C.order_value_bucket("order_value"))
    return orders.withColumn("order_value", M.money("order_value"))


def _user_buckets(m: Marts) -> DataFrame:
    known = F.col("max_session").isNotNull()
    return m.users.select(
        "uid",
        F.when(known, C.session_bucket("max_session")).alias("session_bucket"),
        C.engagement_bucket("engagement_msec").alias("engagement_bucket"),
        C.pseudo_id_bucket("pseudo_ids").alias("pseudo_id_bucket"),
    )


def _purchase_delays(m: Marts) -> DataFrame:
    touched_before = m.users.where(F.col("first_touch") < F.col("first_purchase_ts"))
    return touched_before.select(
        "uid",
        M.hours_between("first_touch", "first_purchase_ts").alias("hours_to_first"),
        M.hours_between("first_purchase_ts", "second_purchase_ts").alias("hours_to_second"),
    )


def _bundle_items(m: Marts) -> DataFrame:
    """Number of entries of every list in the document, counted on its lines."""
    lists = bundle(m).where(~F.col("section").isin("", "sankey", "by_source", *SINGLE_ROW))
    counted = lists.groupBy("scope", "section").agg(F.count_if("is_entry").alias("items"))
    parts = F.create_map(*[F.lit(x) for name, part in SANKEY_PARTS.items() for x in (part, name)])
    nested = F.col("section").isin(*SANKEY_PARTS.values())
    return counted.select(
        F.when(nested, "sankey").otherwise(F.col("scope")).alias("scope"),
        F.when(nested, parts[F.col("section")]).otherwise(F.col("section")).alias("section"),
        "items",
    )


def _report_rows(m: Marts) -> DataFrame:
    """Every entry of the document, read back from its text, as one line per entry.

    Decimals are written in hundredths, so that engines need not agree on their digits.
    """
    columns = []
    for reports, scope in ((OVERALL, ALL), (BY_SOURCE, "source")):
        for name, one in reports.items():
            columns += [F.lit(f"{scope}/{name}"), F.array(*[F.lit(c) for c in one.columns if c != "source_group"])]
    text = F.regexp_replace(F.regexp_replace("text", '^\\s*"(meta|kpi)" : ', ""), ",$", "")
    entries = bundle(m).where("is_entry").select("scope", "section", F.from_json(text, "map<string,string>").alias("e"))
    scope = F.when(F.col("scope") == ALL, ALL).otherwise("source")
    entries = entries.withColumn("columns", F.create_map(*columns)[F.concat_ws("/", scope, "section")])

    def as_text(name):
        value = F.col("e")[name]
        hundredths = F.round(value.cast("double") * 100).cast("bigint").cast("string")
        path = F.array_join(F.from_json(value, "array<string>"), PATH_SEPARATOR)
        listed = (F.col("section") == "journeys") & (name == "path")
        return F.coalesce(F.when(name.isin(*DECIMALS), hundredths).when(listed, path).otherwise(value), F.lit("null"))

    return entries.select("scope", "section", F.array_join(F.transform("columns", as_text), "|").alias("entry"))


def _labelled(column: str, label: str, value) -> Callable[[Marts], DataFrame]:
    return lambda m: (
        m.events.where(F.col(column).isNotNull() | F.lit(column != "page_location"))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(column, value(column).alias(label), "events")
    )


def _sankey_min5(columns: str) -> Callable[[Marts], DataFrame]:
    rebuilt = OVERALL[columns]
    return Report(partial(rebuilt.build, min_users=5), rebuilt.columns, rebuilt.order).table


def _columns_of(name: str, build: Callable[[Marts], DataFrame]) -> Callable[[Marts], DataFrame]:
    return lambda m: build(m).select(*OVERALL[name].columns)


def queries() -> dict[str, Query]:
    reports: dict[str, Callable[[Marts], DataFrame]] = {
        **{name: partial(report, name=name) for name in OVERALL},
        **{f"{name}_per_source": partial(report, name=name, by_source=True) for name in BY_SOURCE},
        "journeys": _journeys,
        "sankey_links_min5": _sankey_min5("sankey_links"),
        "sankey_nodes_min5": _sankey_min5("sankey_nodes"),
        "platform_distribution_merged": _columns_of(
            "platform_distribution", partial(overview.platform_distribution, merge_labels=True)
        ),
        "page_referrer_cvr_top50": partial(report, name="page_referrer_cvr", urls=50),
        "browser_cvr_all": partial(report, name="browser_cvr", k=None),
        "sankey_links_limit_first": partial(report, name="sankey_links", min_users=5, limit_first=True),
        "registered_view": lambda m: register(m.events).sparkSession.sql(VIEW_SQL),
        "first_touch_no_id": lambda m: users.first_touch(_without_ids(m)),
        "journeys_no_id": lambda m: _journeys(Marts(_without_ids(m))),
        "page_referrer_cvr_exact": _columns_of(
            "page_referrer_cvr", partial(dimensions.page_referrer_cvr, exact=True)
        ),
    }
    blocks: dict[str, Callable[[Marts], DataFrame]] = {
        "base_view": lambda m: m.events,
        "source_group_of": lambda m: m.events.groupBy("source", "source_group").agg(F.count(F.lit(1)).alias("events")),
        "first_touch": lambda m: users.first_touch(m.events),
        "purchasers": lambda m: users.purchasers(m.events),
        "purchase_sequence": lambda m: users.purchase_sequence(m.events),
        "user_profile": _user_profile,
        "purchase_delays": _purchase_delays,
        "order_values": _order_values,
        "user_buckets": _user_buckets,
        "page_path_of": _labelled("page_location", "page_path", C.page_path),
        "referrer_domain_of": _labelled("page_referrer", "domain", C.domain_of),
        "collapsed_events": lambda m: sequences.collapse_repeats(_listed(m)),
        "event_transitions": lambda m: sequences.transition_users(m.user_transitions),
        "first_steps": lambda m: sequences.first_steps(_listed(m), 10),
        "user_paths": _user_paths,
        "report_bundle": bundle,
        "report_bundle_items": _bundle_items,
        "report_rows": _report_rows,
    }
    over_marts = {name: _over_marts(build) for name, build in {**reports, **blocks}.items()}
    return {**over_marts, "base_view_since": _base_view_since}
