"""All reports by name: how to build each, its columns, and its row order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame

from clickreports import config
from clickreports.operators.cells import SOURCE
from clickreports.operators.ranking import ordering
from clickreports.plans import dimensions, overview, segments, trends
from clickreports.plans.marts import Marts

@dataclass(frozen=True)
class Report:
    """``columns`` in output order; ``order`` as for ``operators.ranking.ordering``."""

    build: Callable[..., DataFrame]
    columns: tuple[str, ...]
    order: tuple[str, ...]

    def rows(self, m: Marts, **limits) -> DataFrame:
        """The report's rows, not sorted, with any extra columns ``order`` needs."""
        return self.build(m, **limits)

    def table(self, m: Marts, **limits) -> DataFrame:
        rows = self.rows(m, **limits)
        sorted_rows = rows.orderBy(*ordering(*self.order)) if self.order else rows
        return sorted_rows.select(*self.columns)


def _dimension(
    by_source: bool, dimension: str, label: str, default: str, k: int | None, with_revenue: bool
) -> Report:
    build = partial(
        dimensions.dimension_cvr,
        dimension=dimension,
        label=label,
        default=default,
        k=k,
        with_revenue=with_revenue,
        by_source=by_source,
    )
    revenue = ("revenue",) if with_revenue else ()
    return Report(build, (label, "users", "purchasers", *revenue, "cvr"), ("-users", "value_key"))


# Reports with an overall and a per-source form.
def _shared(by_source: bool) -> dict[str, Report]:
    form = partial(partial, by_source=by_source)
    top, unknown = config.LIMITS.top_values, config.UNKNOWN
    event_names = Report(form(overview.event_distribution), ("event", "events", "users"), ("-events", "event"))
    return {
        "kpi": Report(
            form(overview.kpi),
            (
                "total_users",
                "conversion_rate",
                "purchases",
                "avg_events_per_user",
                "avg_hours_to_first_purchase",
                "avg_hours_to_repeat",
                "repeat_purchase_pct",
                *(("total_users_joined", "conversion_rate_joined") if by_source else ()),
            ),
            (),
        ),
        "funnel_by_source": Report(
            form(overview.funnel_by_source),
            ("source", "total_users", *(label for _, label in config.FUNNEL_STEPS)),
            ("-total_users", "source"),
        ),
        "daily_trend": Report(form(trends.daily_trend), ("date", "users", "purchases", "conv_rate"), ("date",)),
        "purchase_frequency": Report(
            form(segments.purchase_frequency), ("purchases", "users"), ("purchases",)
        ),
        "revenue_trend": Report(form(trends.revenue_trend), ("date", "revenue", "orders", "aov"), ("date",)),
        "hourly_heatmap": Report(
            form(trends.hourly_heatmap), ("day", "hour", "users", "orders", "revenue"), ("day", "hour")
        ),
        "aov_distribution": Report(
            form(segments.aov_distribution), ("bucket", "orders", "avg_value"), ("bucket_order",)
        ),
        "new_vs_returning": Report(
            form(segments.new_vs_returning), ("type", "users", "revenue", "purchasers", "cvr"), ("type",)
        ),
        "session_depth_cvr": Report(
            form(segments.session_depth_cvr), ("bucket", "users", "purchasers", "cvr"), ("bucket_order",)
        ),
        "engagement_distribution": Report(
            form(segments.engagement_distribution), ("bucket", "purchasers", "non_purchasers"), ("bucket_order",)
        ),
        "hourly_revenue": Report(form(trends.hourly_revenue), ("hour", "revenue", "orders"), ("hour",)),
        "day_of_week": Report(
            form(trends.day_of_week), ("day", "day_name", "users", "orders", "revenue", "cvr"), ("day",)
        ),
        "top_items": Report(
            form(dimensions.top_items), ("item", "revenue", "orders", "buyers"), ("-revenue", "item")
        ),
        "device_category_cvr": _dimension(by_source, "device_category", "device_category", unknown, None, False),
        "os_cvr": _dimension(by_source, "os", "os", unknown, None, False),
        "browser_cvr": _dimension(by_source, "browser_final", "browser", unknown, top, False),
        "geo_region": _dimension(by_source, "geo_region", "region", unknown, top, True),
        "geo_country": _dimension(by_source, "geo_country", "country", unknown, top, True),
        "page_path_cvr": Report(
            form(dimensions.page_path_cvr), ("path", "visitors", "purchasers", "cvr"), ("-cvr", "path")
        ),
        "event_distribution_full": event_names,
        "page_referrer_cvr": Report(
            form(dimensions.page_referrer_cvr), ("domain", "users", "purchasers", "cvr"), ("-users", "domain")
        ),
        "visit_frequency": Report(form(segments.visit_frequency), ("bucket", "users"), ("bucket_order",)),
    }


def _overall_only() -> dict[str, Report]:
    top, not_set = config.LIMITS.top_values, config.NOT_SET
    return {
        "meta": Report(overview.meta, ("total_events", "total_users", "date_from", "date_to", "num_days"), ()),
        "funnel": Report(overview.funnel, FUNNEL_COLUMNS, ("step_no",)),
        "sankey_links": Report(
            overview.sankey_links, ("source", "target", "value"), ("-value", "source", "target")
        ),
        "sankey_nodes": Report(overview.sankey_nodes, ("name",), ("depth", "name")),
        "journeys": Report(overview.journeys, ("path", "users", "steps", "longer"), ("-users", "raw_path", "longer")),
        "event_distribution": Report(
            overview.event_distribution, ("event", "events", "users"), ("-events", "event")
        ),
        "platform_distribution": Report(
            overview.platform_distribution, ("platform", "users", "purchasers"), ("-users", "platform_key")
        ),
        "revenue_by_source": Report(
            segments.revenue_by_source, ("source", "revenue", "orders"), ("-revenue", "source")
        ),
        "traffic_source_name_cvr": _dimension(False, "traffic_source_name", "name", not_set, top, True),
        "traffic_source_medium_cvr": _dimension(False, "traffic_source_medium", "medium", not_set, top, True),
        "traffic_source_source_cvr": _dimension(False, "source", "source", not_set, top, True),
    }


def _per_source(report: Report) -> Report:
    return Report(report.build, (SOURCE, *report.columns), (SOURCE, *report.order))


FUNNEL_COLUMNS = ("step", "event", "users", "pct_of_total", "drop_off_pct")

OVERALL: dict[str, Report] = {**_overall_only(), **_shared(by_source=False)}

# Per source: first-touch source, but the two funnels go by the event's own source.
BY_SOURCE: dict[str, Report] = {
    name: _per_source(report)
    for name, report in {
        **_shared(by_source=True),
        "funnel": Report(overview.funnel_per_source, FUNNEL_COLUMNS, ("step_no",)),
    }.items()
}


def report(m: Marts, name: str, by_source: bool = False, **limits) -> DataFrame:
    """A report's rows in order, overall or with a leading ``source_group`` column.

    ``limits`` are those of the report: ``k`` (None for all) of the top values, items and
    domains, ``urls`` of the referrers, ``min_users``, ``limit`` and ``limit_first`` of the transitions,
    ``steps`` and ``limit`` of the journeys.
    """
    return (BY_SOURCE if by_source else OVERALL)[name].table(m, **limits)
