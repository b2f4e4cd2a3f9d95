"""Shared pre-aggregates: each report reads the smallest one that can answer it.

The event table is scanned once per pre-aggregate, not once per report. Every one
holds at most one row per user and value, carries the user's first-touch source and
ever-purchaser flag, and so serves the overall and the per-source form of a report
without touching events or joining again.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickreports.config import EVENT_LABELS
from clickreports.functions import metrics as M
from clickreports.functions.categories import page_path
from clickreports.operators.cells import attribute, user_cells
from clickreports.operators.sequences import only_events, user_transitions
from clickreports.operators.users import user_profile
from clickreports.sources.store import Store

# Values that stay the same through most of a session, so that one row per user and
# combination is far smaller than the events.
SESSION_DIMENSIONS = (
    "platform",
    "device_category",
    "os",
    "browser_final",
    "geo_region",
    "geo_country",
    "traffic_source_name",
    "traffic_source_medium",
    "source",
    "source_group",
)


class Marts:
    """The pre-aggregates over one base view, each built on first use.

    With a ``store`` each is written once to the shared folder and read back. Without
    one they stay lazy plans, which suits a single report over small data.
    """

    def __init__(self, events: DataFrame, store: Store | None = None):
        self.events = events
        self._store = store

    @cached_property
    def store(self) -> Store:
        """The store of the pre-aggregates, or one of its own for what must be landed."""
        return self._store or Store(self.events.sparkSession)

    @cached_property
    def users(self) -> DataFrame:
        """One row per user."""
        return self._land("users", user_profile(self.events))

    @cached_property
    def user_hours(self) -> DataFrame:
        """Per user, day and hour: purchased or not, revenue, revenue of orders."""
        purchase = M.is_purchase()
        ordered = purchase & F.col("transaction_id").isNotNull()
        return self._attributed(
            "user_hours",
            ["event_date", "day_of_week", "event_hour"],
            F.max(M.flag(purchase)).alias("purchased"),
            M.sum_if(purchase, "revenue").alias("revenue"),
            M.sum_if(ordered, "revenue").alias("order_revenue"),
        )

    @cached_property
    def user_dimensions(self) -> DataFrame:
        """Per user and combination of session dimensions: purchases, steps reached."""
        purchase = M.is_purchase()
        return self._attributed(
            "user_dimensions",
            SESSION_DIMENSIONS,
            F.max(M.flag(purchase)).alias("purchased"),
            M.sum_if(purchase, "revenue").alias("revenue"),
            M.reached_steps().alias("steps"),
        )

    @cached_property
    def user_event_names(self) -> DataFrame:
        """Per user and event name: number of events."""
        return self._attributed("user_event_names", ["event_name"], F.count(F.lit(1)).alias("events"))

    @cached_property
    def user_page_paths(self) -> DataFrame:
        """User and visited page category; events without a page are no visit."""
        visits = self.events.where(F.col("page_location").isNotNull())
        visits = visits.select("uid", page_path("page_location").alias("page_path"))
        return self._land("user_page_paths", attribute(user_cells(visits, ["page_path"]), self.users))

    @cached_property
    def user_referrers(self) -> DataFrame:
        """User and raw referrer URL."""
        return self._attributed("user_referrers", ["page_referrer"])

    @cached_property
    def user_items(self) -> DataFrame:
        """Per user and named item: purchased or not, revenue."""
        purchase = M.is_purchase()
        named = self.events.where(F.col("first_item_name") != "")
        cells = user_cells(
            named,
            ["first_item_name"],
            F.max(M.flag(purchase)).alias("purchased"),
            M.sum_if(purchase, "revenue").alias("revenue"),
        )
        return self._land("user_items", attribute(cells, self.users))

    @cached_property
    def purchases(self) -> DataFrame:
        """The purchase events, for everything that counts orders."""
        rows = self.events.where(M.is_purchase()).select(
            "uid", "event_date", "day_of_week", "event_hour", "transaction_id", "first_item_name", "revenue"
        )
        return self._land("purchases", attribute(rows, self.users))

    @cached_property
    def user_transitions(self) -> DataFrame:
        """User and pair of successive different events, of the events that have a label."""
        return self._land("user_transitions", user_transitions(only_events(self.events, EVENT_LABELS)))

    def close(self) -> None:
        """Delete the landed pre-aggregates; nothing built on them can be read after."""
        if self._store is not None or "store" in self.__dict__:
            self.store.close()

    def _attributed(self, name: str, by, *measures) -> DataFrame:
        return self._land(name, attribute(user_cells(self.events, by, *measures), self.users))

    def _land(self, name: str, table: DataFrame) -> DataFrame:
        return table if self._store is None else self._store.land(name, table)
