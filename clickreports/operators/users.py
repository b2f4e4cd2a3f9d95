"""One row per user: first touch, purchases, sessions, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickreports.functions import metrics as M
from clickreports.sources.events import EVENT_ID


def tie_key(events: DataFrame, put_out: str) -> str:
    """The column that settles equal times: the event id where the table has one.

    Without ids it is the column an operator puts out: rows that tie on it too are
    interchangeable, and no other column need be read.
    """
    return EVENT_ID if EVENT_ID in events.columns else put_out


def event_order(tie: str | None = EVENT_ID) -> list[Column]:
    """A user's events in time, unknown times first; equal times by ``tie``."""
    return [F.col("event_ts").asc_nulls_first(), *([F.col(tie).asc_nulls_first()] if tie else [])]


def first_source(events: DataFrame) -> Column:
    """Aggregate: source group of the earliest event.

    Combines on the map side, so a hot user costs one row per task and not a sort of
    all its events as a ranking window would.
    """
    return F.min_by("source_group", F.struct("event_ts", tie_key(events, "source_group")))


def first_touch(events: DataFrame) -> DataFrame:
    return events.groupBy("uid").agg(first_source(events).alias("source_group"))


def purchasers(events: DataFrame) -> DataFrame:
    return events.where(M.is_purchase()).select("uid").distinct()


def purchase_sequence(events: DataFrame, upto: int = 2) -> DataFrame:
    """Each user's first ``upto`` purchases, numbered from 1.

    The bound on the number lets every map task keep only that many rows per user.
    """
    ids = [EVENT_ID] if EVENT_ID in events.columns else []
    window = Window.partitionBy("uid").orderBy(*event_order(*ids or [None]))
    return (
        events.where(M.is_purchase())
        .select("uid", "event_ts", *ids)
        .withColumn("purchase_seq", F.row_number().over(window))
        .where(F.col("purchase_seq") <= upto)
    )


def purchase_times(events: DataFrame) -> DataFrame:
    """Times of each purchaser's first and second purchase."""
    at = lambda seq: F.max(F.when(F.col("purchase_seq") == seq, F.col("event_ts")))
    return purchase_sequence(events, 2).groupBy("uid").agg(
        at(1).alias("first_purchase_ts"), at(2).alias("second_purchase_ts")
    )


def user_profile(events: DataFrame) -> DataFrame:
    """Everything the reports ask of a user, in one aggregate over the events."""
    session = F.when(F.col("session_number") > 0, F.col("session_number"))
    purchase = M.is_purchase()
    profile = events.groupBy("uid").agg(
        first_source(events).alias("first_source"),
        F.min("event_ts").alias("first_touch"),
        F.count(F.lit(1)).alias("event_count"),
        F.sum(M.flag(purchase)).alias("purchase_count"),
        F.max(M.flag(purchase)).alias("is_purchaser"),
        M.sum_if(purchase, "revenue").alias("revenue"),
        F.sum("engagement_msec").alias("engagement_msec"),
        F.min(session).alias("min_session"),
        F.max(session).alias("max_session"),
        M.reached_steps().alias("steps"),
        F.countDistinct("user_pseudo_id").alias("pseudo_ids"),
    )
    return profile.join(purchase_times(events), "uid", "left")
