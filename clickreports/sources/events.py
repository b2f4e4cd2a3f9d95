"""The raw event table and the typed, filtered base view over it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickreports.config import USER_ID_PREFIX
from clickreports.functions.categories import source_group
from clickreports.functions.metrics import zero_if_null

MONEY = T.DecimalType(18, 2)

# Raw column -> types it may have. Timestamps and dates are checked by family.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("p_event_date", T.DateType()),
        T.StructField("event_ts_th", T.TimestampNTZType()),
        T.StructField("user_id_final", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("traffic_source_source", T.StringType()),
        T.StructField("traffic_source_name", T.StringType()),
        T.StructField("traffic_source_medium", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("ec_purchase_revenue", MONEY),
        T.StructField("ec_transaction_id", T.StringType()),
        T.StructField("engagement_time_msec", T.LongType()),
        T.StructField("ga_session_number", T.LongType()),
        T.StructField("first_item_name", T.StringType()),
        T.StructField("device_category", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("browser_final", T.StringType()),
        T.StructField("geo_region", T.StringType()),
        T.StructField("geo_country", T.StringType()),
        T.StructField("page_location", T.StringType()),
        T.StructField("page_referrer", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
    ]
)
EVENT_ID = "event_id"


def load_events(
    spark: SparkSession,
    src: str | DataFrame,
    date_from: str | dt.date | None = None,
    prefix: str = USER_ID_PREFIX,
) -> DataFrame:
    """Base view: identified users' events, typed and tagged; since ``date_from`` if given.

    ``src`` is a DataFrame, a Parquet path or a table name. Nothing is read until a
    report runs, and then only the columns and (on a table partitioned by
    ``p_event_date``) the days it needs. A column ``event_id``, if there is one, settles equal
    times; without it the operators order such events by what they put out.
    """
    raw = _validated(src if isinstance(src, DataFrame) else _read(spark, src))
    bounded = raw if date_from is None else raw.where(_since(raw, date_from))
    kept = identified_users(bounded, prefix)
    return with_source_group(
        kept.select(
            F.col("p_event_date").cast("date").alias("event_date"),
            F.col("event_ts_th").alias("event_ts"),
            F.hour("event_ts_th").alias("event_hour"),
            F.dayofweek(F.col("p_event_date").cast("date")).alias("day_of_week"),
            F.col("user_id_final").alias("uid"),
            "event_name",
            F.col("traffic_source_source").alias("source"),
            "platform",
            zero_if_null("ec_purchase_revenue").cast(MONEY).alias("revenue"),
            F.col("ec_transaction_id").alias("transaction_id"),
            zero_if_null("engagement_time_msec").cast("bigint").alias("engagement_msec"),
            F.col("ga_session_number").cast("bigint").alias("session_number"),
            "first_item_name",
            "device_category",
            "os",
            "browser_final",
            "geo_region",
            "page_location",
            "user_pseudo_id",
            "traffic_source_name",
            "traffic_source_medium",
            "geo_country",
            "page_referrer",
            *([F.col(EVENT_ID).cast("bigint").alias(EVENT_ID)] if EVENT_ID in raw.columns else []),
        )
    )


def identified_users(raw: DataFrame, prefix: str = USER_ID_PREFIX) -> DataFrame:
    """Rows whose user id starts with ``prefix`` (case-sensitive; drops NULL)."""
    return raw.where(F.col("user_id_final").startswith(prefix))


def with_source_group(events: DataFrame) -> DataFrame:
    return events.withColumn("source_group", source_group("source"))


def register(events: DataFrame, name: str = "ga_events") -> DataFrame:
    """Expose the base view to ``spark.sql`` under ``name``."""
    events.createOrReplaceTempView(name)
    return events


def _read(spark: SparkSession, src: str) -> DataFrame:
    looks_like_path = "/" in src or src.endswith(".parquet")
    return spark.read.parquet(src) if looks_like_path else spark.table(src)


def _since(raw: DataFrame, date_from: str | dt.date) -> Column:
    """Lower date bound in the column's own type, so it reaches the scan."""
    day = str(date_from)
    if isinstance(raw.schema["p_event_date"].dataType, T.StringType):
        return F.col("p_event_date") >= F.lit(day)
    return F.col("p_event_date") >= F.lit(dt.date.fromisoformat(day))


def _validated(raw: DataFrame) -> DataFrame:
    have = {field.name: field.dataType for field in raw.schema}
    missing = [field.name for field in RAW_SCHEMA if field.name not in have]
    if missing:
        raise ValueError(f"event table lacks columns: {', '.join(missing)}")
    wrong = [
        f"{field.name} is {have[field.name].simpleString()}, expected {field.dataType.simpleString()}"
        for field in RAW_SCHEMA
        if not _accepts(field.dataType, have[field.name])
    ]
    if wrong:
        raise ValueError(f"event table has wrong types: {'; '.join(wrong)}")
    return raw


def _accepts(expected: T.DataType, actual: T.DataType) -> bool:
    if isinstance(expected, T.DateType):
        return isinstance(actual, (T.DateType, T.StringType))
    if isinstance(expected, T.TimestampNTZType):
        return isinstance(actual, (T.TimestampNTZType, T.TimestampType))
    if isinstance(expected, (T.DecimalType, T.LongType)):
        return isinstance(actual, T.NumericType)
    return isinstance(actual, type(expected))
