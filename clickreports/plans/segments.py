"""Users and orders split into segments and buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickreports import config
from clickreports.functions import metrics as M
from clickreports.functions.categories import (
    engagement_bucket,
    order_value_bucket,
    pseudo_id_bucket,
    rank_of,
    session_bucket,
)
from clickreports.operators.cells import SOURCE, by_first_source, distinct_orders, merge_counts, over_sources
from clickreports.plans.marts import Marts


def purchase_frequency(m: Marts, by_source: bool = False) -> DataFrame:
    """Purchasers by their number of purchase events."""
    buyers = by_first_source(m.users.where(F.col("is_purchaser") == 1))
    counts = buyers.groupBy(SOURCE, F.col("purchase_count").alias("purchases")).agg(F.count(F.lit(1)).alias("users"))
    return over_sources(counts, ["purchases"], by_source)


def order_values(m: Marts, by_source: bool = False) -> DataFrame:
    """Value of each order; per source, an order shared by two sources is two orders."""
    orders = by_first_source(m.purchases.where(F.col("transaction_id").isNotNull()))
    by = [SOURCE] if by_source else []
    return orders.groupBy(*by, "transaction_id").agg(F.sum("revenue").alias("order_value"))


def aov_distribution(m: Marts, by_source: bool = False) -> DataFrame:
    """Orders and their mean value per bucket of order value."""
    by = [SOURCE] if by_source else []
    return order_values(m, by_source).groupBy(*by, order_value_bucket("order_value").alias("bucket")).agg(
        F.count(F.lit(1)).alias("orders"),
        M.ratio("sum(order_value)", "count(*)", 0).alias("avg_value"),
        F.min("order_value").alias("bucket_order"),
    )


def new_vs_returning(m: Marts, by_source: bool = False) -> DataFrame:
    """Users whose first known session is their very first one, against the others.

    Users without a positive session number are left out.
    """
    known = by_first_source(m.users.where(F.col("min_session").isNotNull()))
    kind = F.when(F.col("min_session") == 1, F.lit("New")).otherwise(F.lit("Returning"))
    counts = known.groupBy(SOURCE, kind.alias("type")).agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("revenue").alias("revenue"),
        F.sum("is_purchaser").alias("purchasers"),
    )
    kinds = over_sources(counts, ["type"], by_source)
    return _with_cvr(kinds.withColumn("revenue", M.money("revenue")))


def revenue_by_source(m: Marts) -> DataFrame:
    """Revenue and distinct orders by first-touch source."""
    revenue = m.users.groupBy(F.col("first_source").alias("source")).agg(F.sum("revenue").alias("revenue"))
    orders = distinct_orders(m.purchases.withColumnRenamed("first_source", "source"), ["source"])
    return merge_counts(["source"], revenue, orders).withColumn("revenue", M.money("revenue"))


def session_depth_cvr(m: Marts, by_source: bool = False) -> DataFrame:
    """Users, purchasers and their share per bucket of the highest session number."""
    known = by_first_source(m.users.where(F.col("max_session").isNotNull()))
    counts = known.groupBy(SOURCE, session_bucket("max_session").alias("bucket")).agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("is_purchaser").alias("purchasers"),
        F.min("max_session").alias("bucket_order"),
    )
    return _with_cvr(over_sources(counts, ["bucket"], by_source, lowest=["bucket_order"]))


def engagement_distribution(m: Marts, by_source: bool = False) -> DataFrame:
    """Purchasers and other users per bucket of total engagement time."""
    labels = [label for _, _, label in config.ENGAGEMENT_SECOND_BUCKETS]
    counts = by_first_source(m.users).groupBy(SOURCE, engagement_bucket("engagement_msec").alias("bucket")).agg(
        F.sum("is_purchaser").alias("purchasers"),
        F.sum(F.lit(1) - F.col("is_purchaser")).alias("non_purchasers"),
    )
    return over_sources(counts, ["bucket"], by_source).withColumn("bucket_order", rank_of("bucket", labels))


def visit_frequency(m: Marts, by_source: bool = False) -> DataFrame:
    """Users by their number of distinct pseudo ids."""
    counts = by_first_source(m.users).groupBy(SOURCE, pseudo_id_bucket("pseudo_ids").alias("bucket")).agg(
        F.count(F.lit(1)).alias("users"), F.min("pseudo_ids").alias("bucket_order")
    )
    return over_sources(counts, ["bucket"], by_source, lowest=["bucket_order"])


def _with_cvr(counts: DataFrame) -> DataFrame:
    return counts.withColumn("cvr", M.pct("purchasers", "users"))
