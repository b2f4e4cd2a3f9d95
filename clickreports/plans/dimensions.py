"""Conversion by the value of one dimension: device, place, source, page, item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickreports import config
from clickreports.functions import metrics as M
from clickreports.functions.categories import domain_of, or_default
from clickreports.operators.cells import SOURCE, by_first_source, distinct_orders, merge_counts, over_sources
from clickreports.operators.ranking import top
from clickreports.plans.marts import Marts

LIMITS = config.LIMITS


def dimension_cvr(
    m: Marts,
    dimension: str,
    label: str,
    default: str = config.UNKNOWN,
    k: int | None = None,
    with_revenue: bool = False,
    by_source: bool = False,
    merge_labels: bool = False,
) -> DataFrame:
    """Users, ever-purchasers and their share per value of a session dimension.

    A purchaser counts wherever it was seen, not only where it purchased. Groups by
    the raw value and labels NULL afterwards; ``merge_labels`` groups by the label.
    ``k`` keeps the values with most users, per source when ``by_source``.
    """
    value = F.col(dimension)
    rows = m.user_dimensions.withColumn("value_key", or_default(value, default) if merge_labels else value)
    sums = [F.sum("revenue").alias("revenue")] if with_revenue else []
    per_user = by_first_source(rows).groupBy(SOURCE, "value_key", "uid").agg(
        F.max("is_purchaser").alias("is_purchaser"), *sums
    )
    counts = per_user.groupBy(SOURCE, "value_key").agg(
        F.count(F.lit(1)).alias("users"), F.sum("is_purchaser").alias("purchasers"), *sums
    )
    values = over_sources(counts, ["value_key"], by_source)
    kept = top(values, _source_key(by_source), ["-users", "value_key"], k)
    if with_revenue:
        kept = kept.withColumn("revenue", M.money("revenue"))
    return kept.withColumn("cvr", M.pct("purchasers", "users")).withColumn(
        label, or_default("value_key", default)
    )


def page_path_cvr(m: Marts, by_source: bool = False) -> DataFrame:
    """Visitors, ever-purchasers and their share per page category."""
    counts = by_first_source(m.user_page_paths).groupBy(SOURCE, F.col("page_path").alias("path")).agg(
        F.count(F.lit(1)).alias("visitors"), F.sum("is_purchaser").alias("purchasers")
    )
    paths = over_sources(counts, ["path"], by_source)
    return paths.withColumn("cvr", M.pct("purchasers", "visitors"))


def page_referrer_cvr(
    m: Marts,
    by_source: bool = False,
    exact: bool = False,
    k: int | None = LIMITS.referrer_domains,
    urls: int | None = LIMITS.referrer_urls,
) -> DataFrame:
    """Users and ever-purchasers per referring domain, the ``k`` largest domains.

    Adds up the users of a domain's URLs, so a user counts once per URL; of the ``urls``
    most used ones only, if given. ``exact`` counts each user once per domain over all URLs.
    """
    by = _source_key(by_source)
    rows = by_first_source(m.user_referrers)
    counts = [F.count(F.lit(1)).alias("users"), F.sum("is_purchaser").alias("purchasers")]
    if exact:
        rows = rows.select(*by, "uid", "is_purchaser", domain_of("page_referrer").alias("domain")).distinct()
        domains = rows.groupBy(*by, "domain").agg(*counts)
    else:
        per_url = over_sources(rows.groupBy(SOURCE, "page_referrer").agg(*counts), ["page_referrer"], by_source)
        per_url = top(per_url, by, ["-users", "page_referrer"], urls)
        domains = per_url.groupBy(*by, domain_of("page_referrer").alias("domain")).agg(
            F.sum("users").alias("users"), F.sum("purchasers").alias("purchasers")
        )
    kept = top(domains, by, ["-users", "domain"], k)
    return kept.withColumn("cvr", M.pct("purchasers", "users"))


def top_items(m: Marts, by_source: bool = False, k: int | None = LIMITS.top_values) -> DataFrame:
    """The ``k`` items with most revenue: revenue, distinct orders, distinct buyers."""
    by = _source_key(by_source)
    keys = [*by, "item"]
    items = by_first_source(m.user_items).withColumnRenamed("first_item_name", "item")
    counts = items.groupBy(SOURCE, "item").agg(F.sum("revenue").alias("revenue"), F.sum("purchased").alias("buyers"))
    sold = over_sources(counts, ["item"], by_source)
    bought = by_first_source(m.purchases.where(F.col("first_item_name") != ""))
    orders = distinct_orders(bought.withColumnRenamed("first_item_name", "item"), keys)
    kept = top(merge_counts(keys, sold, orders), by, ["-revenue", "item"], k)
    return kept.withColumn("revenue", M.money("revenue"))


def _source_key(by_source: bool) -> list[str]:
    return [SOURCE] if by_source else []
