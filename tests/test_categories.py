from __future__ import annotations

from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from clickreports.functions import categories as C
from clickreports.functions import metrics as M


def column(spark, values, kind, expression):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    found = table.select("i", expression("v").alias("o")).orderBy("i").collect()
    return dict(zip(values, [r.o for r in found], strict=True))


def test_page_paths_match_anywhere_case_sensitive_first_wins(spark):
    assert column(
        spark,
        ["https://s/cart/orders", "https://s/safety", "https://s/CART", "https://s/?x=/cart", "https://s/orders/1", ""],
        "string",
        C.page_path,
    ) == {
        "https://s/cart/orders": "/cart",
        "https://s/safety": "/safe",
        "https://s/CART": "/ (home)",
        "https://s/?x=/cart": "/cart",
        "https://s/orders/1": "/orders",
        "": "/ (home)",
    }


@pytest.mark.parametrize(
    ("bucket", "kind", "expected"),
    [
        (
            C.order_value_bucket,
            "double",
            {
                -5.0: "0-99",
                99.99: "0-99",
                100.0: "100-499",
                499.99: "100-499",
                500.0: "500-999",
                999.99: "500-999",
                1000.0: "1K-1.9K",
                2000.0: "2K-4.9K",
                4999.99: "2K-4.9K",
                5000.0: "5K+",
            },
        ),
        (
            C.engagement_bucket,
            "long",
            {
                0: "0-10s",
                9999: "0-10s",
                10000: "10-30s",
                30000: "30-60s",
                59999: "30-60s",
                60000: "1-3m",
                180000: "3-10m",
                599999: "3-10m",
                600000: "10m+",
            },
        ),
        (
            C.session_bucket,
            "long",
            {1: "1", 2: "2", 3: "3-5", 5: "3-5", 6: "6-10", 10: "6-10", 11: "11+"},
        ),
        (
            C.pseudo_id_bucket,
            "long",
            {0: "4-5", 1: "1", 2: "2", 3: "3", 4: "4-5", 5: "4-5", 6: "6-10", 10: "6-10", 11: "11+"},
        ),
    ],
)
def test_bucket_edges(spark, bucket, kind, expected):
    assert column(spark, list(expected), kind, bucket) == expected


def test_day_names(spark):
    assert column(spark, [0, 1, 7, 8], "int", C.day_name) == {0: "0", 1: "Sun", 7: "Sat", 8: "8"}


def test_relabel_passes_unknown_values_through(spark):
    assert column(spark, ["a", "b"], "string", lambda c: C.relabel(c, {"a": "A"})) == {"a": "A", "b": "b"}


def by_parsing(url):
    """What the standard URL parser gives, with the same fallbacks."""
    try:
        return urlparse(url).netloc or url or "(direct)"
    except ValueError:
        return url


def test_domains_agree_with_url_parsing(spark):
    urls = [
        "https://user:pw@Shop.Example.com:8080/a?b#c",
        "//cdn.example.com/p",
        "android-app://com.example.app/x",
        "foo/bar",
        "mailto:someone@example.com",
        "http:/one-slash",
        "https://",
        "1http://digit.first/x",
        "https://a.example.com?q=//b",
        "https://a.example.com#f",
        "https://a.example.com/with space",
        " https://leading.example.com/x",
        "https://line\nbreak.example.com/x",
        "http://[::1]:80/x",
        "http://[broken/x",
        "http://bro]ken/x",
        "(direct)",
        "",
    ]
    assert column(spark, urls, "string", C.domain_of) == {url: by_parsing(url) for url in urls}
    assert column(spark, [None], "string", C.domain_of) == {None: "(direct)"}


def test_percentages_are_safe_and_round_half_up(spark):
    table = spark.createDataFrame([(1, 8), (1, 1), (0, 0), (5, 1600), (None, 4)], "n long, d long")
    found = [r.p for r in table.select(M.pct("n", "d").alias("p")).collect()]
    assert found == [12.5, 100.0, 0.0, 0.3, 0.0]


def test_conditional_counts(spark):
    table = spark.createDataFrame([("a", 1, 5), ("a", 0, 7), ("b", 0, 9)], "u string, f int, v int")
    hit = F.col("f") == 1
    row = table.agg(M.distinct_if(hit, "u").alias("n"), M.sum_if(hit, "v").alias("s")).first()
    assert (row.n, row.s) == (1, 5)


def test_hours_use_whole_seconds(spark):
    table = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 00:00:00.9' a, timestamp_ntz'2024-01-01 01:30:00.1' b"
    )
    assert table.select(M.hours_between("a", "b").alias("h")).first().h == 1.5
    assert table.select(M.iso_date("a").alias("d")).first().d == "2024-01-01"
