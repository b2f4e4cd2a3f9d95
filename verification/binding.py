"""Raw clickstream events derived from the generic test tables.

One SELECT that both Spark SQL and DuckDB accept; it names the tables ``events``,
``customer``, ``nation``, ``part`` and ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DATE_FROM = "2024-01-03"

TABLES = ("events", "customer", "nation", "part", "pages")

RAW_SQL = """
WITH numbered AS (
  SELECT event_id AS id, ts, event_type, value, user_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         event_id % (SELECT greatest(count(*), 1) FROM part ) AS item,
         event_id % (SELECT greatest(count(*), 1) FROM pages ) AS page
  FROM events
), named AS (
  SELECT id, ts, value, k, item, page, user_id * 10 + k % 10 AS un,
         CASE event_type
           WHEN 'purchase' THEN CASE id % 4 WHEN 0 THEN 'purchase' WHEN 1 THEN 'add_payment_info'
                                            WHEN 2 THEN 'begin_checkout' ELSE 'view_cart' END
           WHEN 'click' THEN CASE id % 4 WHEN 0 THEN 'add_to_cart' WHEN 1 THEN 'remove_from_cart'
                                         WHEN 2 THEN 'click_top_seller_number' ELSE 'view_search_results' END
           WHEN 'view' THEN CASE id % 4 WHEN 0 THEN 'view_item_list' WHEN 1 THEN 'user_engagement'
                                        ELSE 'page_view' END
           WHEN 'signup' THEN CASE id % 4 WHEN 0 THEN 'session_start' WHEN 1 THEN 'first_visit'
                                          WHEN 2 THEN 'login' ELSE 'signup' END
           ELSE CASE id % 4 WHEN 0 THEN 'exception' WHEN 1 THEN 'scroll'
                            WHEN 2 THEN 'page_view' ELSE 'session_start' END
         END AS event_name
  FROM numbered
)
SELECT
  id AS event_id,
  CAST(ts AS DATE) AS p_event_date,
  ts AS event_ts_th,
  CASE WHEN id % 53 = 0 THEN NULL
       WHEN id % 59 = 0 THEN 'G' || CAST(un AS STRING)
       ELSE 'U' || CAST(un AS STRING) END AS user_id_final,
  event_name,
  CASE (un + id % 3) % 10
    WHEN 0 THEN '(direct)' WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN 'richmenu_a'
    WHEN 4 THEN 'RichMenu_B' WHEN 5 THEN 'google' WHEN 6 THEN 'bing.com'
    WHEN 7 THEN 'm.facebook.com' WHEN 8 THEN 'line_oa' ELSE 'newsletter' END AS traffic_source_source,
  CASE WHEN id % 18 = 0 THEN NULL ELSE 'campaign_' || CAST(id % 18 AS STRING) END AS traffic_source_name,
  CASE id % 5 WHEN 0 THEN '(none)' WHEN 1 THEN 'organic' WHEN 2 THEN 'cpc'
              WHEN 3 THEN 'referral' ELSE NULL END AS traffic_source_medium,
  CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'IOS' WHEN 3 THEN 'ANDROID'
              ELSE 'WEB' END AS platform,
  CASE WHEN event_name = 'purchase' AND id % 11 <> 0
       THEN CAST(CAST(value AS DECIMAL(18,2)) * 50 AS DECIMAL(18,2)) END AS ec_purchase_revenue,
  CASE WHEN event_name = 'purchase' AND id % 13 <> 0
       THEN 'T' || CAST(id - id % 16 AS STRING) END AS ec_transaction_id,
  CAST(CASE WHEN id % 5 = 0 THEN NULL ELSE k * 900 END AS BIGINT) AS engagement_time_msec,
  CAST(CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN 0
            ELSE 1 + id % (1 + un % 12) END AS BIGINT) AS ga_session_number,
  CASE WHEN id % 6 = 0 THEN NULL WHEN id % 31 = 0 THEN '' ELSE p_name END AS first_item_name,
  CASE un % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' WHEN 2 THEN 'tablet' ELSE NULL END AS device_category,
  CASE un % 5 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Windows'
              WHEN 3 THEN 'Macintosh' ELSE NULL END AS os,
  CASE WHEN id % 20 = 0 THEN NULL ELSE 'Browser ' || CAST(id % 20 AS STRING) END AS browser_final,
  n_name || '-' || c_mktsegment AS geo_region,
  n_name AS geo_country,
  CASE id % 12
    WHEN 0 THEN NULL
    WHEN 1 THEN 'https://shop.example.com/cart'
    WHEN 2 THEN 'https://shop.example.com/safe/1'
    WHEN 3 THEN 'https://shop.example.com/highlights'
    WHEN 4 THEN 'https://shop.example.com/jidrid'
    WHEN 5 THEN 'https://shop.example.com/profile'
    WHEN 6 THEN 'https://shop.example.com/orders/9'
    WHEN 7 THEN 'https://shop.example.com/register'
    WHEN 8 THEN 'https://shop.example.com/dashboard'
    WHEN 9 THEN 'https://shop.example.com/prize-history'
    WHEN 10 THEN 'https://shop.example.com/'
    ELSE 'https://shop.example.com/cart/orders' END AS page_location,
  CASE WHEN id % 9 = 0 THEN NULL WHEN id % 10 = 0 THEN '' ELSE url END AS page_referrer,
  CASE WHEN un % 97 = 0 THEN NULL
       ELSE 'P' || CAST(un AS STRING) || '-' || CAST(id % (1 + un % 14) AS STRING) END AS user_pseudo_id
FROM named
LEFT JOIN customer ON c_custkey = un
LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN part ON p_partkey = item
LEFT JOIN pages ON page_id = page
"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived raw table; events go round all of ``part`` and ``pages``."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    sql = RAW_SQL
    for name in TABLES:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name}\n", f"{word} {{{name}}}\n").replace(
                f"{word} {name} ", f"{word} {{{name}}} "
            )
    return spark.sql(sql, **tables)
