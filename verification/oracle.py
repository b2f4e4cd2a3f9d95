"""DuckDB statements that state each query's result directly.

They count distinct users and orders naively over all events, with none of the
pre-aggregates the Spark side uses.
"""

from __future__ import annotations

from clickreports import config
from clickreports.plans.catalog import BY_SOURCE, OVERALL
from verification.binding import DATE_FROM, RAW_SQL

# Columns that hold money, averages and shares.
DECIMALS = frozenset(
    "revenue aov avg_value cvr conv_rate pct_of_total drop_off_pct conversion_rate conversion_rate_joined "
    "avg_events_per_user avg_hours_to_first_purchase avg_hours_to_repeat repeat_purchase_pct".split()
)

# The vocabulary stands once, in ``config``; ``tests`` check its values.
_PATHS = config.PAGE_PATHS
_LABELS = "MAP {" + ", ".join(f"'{event}': '{label}'" for event, label in config.EVENT_LABELS.items()) + "}"
_DEPTHS = "[" + ", ".join(f"'{label}'" for label in sorted(config.EVENT_DEPTH, key=config.EVENT_DEPTH.get)) + "]"
_STEPS = dict(config.FUNNEL_STEPS)

_PATH = f"""CASE {' '.join(f"WHEN contains(page_location, '{path}') THEN '{path}'" for path in _PATHS)}
  ELSE '/ (home)' END"""

_DOMAIN = r"""coalesce(
  nullif(regexp_extract(coalesce(page_referrer, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), ''),
  nullif(page_referrer, ''), '(direct)')"""

_GROUP = """CASE WHEN coalesce(source, '') IN ('', '(direct)') THEN 'Direct'
  WHEN regexp_matches(source, '^richmenu', 'i') THEN 'LINE Richmenu'
  WHEN regexp_matches(source, 'google|bing', 'i') THEN 'Search'
  WHEN regexp_matches(source, 'facebook|tiktok|line', 'i') THEN 'Social'
  ELSE 'Others' END"""

_BASE = f"""
WITH raw_table AS ({RAW_SQL}),
typed AS (
  SELECT p_event_date AS event_date, event_ts_th AS event_ts,
         CAST(hour(event_ts_th) AS INTEGER) AS event_hour,
         CAST(dayofweek(p_event_date) + 1 AS INTEGER) AS day_of_week,
         user_id_final AS uid, event_name, traffic_source_source AS source, platform,
         coalesce(ec_purchase_revenue, 0) AS revenue, ec_transaction_id AS transaction_id,
         coalesce(engagement_time_msec, 0) AS engagement_msec, ga_session_number AS session_number,
         first_item_name, device_category, os, browser_final, geo_region, page_location, user_pseudo_id,
         traffic_source_name, traffic_source_medium, geo_country, page_referrer, event_id
  FROM raw_table
  WHERE starts_with(user_id_final, 'U')
),
ga AS MATERIALIZED (SELECT *, {_GROUP} AS source_group FROM typed),
touch AS (
  SELECT DISTINCT ON (uid) uid, source_group AS first_source
  FROM ga ORDER BY uid, event_ts ASC NULLS FIRST, event_id
),
ev AS MATERIALIZED (
  SELECT ga.*, first_source, event_name = 'purchase' AS bought,
         bool_or(event_name = 'purchase') OVER (PARTITION BY uid) AS buyer
  FROM ga JOIN touch USING (uid)
),
buys AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY event_ts ASC NULLS FIRST, event_id) AS seq
  FROM ev WHERE bought
),
person AS MATERIALIZED (
  SELECT uid, any_value(first_source) AS first_source, min(event_ts) AS first_touch,
         count(*) AS event_count, count(*) FILTER (bought) AS purchase_count,
         any_value(buyer) AS buyer,
         coalesce(sum(revenue) FILTER (bought), 0) AS revenue,
         CAST(sum(engagement_msec) AS BIGINT) AS engagement_msec,
         min(session_number) FILTER (session_number > 0) AS min_session,
         max(session_number) FILTER (session_number > 0) AS max_session,
         count(DISTINCT user_pseudo_id) AS pseudo_ids
  FROM ev GROUP BY uid
),
timed AS (
  SELECT person.*, p1.event_ts AS first_purchase_ts, p2.event_ts AS second_purchase_ts
  FROM person LEFT JOIN buys p1 ON p1.uid = person.uid AND p1.seq = 1
              LEFT JOIN buys p2 ON p2.uid = person.uid AND p2.seq = 2
)
"""

_LISTED = f"event_name IN (SELECT unnest(map_keys({_LABELS})))"

_WALK = f"""
, listed AS (SELECT uid, event_ts, event_id, event_name FROM ev WHERE {_LISTED}),
lagged AS (
  SELECT *, lag(event_name) OVER (PARTITION BY uid ORDER BY event_ts ASC NULLS FIRST, event_id) AS before
  FROM listed
),
collapsed AS (SELECT uid, event_ts, event_id, event_name FROM lagged WHERE before IS DISTINCT FROM event_name),
paired AS (
  SELECT uid, event_name AS source_event,
         lead(event_name) OVER (PARTITION BY uid ORDER BY event_ts ASC NULLS FIRST, event_id) AS target_event
  FROM collapsed
),
edges AS (
  SELECT source_event, target_event, count(DISTINCT uid) AS user_count
  FROM paired WHERE target_event IS NOT NULL GROUP BY ALL
),
walked AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY event_ts ASC NULLS FIRST, event_id) AS step_no
  FROM collapsed
),
routes AS (
  SELECT uid, string_agg(event_name, ' → ' ORDER BY step_no) FILTER (step_no <= 10) AS raw_path,
         string_agg({_LABELS}[event_name], ' → ' ORDER BY step_no) FILTER (step_no <= 10) AS path,
         least(count(*), 10) AS steps, count(*) > 10 AS longer
  FROM walked GROUP BY uid
)
"""


def _pct(part: str, whole: str) -> str:
    return f"coalesce(round(100.0 * CAST({part} AS BIGINT) / nullif(CAST({whole} AS BIGINT), 0), 1), 0)"


def _hours(start: str, end: str, condition: str) -> str:
    seconds = f"CAST(floor(epoch({end})) AS BIGINT) - CAST(floor(epoch({start})) AS BIGINT)"
    return (
        f"coalesce(round(CAST(sum({seconds}) FILTER ({condition}) AS DOUBLE)"
        f" / count({end}) FILTER ({condition}) / 3600.0, 1), 0)"
    )


_USERS = "count(DISTINCT uid)"
_BUYERS = "count(DISTINCT uid) FILTER (buyer)"
_BOUGHT = "count(DISTINCT uid) FILTER (bought)"
_ORDERS = "count(DISTINCT transaction_id) FILTER (bought)"
_REVENUE = "CAST(coalesce(sum(revenue) FILTER (bought), 0) AS DOUBLE)"


def _kpi(src: str) -> str:
    purchasers = "count(*) FILTER (buyer)"
    joined = "CAST(sum(greatest(purchase_count, 1)) AS BIGINT)"
    extra = (
        f", {joined} AS total_users_joined, {_pct(purchasers, joined)} AS conversion_rate_joined" if src else ""
    )
    return f"""SELECT {src} count(*) AS total_users, {_pct(purchasers, 'count(*)')} AS conversion_rate,
      {purchasers} AS purchases,
      round(CAST(sum(event_count) AS DOUBLE) / count(*), 1) AS avg_events_per_user,
      {_hours('first_touch', 'first_purchase_ts', 'first_touch < first_purchase_ts')} AS avg_hours_to_first_purchase,
      {_hours('first_purchase_ts', 'second_purchase_ts', 'second_purchase_ts IS NOT NULL')} AS avg_hours_to_repeat,
      {_pct('count(*) FILTER (purchase_count > 1)', purchasers)} AS repeat_purchase_pct{extra}
    FROM timed {'GROUP BY ALL' if src else ''}"""


def _funnel(per_source: bool) -> str:
    src = "source_group," if per_source else ""
    on = "AND p.source_group = c.source_group" if per_source else ""
    partition = "PARTITION BY c.source_group" if per_source else ""
    values = ", ".join(
        f"({i}, '{event}', '{label}')" for i, (event, label) in enumerate(_STEPS.items(), start=1)
    )
    counts = " UNION ALL ".join(
        [f"SELECT {src} 0 AS n, {_USERS} AS users FROM ev {'GROUP BY source_group' if per_source else ''}"]
        + [
            f"SELECT {src} {i}, count(DISTINCT uid) FILTER (event_name = '{event}') FROM ev"
            f" {'GROUP BY source_group' if per_source else ''}"
            for i, event in enumerate(_STEPS, start=1)
        ]
    )
    no_drop = "c.n = 0" if per_source else "c.n <= 1"
    return f"""SELECT {'c.source_group,' if per_source else ''} s.step, s.event, c.users,
      {_pct('c.users', 't.users')} AS pct_of_total,
      CASE WHEN {no_drop} THEN 0.0::DOUBLE ELSE {_pct('p.users - c.users', 'p.users')} END AS drop_off_pct
    FROM ({counts}) c
    JOIN (SELECT * FROM (VALUES (0, 'all', 'Total Users'), {values}) v(n, event, step)) s ON s.n = c.n
    JOIN ({counts}) t ON t.n = 0 {on.replace('p.', 't.')}
    LEFT JOIN ({counts}) p ON p.n = c.n - 1 {on}"""


def _funnel_sources(per_source: bool) -> str:
    steps = ", ".join(
        f"count(DISTINCT uid) FILTER (event_name = '{event}') AS \"{label}\"" for event, label in _STEPS.items()
    )
    lead = "source_group, source_group AS source" if per_source else "source_group AS source"
    return f"SELECT {lead}, {_USERS} AS total_users, {steps} FROM ev GROUP BY source_group"


def _dimension(src: str, column: str, label: str, default: str, k: int | None, revenue: bool) -> str:
    money = f", {_REVENUE} AS revenue" if revenue else ""
    over = "PARTITION BY source_group" if src else ""
    by = "source_group," if src else ""
    cut = f"WHERE place <= {k}" if k else ""
    return f"""SELECT {by} coalesce(k, '{default}') AS "{label}", users, purchasers,
      {'revenue,' if revenue else ''} {_pct('purchasers', 'users')} AS cvr
    FROM (
      SELECT *, row_number() OVER ({over} ORDER BY users DESC, k ASC NULLS FIRST) AS place
      FROM (SELECT {src} {column} AS k, {_USERS} AS users, {_BUYERS} AS purchasers {money}
            FROM ev GROUP BY ALL)
    ) {cut}"""


def _referrer(src: str, urls: int | None = None) -> str:
    by = "source_group," if src else ""
    over = "PARTITION BY source_group" if src else ""
    cut = f"WHERE place <= {urls}" if urls else ""
    return f"""SELECT {by} domain, users, purchasers, {_pct('purchasers', 'users')} AS cvr FROM (
      SELECT *, row_number() OVER ({over} ORDER BY users DESC, domain) AS place FROM (
        SELECT {by} {_DOMAIN} AS domain, CAST(sum(users) AS BIGINT) AS users,
               CAST(sum(purchasers) AS BIGINT) AS purchasers
        FROM (SELECT *, row_number() OVER (ORDER BY users DESC, page_referrer ASC NULLS FIRST) AS place
              FROM (SELECT {src} page_referrer, {_USERS} AS users, {_BUYERS} AS purchasers FROM ev GROUP BY ALL))
        {cut} GROUP BY ALL)
    ) WHERE place <= 20"""


def _items(src: str) -> str:
    by = "source_group," if src else ""
    over = "PARTITION BY source_group" if src else ""
    return f"""SELECT {by} item, CAST(money AS DOUBLE) AS revenue, orders, buyers FROM (
      SELECT *, row_number() OVER ({over} ORDER BY money DESC, item) AS place FROM (
        SELECT {src} first_item_name AS item, coalesce(sum(revenue) FILTER (bought), 0) AS money,
               {_ORDERS} AS orders, {_BOUGHT} AS buyers
        FROM ev WHERE first_item_name <> '' GROUP BY ALL)
    ) WHERE place <= 15"""


def _bucket(value: str, exact: dict, upto: dict, rest: str, below: bool) -> str:
    sign = "<" if below else "<="
    cases = [f"WHEN {value} = {v} THEN '{label}'" for v, label in exact.items()]
    cases += [f"WHEN {value} {sign} {v} THEN '{label}'" for v, label in upto.items()]
    return f"CASE {' '.join(cases)} ELSE '{rest}' END"


_ORDER_BUCKET = _bucket(
    "order_value", {}, {100: "0-99", 500: "100-499", 1000: "500-999", 2000: "1K-1.9K", 5000: "2K-4.9K"}, "5K+", True
)
_TIME_BUCKET = _bucket(
    "engagement_msec / 1000.0", {}, {10: "0-10s", 30: "10-30s", 60: "30-60s", 180: "1-3m", 600: "3-10m"}, "10m+", True
)
_SESSION_BUCKET = _bucket("max_session", {1: "1", 2: "2"}, {5: "3-5", 10: "6-10"}, "11+", False)
_PSEUDO_BUCKET = _bucket("pseudo_ids", {1: "1", 2: "2", 3: "3"}, {5: "4-5", 10: "6-10"}, "11+", False)


def _order_values(src: str) -> str:
    return (
        f"SELECT {src} transaction_id, sum(revenue) AS order_value FROM ev"
        " WHERE bought AND transaction_id IS NOT NULL GROUP BY ALL"
    )


def _shared(by_source: bool) -> dict[str, str]:
    src = "first_source AS source_group," if by_source else ""
    by = "source_group," if by_source else ""
    paid = "bought AND transaction_id IS NOT NULL"
    paid_sum = f"coalesce(sum(revenue) FILTER ({paid}), 0)"
    return {
        "kpi": _kpi(src),
        "funnel": _funnel(by_source),
        "funnel_by_source": _funnel_sources(by_source),
        "daily_trend": f"""SELECT {src} event_date AS date, {_USERS} AS users, {_BOUGHT} AS purchases,
            {_pct(_BOUGHT, _USERS)} AS conv_rate FROM ev GROUP BY ALL""",
        "purchase_frequency": f"""SELECT {src} purchase_count AS purchases, count(*) AS users
            FROM person WHERE purchase_count > 0 GROUP BY ALL""",
        "revenue_trend": f"""SELECT {src} event_date AS date, CAST({paid_sum} AS DOUBLE) AS revenue,
            {_ORDERS} AS orders, coalesce(round(CAST({paid_sum} AS DOUBLE) / nullif({_ORDERS}, 0), 0), 0) AS aov
            FROM ev GROUP BY ALL""",
        "hourly_heatmap": f"""SELECT {src} day_of_week AS day, event_hour AS hour, {_USERS} AS users,
            {_ORDERS} AS orders, {_REVENUE} AS revenue FROM ev GROUP BY ALL""",
        "aov_distribution": f"""SELECT {by} {_ORDER_BUCKET} AS bucket, count(*) AS orders,
            round(CAST(sum(order_value) AS DOUBLE) / count(*), 0) AS avg_value
            FROM ({_order_values(src)}) GROUP BY ALL""",
        "new_vs_returning": f"""SELECT {src} if(min_session = 1, 'New', 'Returning') AS type, count(*) AS users,
            CAST(sum(revenue) AS DOUBLE) AS revenue, count(*) FILTER (buyer) AS purchasers,
            {_pct('count(*) FILTER (buyer)', 'count(*)')} AS cvr
            FROM person WHERE min_session IS NOT NULL GROUP BY ALL""",
        "session_depth_cvr": f"""SELECT {src} {_SESSION_BUCKET} AS bucket, count(*) AS users,
            count(*) FILTER (buyer) AS purchasers, {_pct('count(*) FILTER (buyer)', 'count(*)')} AS cvr
            FROM person WHERE max_session IS NOT NULL GROUP BY ALL""",
        "engagement_distribution": f"""SELECT {src} {_TIME_BUCKET} AS bucket, count(*) FILTER (buyer) AS purchasers,
            count(*) FILTER (NOT buyer) AS non_purchasers FROM person GROUP BY ALL""",
        "hourly_revenue": f"""SELECT {src} event_hour AS hour, {_REVENUE} AS revenue, {_ORDERS} AS orders
            FROM ev GROUP BY ALL""",
        "day_of_week": f"""SELECT {src} day_of_week AS day, strftime(any_value(event_date), '%a') AS day_name,
            {_USERS} AS users, {_ORDERS} AS orders, {_REVENUE} AS revenue, {_pct(_BOUGHT, _USERS)} AS cvr
            FROM ev GROUP BY ALL""",
        "top_items": _items(src),
        "device_category_cvr": _dimension(src, "device_category", "device_category", "Unknown", None, False),
        "os_cvr": _dimension(src, "os", "os", "Unknown", None, False),
        "browser_cvr": _dimension(src, "browser_final", "browser", "Unknown", 15, False),
        "geo_region": _dimension(src, "geo_region", "region", "Unknown", 15, True),
        "geo_country": _dimension(src, "geo_country", "country", "Unknown", 15, True),
        "page_path_cvr": f"""SELECT {src} {_PATH} AS path, {_USERS} AS visitors, {_BUYERS} AS purchasers, {_pct(_BUYERS, _USERS)} AS cvr
            FROM ev WHERE page_location IS NOT NULL GROUP BY ALL""",
        "event_distribution_full": f"""SELECT {src} event_name AS event, count(*) AS events, {_USERS} AS users
            FROM ev GROUP BY ALL""",
        "page_referrer_cvr": _referrer(src),
        "visit_frequency": f"""SELECT {src} {_PSEUDO_BUCKET} AS bucket, count(*) AS users
            FROM person GROUP BY ALL""",
    }


def _links(min_users: int, limit_first: bool = False) -> str:
    forward = f"list_position({_DEPTHS}, {_LABELS}[target_event]) > list_position({_DEPTHS}, {_LABELS}[source_event])"
    early, late = ("true", forward) if limit_first else (forward, "true")
    return f"""SELECT {_LABELS}[source_event] AS source, {_LABELS}[target_event] AS target, user_count AS value
      FROM (SELECT * FROM edges WHERE user_count >= {min_users} AND {early}
            ORDER BY user_count DESC, source_event, target_event LIMIT 50)
      WHERE {late}"""


def _nodes(min_users: int) -> str:
    return f"SELECT DISTINCT unnest([source, target]) AS name FROM ({_links(min_users)})"


def _platform(key: str) -> str:
    return f"""SELECT coalesce(nullif(k, ''), 'Unknown') AS platform, users, purchasers
      FROM (SELECT {key} AS k, {_USERS} AS users, {_BOUGHT} AS purchasers FROM ev GROUP BY ALL)"""


_OVERALL_ONLY = {
    "meta": f"""SELECT count(*) AS total_events, {_USERS} AS total_users, min(event_date) AS date_from,
        max(event_date) AS date_to, count(DISTINCT event_date) AS num_days FROM ev""",
    "event_distribution": f"SELECT event_name AS event, count(*) AS events, {_USERS} AS users FROM ev GROUP BY ALL",
    "platform_distribution": _platform("platform"),
    "platform_distribution_merged": _platform("coalesce(nullif(platform, ''), 'Unknown')"),
    "revenue_by_source": f"""SELECT first_source AS source, {_REVENUE} AS revenue, {_ORDERS} AS orders
        FROM ev GROUP BY ALL""",
    "traffic_source_name_cvr": _dimension("", "traffic_source_name", "name", "(not set)", 15, True),
    "traffic_source_medium_cvr": _dimension("", "traffic_source_medium", "medium", "(not set)", 15, True),
    "traffic_source_source_cvr": _dimension("", "source", "source", "(not set)", 15, True),
    "page_referrer_cvr_top50": _referrer("", 50),
    "browser_cvr_all": _dimension("", "browser_final", "browser", "Unknown", None, False),
    "page_referrer_cvr_exact": f"""SELECT domain, users, purchasers, {_pct('purchasers', 'users')} AS cvr
        FROM (SELECT {_DOMAIN} AS domain, {_USERS} AS users, {_BUYERS} AS purchasers FROM ev GROUP BY ALL)
        ORDER BY users DESC, domain LIMIT 20""",
}

_BLOCKS = {
    "base_view": "SELECT * FROM ga",
    "base_view_since": f"SELECT * FROM ga WHERE event_date >= DATE '{DATE_FROM}'",
    "registered_view": """SELECT uid, event_date, event_name, count(*) AS events, max(source_group) AS last_group
        FROM ga GROUP BY uid, event_date, event_name""",
    "source_group_of": "SELECT source, source_group, count(*) AS events FROM ga GROUP BY ALL",
    "first_touch": "SELECT uid, first_source AS source_group FROM touch",
    "purchasers": "SELECT DISTINCT uid FROM buys",
    "purchase_sequence": "SELECT uid, event_ts, event_id, seq AS purchase_seq FROM buys WHERE seq <= 2",
    "user_profile": """SELECT uid, first_source, first_touch, event_count, purchase_count,
        CAST(buyer AS INTEGER) AS is_purchaser, CAST(revenue AS DOUBLE) AS revenue, engagement_msec,
        min_session, max_session, pseudo_ids, first_purchase_ts, second_purchase_ts FROM timed""",
    "order_values": f"""SELECT transaction_id, CAST(order_value AS DOUBLE) AS order_value, {_ORDER_BUCKET} AS bucket
        FROM ({_order_values('')})""",
    "user_buckets": f"""SELECT uid, if(max_session IS NULL, NULL, {_SESSION_BUCKET}) AS session_bucket,
        {_TIME_BUCKET} AS engagement_bucket, {_PSEUDO_BUCKET} AS pseudo_id_bucket FROM person""",
    "page_path_of": f"""SELECT page_location,
        {_PATH} AS page_path,
        count(*) AS events FROM ga WHERE page_location IS NOT NULL GROUP BY ALL""",
    "referrer_domain_of": f"SELECT page_referrer, {_DOMAIN} AS domain, count(*) AS events FROM ga GROUP BY ALL",
    "purchase_delays": """SELECT uid,
        (CAST(floor(epoch(first_purchase_ts)) AS BIGINT) - CAST(floor(epoch(first_touch)) AS BIGINT)) / 3600.0
          AS hours_to_first,
        (CAST(floor(epoch(second_purchase_ts)) AS BIGINT) - CAST(floor(epoch(first_purchase_ts)) AS BIGINT)) / 3600.0
          AS hours_to_second
        FROM timed WHERE first_touch < first_purchase_ts""",
}

_WALKS = {
    "sankey_links": _links(100),
    "sankey_links_min5": _links(5),
    "sankey_nodes": _nodes(100),
    "sankey_nodes_min5": _nodes(5),
    "sankey_links_limit_first": _links(5, limit_first=True),
    "journeys": """SELECT path, count(*) AS users, steps, longer FROM routes GROUP BY raw_path, path, steps, longer
        ORDER BY count(*) DESC, raw_path, longer LIMIT 20""",
    "collapsed_events": "SELECT uid, event_ts, event_id, event_name FROM collapsed",
    "event_transitions": "SELECT source_event, target_event, user_count FROM edges",
    "first_steps": "SELECT uid, event_ts, event_id, event_name, CAST(step_no AS INTEGER) AS step_no"
    " FROM walked WHERE step_no <= 10",
    "user_paths": "SELECT uid, raw_path AS path, steps FROM routes",
}


def _bundle_items() -> str:
    """Rows of each section, overall and per first-touch source (0 where it has none)."""
    lists = {**_OVERALL_ONLY, **_shared(False), "journeys": _WALKS["journeys"]}
    skipped = (
        "meta",
        "kpi",
        "platform_distribution_merged",
        "page_referrer_cvr_exact",
        "page_referrer_cvr_top50",
        "browser_cvr_all",
    )
    parts = [
        f"SELECT 'all' AS scope, '{name}' AS section, count(*) AS items FROM ({sql})"
        for name, sql in lists.items()
        if name not in skipped
    ]
    parts += [
        f"SELECT 'sankey', 'links', count(*) FROM ({_links(100)})",
        f"SELECT 'sankey', 'nodes', count(*) FROM ({_nodes(100)})",
    ]
    parts += [
        f"SELECT s.first_source, '{name}', count(r.source_group) FROM (SELECT DISTINCT first_source FROM touch) s"
        f" LEFT JOIN ({sql}) r ON r.source_group = s.first_source GROUP BY s.first_source"
        for name, sql in _shared(True).items()
        if name != "kpi"
    ]
    return " UNION ALL ".join(parts)


def _report_rows() -> str:
    """Every report's rows as lines of text, decimals in hundredths."""
    overall = {**_OVERALL_ONLY, **_shared(False), **{k: _WALKS[k] for k in ("sankey_links", "sankey_nodes", "journeys")}}
    parts = [_lines("'all'", name, OVERALL[name].columns, overall[name]) for name in OVERALL]
    parts += [_lines("source_group", name, BY_SOURCE[name].columns, sql) for name, sql in _shared(True).items()]
    return " UNION ALL ".join(parts)


def _lines(scope: str, name: str, columns: tuple[str, ...], sql: str) -> str:
    def text(column: str) -> str:
        value = f'"{column}"'
        if column in DECIMALS:
            value = f"CAST(round(CAST({value} AS DOUBLE) * 100) AS BIGINT)"
        return f"coalesce(CAST({value} AS VARCHAR), 'null')"

    shown = ", ".join(text(c) for c in columns if c != "source_group")
    return f"SELECT {scope} AS scope, '{name}' AS section, concat_ws('|', {shown}) AS entry FROM ({sql})"


def _without_ids(sql: str) -> str:
    """The statement over hourly times, ties settled by the column put out."""
    hourly = sql.replace("SELECT p_event_date AS event_date, event_ts_th AS event_ts,", "SELECT p_event_date AS event_date, date_trunc('hour', event_ts_th) AS event_ts,")
    touch = hourly.replace(
        "FROM ga ORDER BY uid, event_ts ASC NULLS FIRST, event_id", "FROM ga ORDER BY uid, event_ts, source_group"
    )
    return touch.replace("ORDER BY event_ts ASC NULLS FIRST, event_id", "ORDER BY event_ts ASC NULLS FIRST, event_name")


def statements() -> dict[str, str]:
    overall = {**_OVERALL_ONLY, **_BLOCKS, **_shared(False)}
    per_source = {f"{name}_per_source": sql for name, sql in _shared(True).items()}
    return {
        **{name: _BASE + sql for name, sql in {**overall, **per_source}.items()},
        **{name: _BASE + _WALK + sql for name, sql in _WALKS.items()},
        "report_rows": _BASE + _WALK + _report_rows(),
        "first_touch_no_id": _without_ids(_BASE + _BLOCKS["first_touch"]),
        "journeys_no_id": _without_ids(_BASE + _WALK + _WALKS["journeys"]),
        "report_bundle_items": _BASE + _WALK + _bundle_items(),
    }
