"""Labels and buckets derived from single columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickreports import config


def source_group(source: str | Column) -> Column:
    """Traffic-source group of a raw source; never NULL, first match wins."""
    source = _col(source)
    direct = source.isNull() | source.isin(*config.SOURCE_DIRECT)
    group = F.when(direct, F.lit(config.SOURCE_GROUP_DIRECT))
    for label, patterns in config.SOURCE_GROUPS:
        matches = [source.ilike(pattern) for pattern in patterns]
        group = group.when(_any(matches), F.lit(label))
    return group.otherwise(F.lit(config.SOURCE_GROUP_REST))


def page_path(location: str | Column) -> Column:
    """Page category of a URL: case-sensitive, matched anywhere, first match wins."""
    location = _col(location)
    category = None
    for path in config.PAGE_PATHS:
        hit = location.contains(path)
        category = category.when(hit, F.lit(path)) if category is not None else F.when(hit, F.lit(path))
    return category.otherwise(F.lit(config.PAGE_PATH_REST))


def bucketize(
    value: str,
    bounds: Sequence[tuple[float | None, bool, str]],
    exact: Sequence[tuple[float, str]] = (),
) -> Column:
    """Label of the bucket ``value``, a column name or SQL expression, falls in.

    ``exact`` values are tried first, then the upper ``bounds`` in order. A last
    bound of ``None`` takes the rest.
    """
    column, cases = F.col(value), F
    for point, label in exact:
        cases = cases.when(column == point, F.lit(label))
    for bound, inclusive, label in bounds:
        if bound is None:
            return F.lit(label) if cases is F else cases.otherwise(F.lit(label))
        cases = cases.when(column <= bound if inclusive else column < bound, F.lit(label))
    return cases


def order_value_bucket(value: str) -> Column:
    return bucketize(value, config.ORDER_VALUE_BUCKETS)


def engagement_bucket(msec: str) -> Column:
    bounds = [(None if b is None else b * 1000, inc, lab) for b, inc, lab in config.ENGAGEMENT_SECOND_BUCKETS]
    return bucketize(msec, bounds)


def session_bucket(sessions: str) -> Column:
    return bucketize(sessions, config.SESSION_BUCKETS, config.SESSION_EXACT)


def pseudo_id_bucket(ids: str) -> Column:
    """0 known ids counts as at most five, so it lands in that bucket."""
    return bucketize(ids, config.PSEUDO_ID_BUCKETS, config.PSEUDO_ID_EXACT)


def rank_of(column: str | Column, labels: Sequence[str]) -> Column:
    """1-based position of a label in an explicit order; 0 when not listed."""
    return F.array_position(F.array(*[F.lit(label) for label in labels]), _col(column))


def day_name(day_of_week: str | Column) -> Column:
    """Sun for 1 ... Sat for 7; other numbers as text."""
    day = _col(day_of_week)
    names = F.array(*[F.lit(name) for name in config.DAY_NAMES])
    return F.when(day.between(1, len(config.DAY_NAMES)), F.get(names, day - 1)).otherwise(day.cast("string"))


def or_default(column: str | Column, default: str, blank_too: bool = False) -> Column:
    """``default`` for NULL, and for the empty string too when asked."""
    column = _col(column)
    if blank_too:
        column = F.nullif(column, F.lit(""))
    return F.coalesce(column, F.lit(default))


def lookup(column: str | Column, mapping: Mapping) -> Column:
    """Value of a small fixed mapping; NULL when the key is not in it."""
    pairs = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return F.try_element_at(pairs, _col(column))


def relabel(column: str | Column, mapping: Mapping[str, str]) -> Column:
    """Mapped label, or the value itself when it has none."""
    return F.coalesce(lookup(column, mapping), _col(column))


def depth(label: str | Column, unknown: int) -> Column:
    return F.coalesce(lookup(label, config.EVENT_DEPTH), F.lit(unknown))


# Fixed value: scheme (optional), two slashes, then the network location.
_NETWORK_LOCATION = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def domain_of(url: str | Column) -> Column:
    """Network location of a URL, with user info, port and letter case kept.

    A text without one, or with an unbalanced bracket host, stands for itself; an
    empty or NULL text counts as no referrer.
    """
    url = _col(url)
    # URL parsing ignores leading blanks and control characters, and line breaks and tabs anywhere.
    cleaned = F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")
    host = F.regexp_extract(cleaned, _NETWORK_LOCATION, 1)
    balanced = host.contains("[") == host.contains("]")
    host = F.when(balanced, F.nullif(host, F.lit("")))
    return F.coalesce(host, F.nullif(url, F.lit("")), F.lit(config.NO_REFERRER))


def _any(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
