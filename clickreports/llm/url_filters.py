"""URL filter lists over time, in DataFrame operations: a temporal list join.

A list is a log of dated entries: from some moment on a pattern is blocked, allowed or
taken off. Per pattern the entries become validity intervals, each ending where the next
begins. A capture is judged by the entries active when it was fetched: an as-of join of
its candidate patterns (host, parent domains, and host with path prefixes) with the
intervals. Time is cut in slices of ``SLICE_DAYS``, and the join has the equal key
(pattern, slice): a capture meets the intervals that begin in its slice and the one open
when the slice begins. That one is carried forward by a window over the slices that a
pattern's entries and captures use, however far apart they are, so that no interval is
spread over the slices it lasts. A pattern with a long history does not meet all of it, and a
host with a third of all captures is dealt over its slices and split further by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickreports.llm.steps import Steps, without

SLICE_DAYS = 8
_SLICE = SLICE_DAYS * 86_400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot, null if the URL has none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(F.length(host) > 0, host)


def patterns_of(url: Column) -> Column:
    """Every pattern that may cover a URL, the most specific first.

    Host with path prefixes of whole segments (``h/a/b/``, ``h/a/``), then the host and its
    parent domains down to the last label. As many as the URL has parts.
    """
    host, path = host_of(url), F.regexp_extract(url, PATH, 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    depth = F.size(segments)
    prefix = lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, n), "/"), F.lit("/"))
    prefixes = F.when(depth > 0, F.transform(F.sequence(depth, F.lit(1)), prefix)).otherwise(F.expr("array()"))
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.array_join(F.slice(labels, n, F.size(labels) - n + 1), "."),
    )
    return F.concat(prefixes.cast("array<string>"), domains)


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries as intervals: ``pattern``, ``action``, ``valid_from``, ``valid_to``.

    ``entries`` has ``pattern``, ``action`` (block, allow or remove) and ``dated``. The next
    entry of a pattern ends the one before; of several at one moment the strictest counts
    (block, then allow). Patterns are compared in lower case; null patterns, actions and
    dates are left out, as are other actions. The last interval has no end.
    """
    known = entries.where(F.col("action").isin("block", "allow", "remove"))
    named = known.select(F.lower("pattern").alias("pattern"), "action", F.col("dated").cast("timestamp").alias("dated"))
    named = named.where(F.col("pattern").isNotNull() & F.col("dated").isNotNull())
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    one = named.groupBy("pattern", "dated").agg(F.min(F.struct(rank.alias("rank"), "action")).alias("entry"))
    # The next entry is in the same slice, or opens the pattern's next slice that has any:
    # no window holds more than a slice of a pattern's history, or its list of slices.
    sliced = one.withColumn("slice", F.floor(F.unix_timestamp("dated") / _SLICE))
    within = F.lead("dated").over(Window.partitionBy("pattern", "slice").orderBy("dated"))
    opening = sliced.groupBy("pattern", "slice").agg(F.min("dated").alias("opens"))
    following = F.lead("opens").over(Window.partitionBy("pattern").orderBy("slice"))
    opening = opening.select("pattern", "slice", following.alias("next_opens"))
    timeline = sliced.withColumn("next", within).join(opening, ["pattern", "slice"])
    later = F.coalesce("next", "next_opens").alias("valid_to")
    timeline = timeline.select("pattern", "entry.action", F.col("dated").alias("valid_from"), later)
    return timeline.where("action != 'remove'")


def _carried(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Per asked (pattern, slice) the interval open when the slice begins, if any.

    A row per pattern and slice in which it has entries or is asked for; intervals that
    begin within the slice itself are not among them.
    """
    marks = asked.select("pattern", "slice", F.lit(True).alias("asked")).distinct()
    lasts = entries.groupBy("pattern", "slice").agg(F.max("entry").alias("entry"))
    both = lasts.unionByName(marks, allowMissingColumns=True).groupBy("pattern", "slice")
    both = both.agg(F.max("entry").alias("entry"), F.coalesce(F.max("asked"), F.lit(False)).alias("asked"))
    before = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("open", F.last("entry", ignorenulls=True).over(before)).where(F.col("asked") & F.col("open").isNotNull())
    still = F.col("open.valid_to").isNull() | (F.unix_timestamp("open.valid_to") >= F.col("slice") * _SLICE)
    return carried.where(still).select("pattern", "open.action", "open.valid_from", "open.valid_to", "slice")


def evaluate(
    captures: DataFrame, entries: DataFrame, url_column: str = "url", time_column: str = "fetched"
) -> DataFrame:
    """Judge every capture by the list entries active when it was fetched.

    The most specific active pattern decides. Returns all rows and columns of
    ``captures`` with ``host``, ``verdict`` (``block``, ``allow``, ``unlisted``, or ``invalid``
    where the URL is null or has no host, or the time is null), ``pattern`` and ``valid_from``
    of the deciding entry; input columns of these names are replaced. A capture at the very
    moment of an entry falls under it. Repeated rows are judged each.
    """
    steps = Steps(captures.sparkSession)
    intervals = steps.land("intervals", validity(entries))
    columns = without(captures, "host", "verdict", "pattern", "valid_from")
    seconds = F.unix_timestamp(F.col(time_column).cast("timestamp"))
    rows = captures.select(
        *columns,
        host_of(F.col(url_column)).alias("host"),
        F.col(time_column).cast("timestamp").alias("__at"),
    )
    # Judged once per URL and moment: the rows of a capture that came twice share it.
    distinct = captures.select(F.col(url_column).alias("url"), F.col(time_column).cast("timestamp").alias("at"))
    distinct = distinct.where(host_of(F.col("url")).isNotNull() & F.col("at").isNotNull()).distinct()
    asked = distinct.select(
        "url", "at", F.floor(F.unix_timestamp("at") / _SLICE).alias("slice"), F.posexplode(patterns_of(F.col("url")))
    ).select("url", "at", "slice", F.col("pos").alias("place"), F.col("col").alias("pattern"))
    intervals = intervals.withColumn("slice", F.floor(F.unix_timestamp("valid_from") / _SLICE))
    entry = F.struct("valid_from", "action", "valid_to")
    sliced = intervals.unionByName(_carried(intervals.select("pattern", "slice", entry.alias("entry")), asked))
    active = (F.col("at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    met = asked.join(sliced, ["pattern", "slice"]).where(active)
    decided = met.groupBy("url", "at").agg(
        F.min(F.struct("place", "action", "pattern", "valid_from")).alias("entry")
    )
    decided = decided.select("url", "at", "entry.action", "entry.pattern", "entry.valid_from")
    left, right = rows.alias("c"), decided.alias("d")
    joined = left.join(right, (F.col(f"c.{url_column}") == F.col("d.url")) & (F.col("c.__at") == F.col("d.at")), "left")
    verdict = F.when(F.col("c.host").isNull() | F.col("c.__at").isNull(), "invalid").otherwise(
        F.coalesce("d.action", F.lit("unlisted"))
    )
    return joined.select(
        *[F.col(f"c.`{c}`") for c in columns], "c.host", verdict.alias("verdict"), "d.pattern", "d.valid_from"
    )
