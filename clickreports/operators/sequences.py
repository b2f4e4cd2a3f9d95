"""Event order within a user: repeats, transitions, first steps, paths.

A user's events cannot be assumed to fit one task: one id may hold a large share of
the table. Windows therefore run over (uid, time slice), and a second window over
only the edges of the slices, or only the first rows of each, joins the slices up.
The results equal those of one window over the whole user.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clickreports import config
from clickreports.functions.categories import depth, relabel
from clickreports.operators.ranking import top_k
from clickreports.operators.users import event_order, tie_key
from clickreports.sources.events import EVENT_ID

SLICE_SECONDS = 60
SLICE_IDS = 4096


def only_events(events: DataFrame, names: Iterable[str]) -> DataFrame:
    return events.where(F.col("event_name").isin(*names))


def with_slice(events: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Number the slice of each event; slices ascend with the order of events.

    Known times have slices of ``seconds``. Events of unknown time, first in order, have
    slices of ``SLICE_IDS`` ids, or one per event name where there are no ids.
    """
    unknown = F.floor(F.col(EVENT_ID) / F.lit(SLICE_IDS)).cast("string") if EVENT_ID in events.columns else F.col("event_name")
    time = F.floor(F.unix_timestamp("event_ts") / F.lit(seconds))
    return events.withColumn("slice", F.struct(time.alias("time"), F.when(time.isNull(), unknown).alias("part")))


def run_lengths(events: DataFrame) -> DataFrame:
    """The columns that order and name a user's events, and ``repeats``, the events a row stands for.

    Without ids, a user's events of one time and name follow each other and cannot be told
    apart: they become one row, counted on the map side, before any window. So however many
    events a user has at one time (or at unknown times), they are as many rows as names.
    """
    if EVENT_ID in events.columns:
        return events.select("uid", "event_ts", EVENT_ID, "event_name", F.lit(1).cast("long").alias("repeats"))
    return events.groupBy("uid", "event_ts", "event_name").agg(F.count(F.lit(1)).alias("repeats"))


def with_previous(events: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """``run_lengths`` with ``previous``, the name of the event before the row's first (NULL for the user's first).

    A row's further ``repeats`` follow an event of their own name.
    """
    events = run_lengths(events)
    rows = with_slice(events, seconds)
    within = _in_order(events, "uid", "slice")
    rows = rows.withColumn("previous", F.lag("event_name").over(within)).withColumn(
        "following", F.lead("event_name").over(within)
    )
    opens = F.col("previous").isNull()
    inner = rows.where(~opens).select(*events.columns, "previous")
    edges = rows.where(opens | F.col("following").isNull()).withColumn(
        "before", F.lag("event_name").over(_in_order(events, "uid"))
    )
    opening = edges.where(opens).select(*events.columns, F.col("before").alias("previous"))
    return inner.unionByName(opening)


def collapse_repeats(events: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Drop events that repeat the user's preceding one."""
    rows = with_previous(events, seconds)
    return rows.where(_changed("previous")).drop("previous", "repeats")


def transitions(events: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Pairs (source_event, target_event) of each user's successive different events.

    Between collapsed events the next one always differs, so these are exactly the
    neighbouring rows whose names differ.
    """
    rows = with_previous(events, seconds).where(F.col("event_name") != F.col("previous"))
    return rows.select("uid", F.col("previous").alias("source_event"), F.col("event_name").alias("target_event"))


def user_transitions(events: DataFrame, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Each user's transitions once, whatever their number."""
    return transitions(events, seconds).distinct()


def transition_users(user_transitions: DataFrame) -> DataFrame:
    """Distinct users per transition; ``user_transitions`` has each user's pairs once."""
    return user_transitions.groupBy("source_event", "target_event").agg(F.count(F.lit(1)).alias("user_count"))


def first_n(rows: DataFrame, n: int, by: Sequence[str] = ("uid",)) -> DataFrame:
    """First ``n`` rows of each group in event order, numbered in ``step_no``."""
    return rows.withColumn("step_no", F.row_number().over(_in_order(rows, *by))).where(F.col("step_no") <= n)


def first_steps(events: DataFrame, n: int, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Each user's first ``n`` events after dropping repeats.

    ``n + 1`` collapsed rows per slice suffice: joining slices drops at most the first
    row of each, so a slice cut short still supplies all ``n`` steps on its own.
    """
    rows = with_slice(run_lengths(events), seconds).drop("repeats")
    heads = first_n(_collapse(rows, "uid", "slice"), n + 1, ("uid", "slice"))
    return first_n(_collapse(heads, "uid"), n).drop("slice")


def user_paths(steps: DataFrame) -> DataFrame:
    """The ordered event names of each user's steps, and how many there are."""
    ordered = F.sort_array(F.collect_list(F.struct("step_no", "event_name")))
    return steps.groupBy("uid").agg(
        F.transform(ordered, lambda step: step["event_name"]).alias("path"),
        F.count(F.lit(1)).alias("steps"),
    )


def forward_edges(
    edges: DataFrame, source: str = "source", target: str = "target"
) -> DataFrame:
    """Keep transitions that lead deeper, so the graph has no cycles."""
    deeper = depth(target, config.DEPTH_OF_UNKNOWN_TARGET) > depth(source, config.DEPTH_OF_UNKNOWN_SOURCE)
    return edges.where(deeper)


def transition_links(
    user_transitions: DataFrame,
    min_users: int = config.LIMITS.transition_min_users,
    limit: int = config.LIMITS.transition_links,
    labels: Mapping[str, str] = config.EVENT_LABELS,
    limit_first: bool = False,
) -> DataFrame:
    """Most common forward transitions between labelled events.

    ``user_transitions`` has each user's pairs of labelled events once (see ``transitions``).
    With ``limit_first`` the limit counts backward transitions too, which then go, so
    that fewer than ``limit`` may come out.
    """
    counted = transition_users(user_transitions).where(F.col("user_count") >= min_users)
    order = ["-user_count", "source_event", "target_event"]
    counted = counted.withColumn("source", relabel("source_event", labels))
    counted = counted.withColumn("target", relabel("target_event", labels))
    if limit_first:
        links = forward_edges(top_k(counted, order, limit))
    else:
        links = top_k(forward_edges(counted), order, limit)
    return links.select("source", "target", F.col("user_count").alias("value"))


def link_nodes(links: DataFrame) -> DataFrame:
    """The distinct ends of links, with their depth."""
    ends = links.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    return ends.withColumn("depth", depth("name", config.DEPTH_OF_UNKNOWN_TARGET))


def common_journeys(
    events: DataFrame,
    steps: int = config.LIMITS.journey_steps,
    limit: int = config.LIMITS.journey_paths,
    labels: Mapping[str, str] = config.EVENT_LABELS,
) -> DataFrame:
    """Most common first steps of users, as arrays of labels.

    ``longer`` tells journeys that go on after ``steps`` from those that end there.
    """
    paths = user_paths(first_steps(only_events(events, labels), steps + 1))
    paths = paths.withColumn("longer", F.col("steps") > steps).withColumn("path", F.slice("path", 1, steps))
    paths = paths.withColumn("steps", F.least("steps", F.lit(steps)))
    counted = paths.groupBy("path", "steps", "longer").agg(F.count(F.lit(1)).alias("users"))
    keyed = counted.withColumn("raw_path", F.array_join("path", config.PATH_SEPARATOR))
    common = top_k(keyed, ["-users", "raw_path", "longer"], limit)
    return common.withColumn("path", F.transform("path", lambda name: relabel(name, labels)))


def _in_order(rows: DataFrame, *by: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*event_order(tie_key(rows, "event_name")))


def _changed(previous: str) -> Column:
    return F.col(previous).isNull() | (F.col("event_name") != F.col(previous))


def _collapse(rows: DataFrame, *by: str) -> DataFrame:
    """Drop repeats within each group, by one window over it."""
    known = rows.withColumn("previous", F.lag("event_name").over(_in_order(rows, *by)))
    return known.where(_changed("previous")).drop("previous")
