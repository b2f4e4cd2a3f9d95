"""Time the pre-aggregates and every report; print one JSON line.

``BENCH_SF_DIR`` names the test tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the
timed runs per report (after one warm-up; the median counts). Building the event table
and each pre-aggregate is timed once, cold, and listed as ``build_...``; the bundle of
all reports is timed once over the finished pre-aggregates.

``BENCH_EVENTS`` (such as 10000000) multiplies the events to about as many and gives a third
of them to one user. ``BENCH_OPS=1`` also times every training-data query once; those times
are listed but not part of the value.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from clickreports import BY_SOURCE, OVERALL, load_events, report  # noqa: E402
from clickreports.plans.bundle import bundle  # noqa: E402
from clickreports.plans.marts import Marts  # noqa: E402
from clickreports.sources.store import Store  # noqa: E402
from verification import registry  # noqa: E402
from verification.binding import raw_events  # noqa: E402

MARTS = (
    "users",
    "user_hours",
    "user_dimensions",
    "user_event_names",
    "user_page_paths",
    "user_referrers",
    "user_items",
    "purchases",
    "user_transitions",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clickreports-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def skewed(spark: SparkSession, sf_dir: str, events: int) -> Marts:
    """About so many events: each given one in several copies under users of their own, a third of all under one."""
    store = Store(spark)
    raw = raw_events(spark, sf_dir)
    copies = max(1, round(events / raw.count()))
    copied = raw.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    number = F.col("event_id") * copies + F.col("copy")
    own = F.concat(F.col("user_id_final"), F.lit("-"), F.col("copy").cast("string"))
    copied = copied.withColumns({"user_id_final": F.when(number % 3 == 0, "U0").otherwise(own), "event_id": number}).drop("copy")
    return Marts(load_events(spark, store.land("raw_events", copied)), store)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    events = int(os.environ.get("BENCH_EVENTS", "0"))
    opened: list[Marts] = []
    build = lambda: opened.append(skewed(spark, sf_dir, events) if events else registry.marts(spark, sf_dir))
    seconds = {"build_raw_events": timed(build)}
    m = opened[0]
    for name in MARTS:
        seconds[f"build_{name}"] = timed(lambda name=name: getattr(m, name))

    reports = [(name, name, False) for name in OVERALL]
    reports += [(f"{name}_per_source", name, True) for name in BY_SOURCE]
    for label, name, by_source in reports:
        run = lambda name=name, by_source=by_source: report(m, name, by_source).collect()
        run()
        seconds[label] = statistics.median(timed(run) for _ in range(runs))
    seconds["report_bundle"] = timed(lambda: bundle(m).collect())
    m.close()
    value = sum(seconds.values())
    if os.environ.get("BENCH_OPS") == "1":
        from clickreports.llm import queries as llm

        for name, query in llm.queries().items():
            seconds[name] = timed(lambda query=query: query(spark, sf_dir).write.format("noop").mode("overwrite").save())

    line = {
        "metric": "seconds to build the pre-aggregates, run every report and the bundle once",
        "value": round(value, 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
