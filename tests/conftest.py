from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clickreports.plans.marts import Marts  # noqa: E402
from clickreports.sources.events import EVENT_ID, RAW_SCHEMA, load_events  # noqa: E402

FIRST_DAY = "2024-01-01"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("clickreports-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Build a raw event table from rows that name only what matters to a test.

    Short names: ``uid``, ``name``, ``ts`` ("2024-01-01 10:00:00", None for unknown),
    ``rev`` and ``txn``; all other raw columns by their own name.
    """
    schema = T.StructType([*RAW_SCHEMA, T.StructField(EVENT_ID, T.LongType())])

    def build(rows):
        full = []
        for number, row in enumerate(rows, start=1):
            row = dict(row)
            moment = row.pop("ts", "2024-01-01 00:00:00")
            moment = dt.datetime.fromisoformat(moment) if moment else None
            short = {
                "user_id_final": row.pop("uid", "U1"),
                "event_name": row.pop("name", "page_view"),
                "event_ts_th": moment,
                "p_event_date": moment.date() if moment else dt.date.fromisoformat(FIRST_DAY),
                "ec_transaction_id": row.pop("txn", None),
                EVENT_ID: row.pop("id", number),
            }
            revenue = row.pop("rev", None)
            short["ec_purchase_revenue"] = None if revenue is None else Decimal(str(revenue))
            values = {**short, **row}
            unknown = set(values) - {field.name for field in schema}
            assert not unknown, unknown
            full.append(tuple(values.get(field.name) for field in schema))
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def events(spark, raw):
    return lambda rows: load_events(spark, raw(rows), FIRST_DAY)


@pytest.fixture(scope="session")
def marts(events):
    """Pre-aggregates over fixture rows, kept lazy unless given a store."""
    return lambda rows, store=None: Marts(events(rows), store)
