from __future__ import annotations

import glob
import json

import pytest

from clickreports import BY_SOURCE, OVERALL, report
from clickreports.plans.bundle import SECTIONS, SOURCE_SECTIONS, bundle, write_bundle, write_tables
from clickreports.sources.store import Store
from verification import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def m(spark):
    return registry.marts(spark, SF)


@pytest.fixture(scope="module")
def document(spark, m, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bundle") / "json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so short a text is one part
    try:
        write_bundle(m, folder)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(glob.glob(f"{folder}/part-*"))
    assert len(files) > 1
    text = "".join(open(file, encoding="utf-8").read() for file in files)
    return text, json.loads(text)


def plain(rows):
    """Rows as the document shows them."""
    return [
        {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in row.asDict(recursive=True).items()}
        for row in rows
    ]


def test_all_sections_in_order(document):
    _, data = document
    assert len(SECTIONS) == 32 and list(data) == [*SECTIONS, "by_source"]
    assert len(SOURCE_SECTIONS) == 23
    for sections in data["by_source"].values():
        assert list(sections) == list(SOURCE_SECTIONS)
    assert list(data["by_source"]) == sorted(data["by_source"])


def test_is_indented_by_two(document):
    text, _ = document
    lines = text.splitlines()
    assert lines[0] == "{" and lines[1] == '  "meta" : {' and lines[2].startswith('    "total_events" : ')


def test_sections_equal_the_reports_in_order(m, document):
    _, data = document
    for name in SECTIONS:
        if name == "sankey":
            assert data[name]["links"] == plain(report(m, "sankey_links").collect())
            assert data[name]["nodes"] == plain(report(m, "sankey_nodes").collect())
        else:
            rows = plain(report(m, name).collect())
            assert data[name] == (rows[0] if name in ("meta", "kpi") else rows), name


def test_per_source_sections_equal_the_reports(m, document):
    _, data = document
    for name in SOURCE_SECTIONS:
        expected = {}
        for row in plain(report(m, name, by_source=True).collect()):
            expected.setdefault(row.pop("source_group"), []).append(row)
        for source, sections in data["by_source"].items():
            rows = expected.get(source, [])
            assert sections[name] == (rows[0] if name == "kpi" else rows), (name, source)


def test_source_without_rows_gets_empty_lists(spark, marts):
    rows = [{"uid": "U1"}, {"uid": "U1", "traffic_source_source": "google", "ts": "2024-01-02 00:00:00"}]
    m = marts(rows, Store(spark))
    data = json.loads("\n".join(r.text for r in bundle(m).orderBy("line").collect()))
    assert list(data["by_source"]) == ["Direct"]  # Search touched nobody first
    assert data["by_source"]["Direct"]["purchase_frequency"] == []
    assert data["purchase_frequency"] == []
    assert data["sankey"] == {"nodes": [], "links": []}


def test_tables(spark, m, tmp_path):
    write_tables(m, str(tmp_path))
    for name in ("daily_trend", "funnel_by_source"):
        assert spark.read.parquet(f"{tmp_path}/{name}").collect() == report(m, name).collect()
        stored = spark.read.parquet(f"{tmp_path}/by_source/{name}")
        assert sorted(stored.collect()) == sorted(report(m, name, by_source=True).collect())
    assert len(glob.glob(f"{tmp_path}/*")) == len(OVERALL) + 1
    assert len(glob.glob(f"{tmp_path}/by_source/*")) == len(BY_SOURCE)
