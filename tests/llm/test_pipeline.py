"""The pipeline's stages on a small table, each against what its operator promises."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from clickreports.llm import queries
from clickreports.sources.store import Store
from tests.llm.test_operators import brute_components, brute_repeats, in_order

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    store = Store(spark)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(store.land(name, stage(spark, seen[-1], SF)))
    first, identified, unique, cut, mixed, packed = seen
    assert [s.columns for s in seen[:5]] == [list(corpus_pipeline.COLUMNS)] * 5
    texts = {r.doc_id: r.text for r in identified.collect()}
    assert identified.count() == first.where("length(trim(text)) > 0").count()
    components = brute_components(texts, 5)
    kept = {r.doc_id: r.text for r in unique.collect()}
    assert set(kept) == {i for i, (_, top) in components.items() if top == i}
    expected = brute_repeats(sorted(kept.items()))
    left = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert set(left) == set(expected)
    for i, (text, n) in left.items():
        assert n == len(text) and (expected[i][0][1] > 0 or text == kept[i])
    assert mixed.select("doc_id").subtract(cut.select("doc_id")).isEmpty()
    rows = packed.collect()
    assert len({(r.doc_id) for r in rows}) == mixed.select("doc_id").distinct().count()
    in_order(rows)
    store.close()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_statements(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    frame = queries.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(str([row[c] for c in columns]) for row in frame.collect())
    result = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted(str([row[names.index(c)] for c in columns]) for row in result.fetchall())
