"""Exact top-k search by inner product: tiled matrix products and merged lists.

Vectors are quantized to whole numbers and dealt into shards, queries into blocks, both of
bounded size (``tiles``). A tile is one block of queries against one shard: a matrix
product and the ``k`` best of each query. Lists of a query are merged as a tree, so that no
task sees more than a few lists of a query at once. A query set that grows with the table
makes more blocks, each of which is broadcast in its turn and reads every shard where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickreports.llm import tiles
from clickreports.llm.steps import Steps

QUERIES = 256  # rows of a product
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

_SHARD = "shard int, dims int, ids binary, rows binary, points binary"
_LIST = "query_row long, query_id long, shard int, vec_id long, row long, score long"


def top_k(
    vectors: DataFrame,
    asked: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """The ``k`` rows with the largest inner product for every row of ``vectors`` where ``asked`` is true.

    All rows but the query's own are candidates, also rows that share its id; every query
    row gets a list of its own. Each component x counts as floor(``scale`` * x), x as double,
    and scores are whole numbers, exact for components of any size; a score beyond a long
    counts as the nearest long. Ties go to the smaller id; with fewer than ``k`` candidates
    there are as many rows. Vectors without an id, null, or with a null or non-finite component
    take no part; an empty vector scores 0 with other empty ones, and only vectors of one
    length are compared. Other columns play no part, whatever their names.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.
    """
    found = tiles.points(vectors, asked, id_column, vector_column, zeros=True)
    order = (F.col("score").desc(), F.col("vec_id").asc(), F.col("row").asc())
    return tiles.best_lists(Steps(vectors.sparkSession), found, order, (_packed, _SHARD), (_searched(k, scale), _LIST), k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            kinds = (("ids", np.int64), ("rows", np.int64), ("points", np.float64))
            cells = [pa.array([tiles.numbers(batch.column(c)[i], kind).tobytes()], pa.binary()) for c, kind in kinds]
            columns = [batch.column(c).slice(i, 1) for c in ("shard", "dims")]
            yield pa.RecordBatch.from_arrays(columns + cells, ["shard", "dims", "ids", "rows", "points"])


def codes(points: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where all are exact there, else Python's whole numbers."""
    with np.errstate(over="ignore"):
        found = np.floor(points * float(scale))
    if np.isfinite(found).all():
        return found
    # Doubles this large are whole numbers themselves.
    whole = [int(x) * scale if abs(x) >= _EXACT else int(np.floor(x * scale)) for x in points.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(points.shape)


def product(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact whole-number products of codes: in doubles while every sum stays below 2^53."""
    if queries.shape[1] == 0 or not len(points):
        return np.zeros((len(queries), len(points)), dtype=np.int64)
    if queries.dtype != object and points.dtype != object:
        with np.errstate(over="ignore"):
            most = float(np.abs(queries).max()) * float(np.abs(points).max()) * queries.shape[1]
        if most < _EXACT:
            return (queries @ points.T).astype(np.int64)
        if most < 2.0**62:
            return queries.astype(np.int64) @ points.T.astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in side], dtype=object) for side in (queries, points)]
    exact = whole[0] @ whole[1].T
    return np.array([[min(max(x, _LEAST), _MOST) for x in row] for row in exact], dtype=np.int64)


def _searched(k: int, scale: int):
    def best(query_rows: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray):
        """Row and column of each query's ``k`` best by (score, smaller id), itself left out."""
        for i in range(len(scores)):
            line = scores[i]
            at = np.flatnonzero(rows != query_rows[i])
            if len(at) > k:
                edge = np.partition(line[at], len(at) - k)[len(at) - k]
                at = at[line[at] >= edge]
            at = at[np.lexsort((rows[at], ids[at]))]
            at = at[np.argsort(~line[at], kind="stable")[:k]]  # falling; unlike the negative, ~ cannot overflow
            yield np.full(len(at), i), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(batch.column(name)[row].as_py(), dtype=kind)  # noqa: B023, E731
                dims, shard = batch.column("dims")[row].as_py(), batch.column("shard")[row].as_py()
                ids, rows = cell("ids", np.int64), cell("rows", np.int64)
                points = codes(cell("points", np.float64).reshape(len(ids), dims), scale)
                q = batch.column("q")[row]
                query_ids, query_rows = tiles.numbers(q["ids"], np.int64), tiles.numbers(q["rows"], np.int64)
                queries = codes(tiles.matrix(q["points"], len(query_ids), dims), scale)
                for lo in range(0, len(query_ids), QUERIES):
                    part = slice(lo, lo + QUERIES)
                    scores = product(queries[part], points)
                    which, at = (np.concatenate(x) for x in zip(*best(query_rows[part], ids, rows, scores), strict=True))
                    columns = [query_rows[part][which], query_ids[part][which], np.full(len(at), shard, np.int32), ids[at], rows[at], scores[which, at]]
                    names = ["query_row", "query_id", "shard", "vec_id", "row", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run
