"""Nearest neighbours by collision counting over sorted projections.

Vectors are dealt into shards of bounded size (``tiles``). A shard's index holds, for
each of ``PROJECTIONS`` random directions, the shard's vectors sorted by their projection.
A query opens a window centred at its own projection in every array and counts, per
vector, the windows that hold it. Windows widen by steps of ``WIDEN`` (virtual rehashing:
one array serves all widths, and a step counts only what it adds). Vectors whose count
reaches the threshold are verified by their exact distance.

A vector at distance s lies in a window of half-width h with probability 2 * Phi(h / s) - 1,
for each direction anew. Widening ends at h = ``REACH`` times the distance of the k-th best
vector verified: whatever is nearer than that has then reached the threshold with a
probability of at least 1 - ``MISS``, the threshold being that quantile of the binomial
distribution. There is no cap on candidates.

The index covers every row and is landed; it needs no fitting. Queries come in blocks of
bounded size, each of which is broadcast to the shards in turn, and the shards' lists of a
query are merged as a tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickreports.llm import tiles
from clickreports.llm.steps import Steps
from clickreports.llm.tiles import numbers

PROJECTIONS = 64
REACH = 1.2
MISS = 0.05
WIDEN = 1.4
OPENING = 0.4  # the first windows' half-width, in spreads of the shard's projections
QUERIES = 256  # that widen together within a task
LARGE = 1e100  # vectors with a component beyond it are verified without counting

_INDEX = "shard int, dims int, ids binary, rows binary, points binary, places binary, projections binary"
_LIST = "query_row long, query_id long, shard int, vec_id long, row long, score double"


def nearest(
    vectors: DataFrame, asked: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows found for every row of ``vectors`` where ``asked`` is true.

    All rows but the query's own are candidates, also rows that share its id; every query
    row gets a list of its own. Rows without an id, and vectors that are null, empty, zero
    or hold a null or non-finite component take no part. Vectors are compared with those
    of their own length. Other columns play no part, whatever their names.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the Euclidean distance in
    double precision, nearest first, ties to the smaller id. Fewer candidates than ``k`` all
    come out; an empty table has no rows.
    """
    found = tiles.points(vectors, asked, id_column, vector_column, zeros=False)
    order = (F.col("score").asc(), F.col("vec_id").asc(), F.col("row").asc())
    return tiles.best_lists(Steps(vectors.sparkSession), found, order, (_indexed, _INDEX), (_searched(k), _LIST), k)


@lru_cache(maxsize=4)
def _directions(dims: int) -> np.ndarray:
    return np.random.default_rng(dims).standard_normal((dims, PROJECTIONS))


def _projected(points: np.ndarray) -> np.ndarray:
    """One row per direction; components beyond ``LARGE`` count as 0."""
    return (np.where(np.abs(points) > LARGE, 0.0, points) @ _directions(points.shape[1])).T


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            dims = batch.column("dims")[i].as_py()
            points = numbers(batch.column("points")[i], np.float64).reshape(-1, dims)
            projections = _projected(points)
            places = np.argsort(projections, axis=1, kind="stable")
            cells = [
                numbers(batch.column("ids")[i], np.int64),
                numbers(batch.column("rows")[i], np.int64),
                points,
                places.astype(np.int32),
                np.take_along_axis(projections, places, axis=1),
            ]
            shard = batch.column("shard")[i].as_py()
            columns = [pa.array([shard], pa.int32()), pa.array([dims], pa.int32())]
            columns += [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in cells]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "dims", "ids", "rows", "points", "places", "projections"])


def threshold(projections: int = PROJECTIONS, reach: float = REACH, miss: float = MISS) -> int:
    """The most collisions that a vector at the window's reach has with probability 1 - ``miss``."""
    p = erf(reach / sqrt(2.0))
    below = 0.0
    for count in range(projections + 1):
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also where squares leave a double's range."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(rows).max(axis=1)
        found = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        odd = np.flatnonzero(((most > 1e150) | (most < 1e-150)) & (most > 0) & np.isfinite(most))
        if len(odd):
            part = rows[odd] / most[odd, None]
            found[odd] = np.sqrt(np.einsum("ij,ij->i", part, part)) * most[odd]
    return found


class Shard:
    """One shard's arrays, and the widening of queries' windows over them."""

    def __init__(self, ids, rows, points, places, projections):
        self.ids, self.rows, self.points, self.projections = ids, rows, points, projections
        self.least = threshold()
        self.flat = places.astype(np.int64).ravel()
        self.lines = np.arange(len(places)) * len(ids)
        self.spread = float(np.sqrt(np.mean(projections.var(axis=1)))) or 1.0
        self.large = np.flatnonzero((np.abs(points) > LARGE).any(axis=1))

    def search(self, rows: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int) -> list[Query]:
        """Every query's nearest verified; all queries widen together, each until it ends."""
        asked = [Query(self, row, query, k) for row, query in zip(rows, queries, strict=True)]
        furthest = np.maximum(np.abs(centres - self.projections[:, 0]), np.abs(centres - self.projections[:, -1])).max(axis=1)
        half = np.full(len(asked), OPENING * self.spread)
        low = np.stack([line.searchsorted(c) for line, c in zip(self.projections, centres.T, strict=True)], axis=1)
        high, on = low.copy(), np.arange(len(asked))
        while len(on):
            windows = zip(self.projections, (centres[on] - half[on, None]).T, (centres[on] + half[on, None]).T, strict=True)
            ends = [(line.searchsorted(a, "left"), line.searchsorted(b, "right")) for line, a, b in windows]
            wide_low, wide_high = (np.stack(x, axis=1) for x in zip(*ends, strict=True))
            goals = np.array([self._widened(asked[i], *x) for i, *x in zip(on, wide_low, low[on], high[on], wide_high, strict=True)])
            low[on], high[on] = np.minimum(wide_low, low[on]), np.maximum(wide_high, high[on])
            more = (half[on] < goals) & (half[on] < furthest[on])
            on, goals = on[more], goals[more]
            half[on] = np.minimum(half[on] * WIDEN, np.maximum(goals, half[on] * 1.01))
        for query in asked:
            if query.short():
                query.verify(np.arange(len(self.ids)))
        return asked

    def _widened(self, query: Query, wide_low, low, high, wide_high) -> float:
        """Count what the windows have gained, verify, and say how far the windows must reach."""
        slices = [self.flat[o + a : o + b] for o, a, b in zip(self.lines, wide_low, low, strict=True)]
        slices += [self.flat[o + a : o + b] for o, a, b in zip(self.lines, high, wide_high, strict=True)]
        query.counts += np.bincount(np.concatenate(slices), minlength=len(self.ids))
        query.verify(np.flatnonzero(query.pending & (query.counts >= self.least)))
        return query.goal()


class Query:
    """One query within one shard: collisions so far, the best verified."""

    def __init__(self, shard: Shard, row: int, query: np.ndarray, k: int):
        self.shard, self.query, self.k = shard, query, k
        self.counts, self.pending = np.zeros(len(shard.ids), dtype=np.int64), shard.rows != row
        self.found, self.distances = np.zeros(0, np.int64), np.zeros(0)
        self.verify(shard.large if np.abs(query).max() <= LARGE else np.arange(len(shard.ids)))

    def verify(self, places: np.ndarray) -> None:
        places = places[self.pending[places]]
        if not len(places):
            return
        self.pending[places] = False
        apart = lengths(self.shard.points[places] - self.query)
        self.found, self.distances = np.concatenate((self.found, places)), np.concatenate((self.distances, apart))
        if len(self.found) > self.k:
            keep = self.distances <= np.partition(self.distances, self.k - 1)[self.k - 1]
            self.found, self.distances = self.found[keep], self.distances[keep]

    def short(self) -> bool:
        return len(self.found) < self.k and bool(self.pending.any())

    def goal(self) -> float:
        """The half-width that ends the search."""
        if not self.pending.any():
            return 0.0
        return REACH * self.distances.max() if len(self.found) >= self.k else np.inf


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch, i)

    def one(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
        cell = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), dtype=kind)
        dims = batch.column("dims")[i].as_py()
        ids = cell("ids", np.int64)
        places = cell("places", np.int32).reshape(PROJECTIONS, len(ids))
        projections = cell("projections", np.float64).reshape(PROJECTIONS, len(ids))
        shard = Shard(ids, cell("rows", np.int64), cell("points", np.float64).reshape(-1, dims), places, projections)
        q = batch.column("q")[i]
        query_ids, query_rows = numbers(q["ids"], np.int64), numbers(q["rows"], np.int64)
        queries = numbers(q["points"], np.float64).reshape(-1, dims)
        centres = _projected(queries).T
        lists = []
        for lo in range(0, len(queries), QUERIES):
            part = slice(lo, lo + QUERIES)
            asked = shard.search(query_rows[part], queries[part], centres[part], k)
            for query_row, query_id, one_query in zip(query_rows[part], query_ids[part], asked, strict=True):
                found, distances = one_query.found, one_query.distances
                order = np.lexsort((shard.rows[found], ids[found], distances))[:k]
                best = found[order]
                own = np.full((2, len(best)), [[query_row], [query_id]])
                lists.append((own[0], own[1], ids[best], shard.rows[best], distances[order]))
        row, query_id, vec_id, near_row, score = (np.concatenate(x) for x in zip(*lists, strict=True))
        shard_of = np.full(len(row), batch.column("shard")[i].as_py(), dtype=np.int32)
        names = ["query_row", "query_id", "shard", "vec_id", "row", "score"]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (row, query_id, shard_of, vec_id, near_row, score)], names)

    return run
