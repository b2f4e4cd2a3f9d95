"""Vectors dealt into shards, queries in blocks, and the merging of per-shard lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickreports.llm.steps import Steps

SHARD_VALUES = 1 << 18  # components of a shard, 2 MB
BLOCK_VALUES = 1 << 20  # components of a block of queries, 8 MB, which is broadcast
FAN = 16

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def points(vectors: DataFrame, asked: Column, id_column: str, vector_column: str, zeros: bool) -> DataFrame:
    """``row``, ``id``, ``point``, ``dims`` and ``asked`` of the vectors that take part.

    Those are neither null nor without an id, and have finite components only; with
    ``zeros`` false, at least one other than 0. Every row is numbered, also if it shares its id.
    """
    doubles = F.col(vector_column).cast("array<double>")
    fit = F.forall(doubles, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    if not zeros:
        fit = fit & F.exists(doubles, lambda x: x != 0)
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & fit).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        doubles.alias("point"),
        F.size(vector_column).alias("dims"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
    )


def best_lists(
    steps: Steps, found: DataFrame, order: tuple[Column, ...], index: tuple[Batches, str], search: tuple[Batches, str], k: int
) -> DataFrame:
    """Every asked row's ``k`` best of all rows, by ``order``: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``found`` are ``points``. ``index`` turns a shard's rows (``shard``, ``dims``, ``ids``, ``rows``,
    ``points``) into its landed form, ``search`` a shard beside a block of queries (``q``) into
    lists (``query_row``, ``query_id``, ``shard``, ``vec_id``, ``row``, ``score``). Lists are merged as a
    tree, ``FAN`` shards at a time.
    """
    landed = steps.land("points", found)
    sizes = landed.agg(F.sum("dims"), F.sum(F.when(F.col("asked"), F.col("dims")))).first()
    # An empty vector counts as one component.
    rows = landed.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    shards, blocks = (
        max(1, -(-((n or 0) + r) // each)) for n, r, each in zip(sizes, rows, (SHARD_VALUES, BLOCK_VALUES), strict=True)
    )
    shard_rows = steps.land("shards", _gathered(landed, "shard", shards).mapInArrow(*index))
    queries = _gathered(landed.where("asked"), "block", blocks)
    queries = steps.land("queries", queries.select("block", "dims", F.struct("ids", "rows", "points").alias("q")))
    lists = None
    for block in range(blocks):
        # BLOCK_VALUES bounds the components of a block.
        held = F.broadcast(queries.where(F.col("block") == block).drop("block"))
        part = steps.land(f"lists_{block}", shard_rows.join(held, "dims").mapInArrow(*search))
        lists = part if lists is None else lists.unionByName(part)
    width = shards
    while width > FAN:
        width = -(-width // FAN)
        lists = lists.withColumn("shard", (F.col("shard") / FAN).cast("int"))
        best = Window.partitionBy("query_row", "shard").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    best = Window.partitionBy("query_row").orderBy(*order)
    ranked = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return steps.result(ranked.select("query_id", "rank", "vec_id", "score"))


def _gathered(found: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows dealt by a hash of their number into ``parts``, each a row of lists per length."""
    dealt = found.withColumn(key, F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    rows = dealt.groupBy(key, "dims").agg(F.collect_list(F.struct("id", "row", "point")).alias("all"))
    return rows.select(
        key, "dims", F.col("all.id").alias("ids"), F.col("all.row").alias("rows"), F.flatten("all.point").alias("points")
    )


def numbers(cell: pa.Scalar, kind) -> np.ndarray:
    """A list cell as an array."""
    return np.asarray(cell.values).astype(kind) if len(cell) else np.zeros(0, kind)


def matrix(cell: pa.Scalar, rows: int, dims: int) -> np.ndarray:
    return numbers(cell, np.float64).reshape(rows, dims)
