"""Top-k overall and per group, with a stated order for ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(*keys: str) -> list[Column]:
    """Sort columns: ``-name`` descends, NULLs come first when ascending."""
    return [
        F.col(key[1:]).desc_nulls_last() if key.startswith("-") else F.col(key).asc_nulls_first()
        for key in keys
    ]


def top_k(rows: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    return rows.orderBy(*ordering(*order)).limit(k)


def top_k_per(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """First ``k`` rows of each group; only that many per task enter the shuffle."""
    window = Window.partitionBy(*by).orderBy(*ordering(*order))
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def top(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int | None) -> DataFrame:
    """``top_k_per`` with groups, ``top_k`` without, everything without ``k``."""
    if k is None:
        return rows
    return top_k_per(rows, by, order, k) if by else top_k(rows, order, k)
