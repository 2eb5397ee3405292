"""Bounded best-k per group without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group in ``order`` (make it total), with their rank.

    Each group is first cut into salted shards that keep ``k`` rows each, so the final sort sees at most
    ``SALTS * k`` rows of a group.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    shard = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = salted.withColumn("_r", F.row_number().over(shard)).where(F.col("_r") <= k).drop("_r", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return first.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
