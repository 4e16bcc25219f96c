"""Candidate reduction: offers that no gate can tell apart are one cell.

Matching runs between distinct cells, never between rows, so its size follows the dictionaries and pack sizes and
not the number of offers. Each cell keeps its row count and its k best offers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_MARK = "\u0000"


def key_of(*cols: str | Column) -> Column:
    """One string key over several columns; null differs from every value."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_MARK)) for c in cols]
    return F.concat_ws("|", *parts)


def short_key(*cols: str | Column) -> Column:
    """``key_of`` in 16 bytes, for keys that are stored or moved."""
    return F.unhex(F.md5(key_of(*cols)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark cuts to k rows per key before the shuffle as well, so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_value: str,
    right_value: str,
    low: float,
    high: float,
    how_far: int = 2,
) -> DataFrame:
    """Equi-join on ``keys`` where right_value lies in [low, high] × left_value, through logarithmic buckets.

    The left side is copied to the few buckets its band touches. Callers test the exact band themselves, since the
    profiles differ in how they compare. Rows with a null or non-positive value on either side do not join.
    """
    width = math.log(high / low) / how_far
    edge = 1e-9

    def bucket(value: Column, shift: float) -> Column:
        return F.floor(F.log(value) / F.lit(width) + F.lit(shift))

    r = right.filter(F.col(right_value) > 0).withColumn("_bucket", bucket(F.col(right_value), 0.0))
    lv = F.col(left_value)
    l = left.filter(lv > 0).withColumn(
        "_bucket", F.explode(F.sequence(bucket(lv * low, -edge), bucket(lv * high, edge)))
    )
    return l.join(r, [*keys, "_bucket"]).drop("_bucket")


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """Reason of the first failing gate, null when all pass."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for reason, failed in gates])


def both_differ(a: Column, b: Column) -> Column:
    """Both known and different."""
    return F.coalesce(a != b, F.lit(False))
