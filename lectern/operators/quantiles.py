"""Exact order statistics of a column by counts over ranges: no task ever sorts or holds all values.

Values are counted in RANGES equal ranges between the least and the greatest; the range that holds the rank asked for
is counted again, until it holds few enough rows to be sorted or a single value. The driver gets one row of each round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges of a round, and rows that are sorted at once.
RANGES, FEW = 4096, 50_000


def value_at(df: DataFrame, column: str, rank: int) -> float | None:
    """The value with so many lesser or equal ones before it (rank from 0), nulls left out; None where there is none."""
    rows = df.select(F.col(f"`{column}`").cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).first()
    if rank < 0 or rank >= span["n"]:
        return None
    lo, hi, n = span["lo"], span["hi"], span["n"]
    while lo < hi and n > FEW:
        width = hi - lo
        within = rows.where((F.col("v") >= lo) & (F.col("v") <= hi))
        place = F.least(F.lit(RANGES - 1), F.floor((F.col("v") - lo) / width * RANGES)) if math.isfinite(width) and width > 0 else F.when(F.col("v") > 0, 1).otherwise(0)
        counts = within.groupBy(place.alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r["p"]):  # at most RANGES rows
            if rank < r["n"]:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            rank -= r["n"]
    if lo == hi:
        return lo
    return rows.where((F.col("v") >= lo) & (F.col("v") <= hi)).orderBy("v").offset(rank).limit(1).first()["v"]


def median(df: DataFrame, column: str) -> float | None:
    """The middle value, or the mean of the two middle ones; None without values."""
    n = df.where(F.col(f"`{column}`").isNotNull() & ~F.isnan(F.col(f"`{column}`").cast("double"))).count()
    if not n:
        return None
    low = value_at(df, column, (n - 1) // 2)
    return low if n % 2 else (low + value_at(df, column, n // 2)) / 2


def percentile(df: DataFrame, column: str, share: float) -> float | None:
    """The nearest-rank percentile: the least value that at least such a share of values doesn't exceed."""
    n = df.where(F.col(f"`{column}`").isNotNull() & ~F.isnan(F.col(f"`{column}`").cast("double"))).count()
    return value_at(df, column, max(0, math.ceil(share * n) - 1)) if n else None
