"""Mixing sources to target shares by Poisson replication.

Each record is taken as often as a Poisson variable says, whose mean is its source's repetition rate and whose
value comes from inverting the distribution at a number hashed from a seed and the record's key, cut at the
source's cap. Rates follow from targets: with T the size of the mixture, a source of available size A and
share s needs the mean s T / A. Sizes are tokens of a public tokenizer.

As counts only rise with the rate, a source's size in the mixture is a step function of its rate. Its
distribution over the hashed numbers is summed in a fixed number of bins, and the rate is solved on these sums
so that the reached size meets the target, not only its expectation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokenize import VOCABULARY, send, token_counts
from lectern.session import spread, written

#: Bins of the hashed numbers per source; the driver gets at most this many sums a source.
BINS = 2048
#: Sources a mixture may have; the table of targets is a parameter list, not data.
MAX_SOURCES = 1000


def poisson_cdf(count: int, rate: float) -> float:
    return sum(math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in range(count + 1)) if rate > 0 else 1.0


@dataclass(frozen=True)
class Plan:
    """Of a source: its targets, what is available, and the numbers above which a record is taken once more."""

    source: str
    share: float
    cap: int
    available: int
    thresholds: tuple[float, ...]


def solve(sums: list[float], share_size: float, cap: int) -> tuple[float, ...]:
    """Thresholds of the counts 1..cap such that records binned by sums reach share_size as nearly as a bin allows."""
    total = sum(sums)
    above, rest = [0.0] * (len(sums) + 1), 0.0
    for i in range(len(sums) - 1, -1, -1):
        rest += sums[i]
        above[i] = rest

    def reached(rate: float) -> float:
        size = 0.0
        for count in range(cap):
            x = poisson_cdf(count, rate) * len(sums)
            i = min(int(x), len(sums) - 1)
            size += above[i + 1] + (i + 1 - x) * sums[i]
        return size

    if share_size >= cap * total:
        return (0.0,) * cap
    lo, hi = 0.0, 1.0
    while reached(hi) < share_size and hi < 700:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if reached(mid) < share_size else (lo, mid)
    return tuple(poisson_cdf(count, hi) for count in range(cap))


def sized(df: DataFrame, key: str, text: str, source: str, tokenizer: str = VOCABULARY, seed: int = 0) -> DataFrame:
    """Rows (doc_id, source, text, n_tokens, u) with u in [0, 1) hashed from seed and key."""

    send(df, tokenizer)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return token_counts(texts, tokenizer).astype("int32")

    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    return spread(df).select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), count(text).alias("n_tokens"), u.alias("u"))


def plan(rows: DataFrame, targets: DataFrame, total: float | None = None) -> list[Plan]:
    """One plan a source of targets (source, target_share, max_repeats). rows: (source, n_tokens, u).

    Without total the mixture is the largest in which every source keeps its share within its cap.
    """
    wanted = targets.limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    own = rows.join(F.broadcast(targets.select("source")), "source", "left_semi")
    bins = own.groupBy("source", F.least(F.lit(BINS - 1), (F.col("u") * BINS).cast("int")).alias("bin")).agg(F.sum("n_tokens").alias("n"))
    sums: dict[str, list[float]] = {}
    for r in bins.collect():  # at most MAX_SOURCES x BINS sums, however many rows
        sums.setdefault(r["source"], [0.0] * BINS)[r["bin"]] = float(r["n"])
    most = [r["max_repeats"] * sum(sums.get(r["source"], [0.0])) / r["target_share"] for r in wanted if (r["target_share"] or 0) > 0]
    size = min([*most, *([total] if total is not None else [])], default=0.0)
    return [
        Plan(
            r["source"],
            r["target_share"] or 0.0,
            r["max_repeats"],
            int(sum(sums.get(r["source"], [0.0]))),
            solve(sums.get(r["source"], [0.0] * BINS), (r["target_share"] or 0.0) * size, r["max_repeats"]),
        )
        for r in wanted
        if (r["target_share"] or 0) > 0 and size > 0
    ]


def repeats(plans: list[Plan]) -> Column:
    """How often a row (source, u) is taken; 0 for sources without a plan."""
    out = F.lit(0)
    for p in plans:
        count = F.lit(0)
        for t in p.thresholds:
            count = count + (F.col("u") >= t).cast("int")
        out = F.when(F.col("source") == p.source, count).otherwise(out)
    return out


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = VOCABULARY, seed: int = 0, total: float | None = None) -> DataFrame:
    """The mixture, one row a taken copy, in global random order: doc_id, source, repeat (from 1), n_tokens,
    text, shuffle_key (rows are ordered by it).

    Rows whose source is null or has no target are left out, and so are rows without tokens (null or empty
    texts): they add nothing to a share. A row whose key repeats is taken with its copies alike. Targets that
    can't be met because a source is missing or empty give an empty mixture; an empty table does too.
    """
    # sizes are counted once; the plan reads only their columns
    rows = written(sized(df.where(F.length(text) > 0), key, text, source, tokenizer, seed), "sized")
    plans = plan(rows.select("source", "n_tokens", "u"), targets, total)
    taken = rows.withColumn("taken", repeats(plans)).where("taken > 0")
    copies = taken.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "taken")).alias("repeat"), "n_tokens", "text")
    return copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "repeat")).orderBy("shuffle_key", "doc_id", "repeat")


def shares(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = VOCABULARY, seed: int = 0, total: float | None = None) -> DataFrame:
    """What the mixture reaches, one row a source of targets: target_share, actual_share, max_repeats,
    most_taken, documents (different ones), rows, tokens, available_tokens."""
    rows = written(sized(df.where(F.length(text) > 0), key, text, source, tokenizer, seed).select("source", "n_tokens", "u"), "sized")
    plans = plan(rows, targets, total)
    got = (
        rows.withColumn("taken", repeats(plans))
        .groupBy("source")
        .agg(
            F.sum(F.col("n_tokens") * F.col("taken")).alias("tokens"),
            F.sum("taken").alias("rows"),
            F.count_if(F.col("taken") > 0).alias("documents"),
            F.max("taken").alias("most_taken"),
            F.sum("n_tokens").alias("available_tokens"),
        )
    )
    table = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["tokens", "rows", "documents", "most_taken", "available_tokens"])
    whole = table.agg(F.sum("tokens").alias("whole"))  # one row
    return table.join(F.broadcast(whole)).select(
        "source",
        "target_share",
        F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(F.lit(0.0)).alias("actual_share"),
        "max_repeats",
        "most_taken",
        "documents",
        "rows",
        "tokens",
        "available_tokens",
    )
