"""Joins, set operations and keyed window forms the engine's queries are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import checkpointed


def outdated(left: DataFrame, right: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of left that right lacks or holds in an older version: an outer join and a test for null or less."""
    held = right.select(F.col(key), F.col(version).alias("_held"))
    return left.join(held, key, "left").where(F.col("_held").isNull() | (F.col("_held") < F.col(version))).drop("_held")


def in_one_not_other(base: DataFrame, present: DataFrame, absent: DataFrame, key: str) -> DataFrame:
    """Rows with a match in present and none in absent."""
    return base.join(present.select(key), key, "left_semi").join(absent.select(key), key, "left_anti")


def either_side(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """How many edges touch each node on either side: two equi-joins instead of one on OR."""
    ends = edges.select(F.col(a).alias(node)).unionAll(edges.where(F.col(a) != F.col(b)).select(F.col(b).alias(node)))
    return nodes.join(ends.groupBy(node).agg(F.count("*").alias("edges")), node, "left").na.fill(0, ["edges"])


def follow_redirects(redirects: DataFrame, node: str = "id", into: str = "merged_into") -> DataFrame:
    """Where each node ends up (node, root), by doubling along redirects: log2 of the longest chain joins, however
    long it is. A node without a redirect, or one that isn't among the nodes, is an end. Each doubling is written to the
    shared folder, so the plan doesn't grow. Raises ValueError on a cycle: where one is, some node still moves after as
    many doublings as the number of nodes has bits, or ends at a node that is redirected.
    """
    first = hop = checkpointed(redirects.select(F.col(node).alias("node"), F.coalesce(into, node).alias("root")))
    reach, nodes = 1, hop.where("node <> root").count()
    while nodes:
        far = hop.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = checkpointed(hop.join(far, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if after.where("moved").isEmpty():
            if not after.join(first.where("node <> root").select(F.col("node").alias("root")), "root", "left_semi").isEmpty():
                raise ValueError("redirects run in a circle")
            return after.select("node", "root")
        if reach > nodes:
            raise ValueError("redirects run in a circle")
        hop, reach = after.select("node", "root"), reach * 2
    return hop


def best_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by an order. For n = 1 a map-side maximum would do; rank keeps ties' order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def running_budget(df: DataFrame, keys: list[str], newest_first: list[Column], size: str, budget: int) -> DataFrame:
    """Newest rows whose sizes add up within a budget, contiguous: it stops at the first that doesn't fit."""
    w = Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def packed(df: DataFrame, order: Column, size: str, most_items: int, most_size: int) -> DataFrame:
    """Greedy batches in order: a batch closes at most_items or before most_size is passed.

    Packing is sequential, so it runs within each partition of already ordered rows; batches are numbered by
    partition and place. An item larger than a batch has one to itself.
    """
    from collections.abc import Iterator

    import pandas as pd

    schema = df.schema.add("batch", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, batch, items, total = TaskContext.get().partitionId(), 0, 0, 0
        for frame in frames:
            numbers = []
            for s in frame[size]:
                if items and (items >= most_items or total + s > most_size):
                    batch, items, total = batch + 1, 0, 0
                items, total = items + 1, total + s
                numbers.append(f"{part}-{batch}")
            yield frame.assign(batch=numbers)

    return df.sortWithinPartitions(order).mapInPandas(run, schema)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same key: one full outer join."""
    a, b = old.select(*keys, F.struct(*old.columns).alias("_old")), new.select(*keys, F.struct(*old.columns).alias("_new"))
    return a.join(b, keys, "full").select(F.coalesce("_new", "_old").alias("r")).select("r.*")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it lacks; of new rows with equal keys one is kept."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"))


def replace_documents(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of the documents in new replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def retain(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows whose document is still there."""
    return rows.join(present.select(key), key, "left_semi")


def union_with_rank(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, each key once, from the first source that has it."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("_source", F.lit(i)) for i, p in enumerate(parts)])
    return ranked.groupBy(key).agg(F.min("_source").alias("source"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of each column over the whole result, in one pass by grouping sets."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return stacked.select("x.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def facets_leave_one_out(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """For each column with a filter, counts of its values under all the other filters."""
    parts = []
    for name in tests:
        others = [t for other, t in tests.items() if other != name]
        kept = reduce(lambda a, b: a.where(b), others, df)
        parts.append(kept.where(F.col(name).isNotNull()).groupBy(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def overlap_join(left: DataFrame, right: DataFrame, l_from: str, l_to: str, r_from: str, r_to: str, days: int = 31) -> DataFrame:
    """Rows of left and right whose closed spans of dates share a day, as an equi-join of the stretches of so many days each
    span touches; a pair comes once, at the first stretch both touch. Spans with a null end, or that end before they begin,
    meet none. Column names of the two sides must differ."""
    stretch = lambda c: F.floor(F.unix_date(F.col(c)) / days)
    own = lambda df, f, t, n: df.where(F.col(f) <= F.col(t)).withColumn(n, stretch(f)).withColumn("_stretch", F.explode(F.sequence(stretch(f), stretch(t))))
    met = own(left, l_from, l_to, "_l").join(own(right, r_from, r_to, "_r"), "_stretch")
    first = F.col("_stretch") == F.greatest("_l", "_r")
    return met.where(first & (F.col(l_from) <= F.col(r_to)) & (F.col(r_from) <= F.col(l_to))).drop("_stretch", "_l", "_r")
