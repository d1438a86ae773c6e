"""Full-text and vector search: postings, BM25, cosine, and the hybrid of both under a budget.

Rankings keep ids and scores only; text is fetched for the few rows kept. Query terms and vectors are literals,
so a search is one scan of the postings or vectors it needs and a top-k per partition before any exchange.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import fold, words_of
from lectern.session import checkpointed, spread

K1, B = 1.2, 0.75
#: A lexical hit adds this to the cosine; without a hit a cosine below LEAST drops out.
BONUS, LEAST = 0.2, 0.15
#: Passages and characters an answer gets.
MOST_PASSAGES, MOST_CHARS = 6, 6000
#: Rare terms read their documents; a broadcast of the terms asked for is at most this many rows.
MOST_TERMS = 60


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index: term, key, tf, len (words of the text). Null texts have none."""
    words = df.select(F.col(key), words_of(F.col(text)).alias("words")).where("words is not null")
    return (
        words.select(key, F.size("words").alias("len"), F.explode("words").alias("term"))
        .groupBy("term", key)
        .agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"))
    )


def statistics(df: DataFrame, text: str) -> DataFrame:
    """One row: documents with words, and their mean length."""
    n = F.size(words_of(F.col(text)))
    return df.where(F.col(text).isNotNull() & (n > 0)).agg(F.count("*").alias("documents"), F.avg(n).alias("mean_len"))


def bm25(df: DataFrame, key: str, text: str, terms: list[str], scope: DataFrame | None = None) -> DataFrame:
    """Scores (key, score), greater is better, of texts with any of the terms. Statistics are the whole corpus's;
    scope only keeps some rows. Texts are tokenised once: lengths and counts of the asked terms, a few numbers a text, are
    written to the shared folder, and statistics and scores are made from them."""
    if not all(t.isalnum() for t in terms):
        raise ValueError("terms are folded words")
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    folded = spread(df.where(F.col(text).isNotNull()).select(key, text)).select(F.col(key), F.explode(F.array(fold(F.col(text)))).alias("f"))
    # a plain substring test spares most texts the pattern
    count = lambda t: F.when(F.col("f").contains(t), F.regexp_count("f", F.lit(rf"(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])"))).otherwise(0)
    counts = [count(t).alias(f"t{i}") for i, t in enumerate(terms)]
    # generators of one row keep the folded text, and the counts, from being computed anew wherever they are used
    rows = folded.select(key, F.inline(F.array(F.struct(F.regexp_count("f", F.lit(r"[\p{L}\p{N}]+")).alias("len"), *counts)))).where("len > 0")
    rows = checkpointed(rows)
    whole = rows.agg(F.count("*").alias("N"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, d = F.col(f"t{i}"), F.col(f"d{i}")
        idf = F.log((F.col("N") - d + 0.5) / (d + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))).otherwise(0.0)
    hit = F.greatest(*[F.col(f"t{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("t0")
    kept = rows.where(hit > 0)
    if scope is not None:
        kept = kept.join(scope.select(key), key, "left_semi")
    return kept.join(F.broadcast(whole)).select(key, score.alias("score"))


#: Buckets of a stored index; a search reads those of its terms.
BUCKETS = 64


class PostingsIndex:
    """An inverted index in the shared folder: postings (term, key, tf, len) in buckets by term, sorted within, and one row of
    statistics. A search reads the buckets of its terms, and of them the parts its terms lie in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def build(df: DataFrame, key: str, text: str, path: str) -> PostingsIndex:
        """Writes the index of texts; null texts have no postings."""
        rows = postings(spread(df.select(key, text)), key, text).withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int"))
        # a frequent term's postings go to several tasks, by key
        rows.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        lengths = df.sparkSession.read.parquet(f"{path}/postings").groupBy(key).agg(F.first("len").alias("len"))
        lengths.agg(F.count("*").alias("N"), F.avg("len").alias("mean")).write.parquet(f"{path}/statistics")
        return PostingsIndex(df.sparkSession, path)

    def bm25(self, key: str, terms: list[str], scope: DataFrame | None = None) -> DataFrame:
        """Scores (key, score) of texts with any of the terms, as bm25 gives them; scope only keeps some rows."""
        if len(terms) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms")
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        whole = self.spark.read.parquet(f"{self.path}/statistics")  # one row
        found = hits.groupBy("term").agg(F.count("*").alias("d"))  # at most MOST_TERMS rows
        kept = hits if scope is None else hits.join(scope.select(key), key, "left_semi")
        idf = F.log((F.col("N") - F.col("d") + 0.5) / (F.col("d") + 0.5))
        score = F.when(idf <= 0, 1e-6).otherwise(idf) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        return kept.join(F.broadcast(found), "term").join(F.broadcast(whole)).groupBy(key).agg(F.sum(score).alias("score"))


def phrase(text: Column, words: str) -> Column:
    """Whether a text holds words in this order, folded, at word borders."""
    folded = F.concat(F.lit(" "), F.concat_ws(" ", words_of(text)), F.lit(" "))
    return folded.contains(F.concat(F.lit(" "), F.concat_ws(" ", words_of(F.lit(words))), F.lit(" ")))


def all_words(text: Column, terms: list[str], last_is_prefix: bool = False) -> Column:
    """Whether a text has every term; the last may be only begun."""
    words = words_of(text)
    exact = terms[:-1] if last_is_prefix else terms
    test = F.lit(True)
    for t in exact:
        test = test & F.array_contains(words, t)
    return test & F.exists(words, lambda w: F.startswith(w, F.lit(terms[-1]))) if last_is_prefix else test


def cosine(df: DataFrame, key: str, vector: str, query: list[float] | DataFrame) -> DataFrame:
    """Cosine of every vector with one query (numbers, or a table whose first row's first column has them); 0 for an
    empty or null vector, one of another length, or one without length. Only key and vector leave the scan, and all is
    computed in the JVM."""
    one = df.sparkSession.createDataFrame([(list(map(float, query)),)], "q array<double>") if isinstance(query, list) else query.select(F.col(query.columns[0]).cast("array<double>").alias("q")).limit(1)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    one = one.select("q", F.sqrt(dot(F.col("q"), F.col("q"))).alias("nq"))
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).join(F.broadcast(one))  # one row
    # a generator of one row keeps the products from being computed anew wherever they are used
    parts = rows.select(key, "nq", F.inline(F.array(F.struct(F.when(F.size("v") == F.size("q"), dot(F.col("v"), F.col("q"))).alias("vq"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("nv")))))
    return parts.select(key, F.when((F.col("nv") > 0) & (F.col("nq") > 0) & F.col("vq").isNotNull(), F.col("vq") / (F.col("nv") * F.col("nq"))).otherwise(0.0).alias("cosine"))


def nearest(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
    """The k nearest vectors of every query (key, vector) among all of df: (query, key, cosine, rank), ties to the lesser key.

    Vectors of one length, packed in blocks, meet the queries' blocks, and each meeting gives only its k best a query. That
    is every query against every row, for a stated set of queries; what is shuffled are blocks and k rows a meeting.
    """

    def packed(rows: DataFrame, name: str) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), block):
                    part = frame.iloc[at : at + block]
                    yield pd.DataFrame({f"{name}_ids": [part[key].tolist()], f"{name}_v": [np.stack(part[vector].to_numpy()).astype(np.float64).tobytes()]})

        kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("bigint"), vector)
        return kept.mapInPandas(run, f"{name}_ids array<bigint>, {name}_v binary")

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q_ids, q_v, d_ids, d_v in frame.itertuples(index=False, name=None):
                q = np.frombuffer(q_v).reshape(len(q_ids), -1)
                d = np.frombuffer(d_v).reshape(len(d_ids), -1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    c = np.nan_to_num((q @ d.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None, :]))
                ids = np.asarray(d_ids)
                for i, own in enumerate(q_ids):
                    top = np.lexsort((ids, -np.round(c[i], 9)))[:k]
                    yield pd.DataFrame({"query": own, key: ids[top], "cosine": c[i][top]})

    met = packed(queries, "q").crossJoin(packed(df, "d"))
    found = met.mapInPandas(best, f"query bigint, `{key}` bigint, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def decoded(stored: Column) -> Column:
    """Vectors stored as little-endian single-precision bytes; null for null, and for bytes that aren't whole numbers of them."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())

    return run(stored)


def hybrid(cosines: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Cosine plus a flat bonus for a lexical hit; rows that are near in neither way drop out."""
    marked = cosines.join(hits.select(key, F.lit(True).alias("hit")).distinct(), key, "left")
    hit = F.coalesce("hit", F.lit(False))
    return marked.where(hit | (F.col("cosine") >= LEAST)).select(key, (F.col("cosine") + F.when(hit, BONUS).otherwise(0.0)).alias("score"), hit.alias("hit"))


def within_budget(ranked: DataFrame, query: str, key: str, size: str, most: int = MOST_PASSAGES, chars: int = MOST_CHARS) -> DataFrame:
    """Per query, passages (query, key, score, size) best first while they fit: one that doesn't is passed over,
    later ones may fit. Rows (query, key, place), place from 1.

    The greedy choice is the next passage in order that still fits, taken most times. Each turn is one minimum
    per query, combined before its shuffle, so no query's candidates are gathered.
    """
    rows = checkpointed(ranked.select(F.col(query).alias("q"), F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.col(size).alias("n")).alias("x")))
    state = rows.groupBy("q").agg(F.lit(None).cast(rows.schema["x"].dataType).alias("last"), F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(ranked.dtypes)[key]}>").alias("kept"))
    for _ in range(most):
        open_ = rows.join(state, "q").where((F.col("last").isNull() | (F.col("x") > F.col("last"))) & (F.col("used") + F.col("x.n") <= chars))
        state = state.join(open_.groupBy("q").agg(F.min("x").alias("x")), "q", "left").select(
            "q",
            F.coalesce("x", "last").alias("last"),
            F.when(F.col("x").isNotNull(), F.col("used") + F.col("x.n")).otherwise(F.col("used")).alias("used"),
            F.when(F.col("x").isNotNull(), F.array_append("kept", F.col("x.k"))).otherwise(F.col("kept")).alias("kept"),
        )
    return state.select(F.col("q").alias(query), F.posexplode("kept").alias("p", key)).select(query, key, (F.col("p") + 1).alias("place"))


def best_passage_per_document(scores: DataFrame, passages: DataFrame, document: str, key: str, place: list[str]) -> DataFrame:
    """Each document's best passage, or its first one with score 0 where none matched."""
    found = scores.join(passages.select(key, document), key).groupBy(document).agg(F.min_by(F.struct(key, "score"), F.struct(-F.col("score"), F.col(key))).alias("x"))
    first = passages.groupBy(document).agg(F.min_by(key, F.struct(*place)).alias("first"))
    return first.join(found, document, "left").select(document, F.coalesce("x." + key, "first").alias(key), F.coalesce("x.score", F.lit(0.0)).alias("score"))


def recall_mrr_ndcg(results: DataFrame, relevant: DataFrame, question: str, document: str, rank: str, k: int = 10) -> DataFrame:
    """Per question: recall at k, reciprocal rank and nDCG at k; a question without results scores 0."""
    first = results.groupBy(question, document).agg(F.min(rank).alias("r"))
    joined = relevant.select(question, document).distinct().join(first, [question, document], "left")
    gain = F.when(F.col("r") <= k, 1 / F.log2(F.col("r") + 1.0)).otherwise(0.0)
    ideal = [sum(1 / math.log2(i + 2) for i in range(n)) for n in range(k + 1)]
    scored = joined.groupBy(question).agg(F.count("*").alias("n"), F.count_if(F.col("r") <= k).alias("found"), F.min("r").alias("best"), F.sum(gain).alias("dcg"))
    return scored.select(
        question,
        (F.col("found") / F.col("n")).alias("recall"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"),
        (F.col("dcg") / F.element_at(F.array(*map(F.lit, ideal)), F.least(F.col("n"), F.lit(k)).cast("int") + 1)).alias("ndcg"),
    )
