"""Long spans that stand verbatim in more than one text.

A span of at least ``span`` code points is found through the hashes of its windows. Of every ``width``
consecutive windows of ``gram`` code points, with gram + width - 1 = span, the one of least hash is kept, so
two texts that share a span keep a window of it at the same place (winnowing; Schleimer, Wilkerson, Aiken
2003). The index of kept windows is log-structured: each batch of texts becomes an immutable run, bucketed and
sorted by hash, which is merge-joined with the runs before it without a shuffle; runs of one level are
compacted into one of the next.

Hits are verified. The few windows met in two texts fetch the text around them, and pairs are compared code
point by code point. A window that many texts share (a letterhead, say) isn't paired at all: there every
window of ``span`` code points around it is hashed by 128 bits, and texts pair only where they hold equal windows, whose
text is compared too, so the work follows the pairs there really are. What is shared of a text needs no pairs: it is
covered by its windows that another text holds, at every place they stand.

Exact copies are found first, by a digest of the text; one of each group is indexed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.tokenize import BASE, INVERSE
from lectern.session import checkpointed, shared_dir, written

#: Windows are this long; with SPAN they fix how many are kept.
SPAN, GRAM = 300, 100
#: A window held by more texts than this is split by whole spans instead of paired; both ways find the same.
HOT = 48
#: Members of a class of equal windows that one task pairs with the others.
PAIRED = 1000
STEP = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (BASE, INVERSE):
        steps = np.full(n + 1, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of every width consecutive ones, by running minima from both ends of blocks."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def kept_windows(texts: list[str], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place and hash of the windows kept of texts; texts shorter than span keep none."""
    width = span - gram + 1
    numbers, places, hashes = [], [], []
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + lengths[stop] <= STEP):
            size += lengths[stop]
            stop += 1
        own = lengths[at:stop]
        codes = np.frombuffer("".join(texts[at:stop]).encode("utf-32-le", "surrogatepass"), np.uint32)
        opens = np.cumsum(own) - own
        n = len(codes)
        if n >= span:
            up, down = _powers(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(977)) * up[:n], out=sums[1:])
            h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            bits = np.uint64(n.bit_length())
            # the place breaks ties: the last of equal hashes is kept, in any text alike
            ranked = (h >> bits << bits) | (np.uint64(n) - np.arange(len(h), dtype=np.uint64))
            least = _sliding_min(ranked, width)
            text_of = np.repeat(np.arange(stop - at), own)
            inside = text_of[: len(least)] == text_of[span - 1 :]
            least = least[inside]
            least = least[np.concatenate(([True], least[1:] != least[:-1]))] if len(least) else least
            place = (np.uint64(n) - (least & ((np.uint64(1) << bits) - np.uint64(1)))).astype(np.int64)
            number = text_of[place]
            numbers.append(number + at)
            places.append(place - opens[number])
            hashes.append(h[place].view(np.int64))
        at = stop
    cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return cat(numbers), cat(places), cat(hashes)


def fingerprints(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """Rows (h, doc_id, place) of the kept windows of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, place, h = kept_windows(batch.column(1).to_pylist(), span, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), batch.column(0).take(pa.array(number)), pa.array(place, pa.int32())], ["h", "doc_id", "place"]
            )

    return texts.select("doc_id", "text").mapInArrow(run, "h bigint, doc_id bigint, place int")


class SpanIndex:
    """Runs of kept windows in the session's shared folder. append() adds a batch and returns the windows it
    has in common with other texts of the batch or of the runs before it."""

    def __init__(self, spark: SparkSession, span: int = SPAN, gram: int = GRAM, buckets: int | None = None, fan_out: int = 2):
        self.spark, self.span, self.gram, self.fan_out = spark, span, gram, fan_out
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"lectern_spans_{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/{self.name}"
        self.runs: list[tuple[int, str]] = []  # level, table
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        (
            rows.repartition(self.buckets, "h")
            .write.bucketBy(self.buckets, "h")
            .sortBy("h")
            .option("path", f"{self.root}/{name}")
            .option("compression", "zstd")
            .format("parquet")
            .saveAsTable(name)
        )
        self.runs.append((level, name))
        return name

    def append(self, texts: DataFrame) -> DataFrame:
        """Adds texts (doc_id, text), all new. Rows (h, doc_id, place), of either side, met in two texts."""
        before = [self.spark.table(name) for _, name in self.runs]
        new = self.spark.table(self._write(fingerprints(texts, self.span, self.gram), 0))
        within = new.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
        met = [within, *(new.join(run, "h", "left_semi").select("h") for run in before)]
        keys = reduce(DataFrame.unionAll, met).distinct()
        return reduce(DataFrame.unionAll, [run.join(keys, "h", "left_semi") for run in [new, *before]])

    def compact(self) -> None:
        """Merges the runs of a level, once there are fan_out of them, into one of the next level."""
        level = 0
        while self.runs and level <= max(x for x, _ in self.runs):
            own = [name for x, name in self.runs if x == level]
            if len(own) >= self.fan_out:
                self.runs = [(x, name) for x, name in self.runs if x != level]
                self._write(reduce(DataFrame.unionAll, map(self.spark.table, own)), level + 1)
                for name in own:
                    self.spark.sql(f"DROP TABLE {name}")
            level += 1


    def drop(self) -> None:
        """Removes the runs' tables and files."""
        for number in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{number}")
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi - 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


SHARED = "a bigint, b bigint, a_from int, a_to int, b_from int, b_to int"


def _pairs_of_group(rows: list[tuple], span: int, gram: int) -> Iterator[tuple]:
    """Verified pairs of one window's rows (doc_id, place, context, place in the context)."""
    parts = [(doc, place, ctx[at + gram :], ctx[:at][::-1]) for doc, place, ctx, at in sorted(rows)]
    for j, (b, q, right_b, left_b) in enumerate(parts):
        for a, p, right_a, left_a in parts[:j]:
            if a == b:
                continue
            right, left = _common(right_a, right_b), _common(left_a, left_b)
            if left + gram + right >= span:
                yield a, b, p - left, p + gram + right, q - left, q + gram + right


def contexts(texts: DataFrame, hits: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The text around windows held by several texts: h, doc_id, place, hot, ctx, at (the window's place in ctx).
    texts: (doc_id, text), doc_id unique; hits: (h, doc_id, place)."""
    width = span - gram
    hits = hits.distinct()
    sizes = hits.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    marked = hits.join(sizes, "h").select("doc_id", F.struct("h", "place", (F.col("n") > HOT).alias("hot")).alias("w"))
    # a text has at most as many kept windows as code points, so the list is bounded by the text it joins
    wanted = marked.groupBy("doc_id").agg(F.collect_list("w").alias("ws"))
    around = (
        wanted.join(texts, "doc_id")
        .select("doc_id", "text", F.explode("ws").alias("w"))
        .select(
            F.col("w.h").alias("h"),
            "doc_id",
            F.col("w.place").alias("place"),
            F.col("w.hot").alias("hot"),
            F.expr(f"substring(text, greatest(w.place - {width}, 0) + 1, least(w.place, {width}) + {gram + width})").alias("ctx"),
            F.expr(f"least(w.place, {width})").alias("at"),
        )
    )
    return written(around, "contexts")


def paired_spans(around: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Verified spans in common at windows few texts share, as rows (a, b, a_from, a_to, b_from, b_to) with a < b, of at
    least span code points each, cut off span - gram to either side of a window."""
    plain = around.where("not hot").select("h", "doc_id", "place", "ctx", "at").repartition("h").sortWithinPartitions("h")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        names = ["a", "b", "a_from", "a_to", "b_from", "b_to"]
        for frame in frames:
            out: list[tuple] = []
            for h, *row in frame.itertuples(index=False, name=None):
                if h != key:
                    out.extend(_pairs_of_group(held, span, gram))
                    held, key = [], h
                held.append(tuple(row))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(_pairs_of_group(held, span, gram)), columns=names)

    return plain.mapInPandas(compare, SHARED)


def hot_windows(around: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Whole spans around windows many texts share: h, window (their hash), doc_id, at, shift; one row a text, as in a
    periodic one the same spans return at every place."""
    width = span - gram

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seen = None, set()
        for frame in frames:
            out = []
            for h, doc, place, ctx, at in frame.itertuples(index=False, name=None):
                if doc != current:
                    current, seen = doc, set()
                for s in range(max(0, at - width), min(at, len(ctx) - span) + 1):
                    digest = xxhash.xxh3_128_digest(ctx[s : s + span].encode("utf-32-le", "surrogatepass"))
                    if (h, digest) not in seen:
                        seen.add((h, digest))
                        out.append((h, doc, place - at + s, s - at, digest))
            yield pd.DataFrame(out, columns=["h", "doc_id", "at", "shift", "window"])

    hot = around.where("hot").select("h", "doc_id", "place", "ctx", "at")
    each = hot.mapInPandas(windows, "h bigint, doc_id bigint, at int, shift int, window binary")
    return checkpointed(each.groupBy("h", "window", "doc_id").agg(F.min("at").alias("at"), F.min("shift").alias("shift")))


def hot_pairs(around: DataFrame, each: DataFrame, span: int = SPAN) -> DataFrame:
    """Pairs (a, b) of texts that hold an equal whole span, verified, at windows many texts share."""
    classes = each.groupBy("h", "window").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.bit_xor(F.xxhash64("doc_id")).alias("who"), F.min("shift").alias("first")
    )
    # neighbouring windows held by the same texts say the same pairs: one first and one last are enough
    classes = classes.where("lo < hi").groupBy("h", "n", "lo", "hi", "who").agg(F.min_by("window", "first").alias("one"), F.max_by("window", "first").alias("other"))
    chosen = classes.select(F.explode(F.array("one", "other")).alias("window"), "h", "n").distinct()
    members = each.join(chosen, ["h", "window"]).select("h", "window", "doc_id", "at", "n")
    # equal hashes only bring texts together; it is their text that joins them
    own = around.where("hot").select("h", "doc_id", "place", "ctx", F.col("at").alias("inside"))
    with_text = members.join(own, ["h", "doc_id"]).where((F.col("at") >= F.col("place") - F.col("inside")) & (F.col("at") + span <= F.col("place") - F.col("inside") + F.length("ctx")))
    with_text = with_text.groupBy("h", "window", "doc_id", "n").agg(F.min(F.expr(f"substring(ctx, at - place + inside + 1, {span})")).alias("text"))
    # a large class is paired in parts: each member of one side with all of the other
    parts = F.ceil(F.col("n") / PAIRED).cast("int")
    with_text = checkpointed(with_text.withColumn("parts", parts))
    left = with_text.select("h", "window", "text", F.col("doc_id").alias("a"), F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"))
    right = with_text.select("h", "window", "text", F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["h", "window", "text", "part"]).where("a < b").select("a", "b")


def hot_cover(around: DataFrame, each: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Stretches (doc_id, f, t) of texts covered by whole spans another text holds too, at every place, where many texts
    share a window."""
    width = span - gram
    held = each.groupBy("h", "window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "window")
    # as many spans as a text has at most
    own = each.join(held, ["h", "window"], "left_semi").groupBy("h", "doc_id").agg(F.collect_list("window").alias("windows"))
    rows = around.where("hot").join(own, ["h", "doc_id"]).select("h", "doc_id", "place", "ctx", "at", "windows")

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, wanted = None, frozenset()
        for frame in frames:
            out: list[list] = []
            for h, doc, place, ctx, at, windows in frame.itertuples(index=False, name=None):
                if (h, doc) != last:
                    last, wanted = (h, doc), frozenset(map(bytes, windows))
                for s in range(max(0, at - width), min(at, len(ctx) - span) + 1):
                    if xxhash.xxh3_128_digest(ctx[s : s + span].encode("utf-32-le", "surrogatepass")) in wanted:
                        f = place - at + s
                        if out and out[-1][0] == doc and out[-1][1] <= f <= out[-1][2]:
                            out[-1][2] = max(out[-1][2], f + span)
                        else:
                            out.append([doc, f, f + span])
            yield pd.DataFrame(out, columns=["doc_id", "f", "t"])

    return rows.mapInPandas(cover, "doc_id bigint, f int, t int")


def corpus(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, rep) of groups of exact copies among texts of at least span code points, and all such
    texts (doc_id, text). Null and short texts belong to no group."""
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= span)
    digests = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    reps = digests.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return digests.join(reps, "digest").select("doc_id", "rep"), rows


def find(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = 3) -> tuple[DataFrame, DataFrame]:
    """Copies (doc_id, rep) and the contexts of windows in common between representatives and texts without copies.

    key must be a unique integer; batches follow it, as keys follow arrival, and after every second one the index is
    compacted. Empty tables give empty results. The windows of copies are indexed too, which needs no shuffle of texts;
    they are dropped from the hits. The index is removed once its hits are written.
    """
    copies, texts = corpus(df, key, text, span)
    index = SpanIndex(df.sparkSession, span, gram)
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    lo, hi = lo or 0, hi or 0
    step = (hi - lo) // batches + 1
    hits = []
    for k in range(batches):
        low, high = lo + k * step, lo + (k + 1) * step
        # a run's tables change when it is compacted, so what it has in common with a batch is written first
        hits.append(checkpointed(index.append(texts.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)))))
        index.compact()
    copies = checkpointed(copies)
    own = reduce(DataFrame.unionAll, hits).join(copies.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    around = contexts(texts, own.select("h", "doc_id", "place"), span, gram)
    index.drop()
    return copies, around


def pairs(df: DataFrame, span: int = SPAN, gram: int = GRAM, **how: object) -> DataFrame:
    """All pairs (doc_id_a, doc_id_b), the smaller first, of rows whose texts share a span; copies are spelt out."""
    copies, around = find(df, span=span, gram=gram, **how)
    linked = paired_spans(around, span, gram).select("a", "b").unionAll(hot_pairs(around, hot_windows(around, span, gram), span)).distinct()
    of = copies.select(F.col("rep"), F.col("doc_id").alias("member"))
    both = (
        linked.join(of.toDF("a", "x"), "a", "left")
        .join(of.toDF("b", "y"), "b", "left")
        .select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    )
    # copies of one text pair in parts, each member of one side with all of the other
    sizes = of.groupBy("rep").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("parts"))
    sized = of.join(sizes, "rep")
    left = sized.select("rep", F.col("member").alias("x"), F.pmod(F.xxhash64("member"), "parts").cast("int").alias("part"))
    right = sized.select("rep", F.col("member").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    same = left.join(right, ["rep", "part"]).where("x < y").select("x", "y")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).unionByName(same.toDF("doc_id_a", "doc_id_b"))


def shares(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, **how: object) -> DataFrame:
    """Per row with a text: its length, the code points that stand in another text too within a shared span,
    and their share of the text (0 for an empty text). Rows whose text is null have null in all three."""
    copies, around = find(df, key, text, span, gram, **how)
    spans = paired_spans(around, span, gram)
    cold = spans.selectExpr("a doc_id", "a_from f", "a_to t").unionAll(spans.selectExpr("b", "b_from", "b_to"))
    sides = cold.unionAll(hot_cover(around, hot_windows(around, span, gram), span, gram)).groupBy("doc_id", "f").agg(F.max("t").alias("t"))
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        sides.withColumn("reached", F.coalesce(F.max("t").over(before), F.lit(0)))
        .groupBy("doc_id")
        .agg(F.sum(F.greatest(F.lit(0), F.col("t") - F.greatest("f", "reached"))).alias("shared"))
    )
    whole = copies.select("doc_id", F.lit(True).alias("copied"))
    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.length(text).alias("length"))
    return (
        rows.join(covered, "doc_id", "left")
        .join(whole, "doc_id", "left")
        .select("doc_id", "length", F.when(F.col("copied"), F.col("length")).when(F.col("length").isNotNull(), F.coalesce("shared", F.lit(0))).cast("bigint").alias("shared"))
        .withColumn("share", F.when(F.col("length") > 0, F.col("shared") / F.col("length")).when(F.col("length") == 0, F.lit(0.0)))
    )
