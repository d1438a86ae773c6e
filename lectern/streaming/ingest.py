"""Incremental ingestion: what is due, vectors reused, deletions carried on; as batch steps and as a stream.

The stream over a folder keeps its own record of files seen; each micro-batch replaces the documents it brings,
so running a batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lectern.session import checkpointed


def due(listing: DataFrame, index: DataFrame, keys: tuple[str, ...] = ("path", "sha256", "version")) -> DataFrame:
    """Files not indexed under the same content and versions."""
    return listing.join(index.select(*keys).distinct(), list(keys), "left_anti")


def pending_vectors(passages: DataFrame) -> DataFrame:
    """Passages whose text is searchable and whose vector is still to come."""
    return passages.where(F.col("embedding").isNull())


def reuse_vectors(new: DataFrame, old: DataFrame) -> DataFrame:
    """New passages with the vectors of old ones of the same id and text; of several old ones alike the first by its vector."""
    known = old.where(F.col("embedding").isNotNull()).groupBy("chunk_id", F.col("text").alias("_t")).agg(F.min("embedding").alias("_e"))
    return new.join(known.withColumnRenamed("chunk_id", "_c"), (F.col("chunk_id") == F.col("_c")) & (F.col("text") == F.col("_t")), "left").withColumn("embedding", F.coalesce("embedding", "_e")).drop("_c", "_t", "_e")


def reset_vectors(passages: DataFrame, model: str) -> DataFrame:
    """Passages whose vector another model made lose it; they are due again."""
    return passages.withColumn("embedding", F.when(F.col("model").eqNullSafe(F.lit(model)), F.col("embedding"))).withColumn("model", F.when(F.col("embedding").isNotNull(), F.col("model")))


def to_recognise(pages: DataFrame, cache: DataFrame, engine_version: str) -> DataFrame:
    """Pages (relative_path, sha256, page_number) still to be recognised: not cached under the same content and a version
    at least as new, versions compared part by part."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda p: p.try_cast("int"))
    have = cache.where(parts(F.col("engine_version")) >= parts(F.lit(engine_version))).select("relative_path", "sha256", "page_number")
    return pages.join(have, ["relative_path", "sha256", "page_number"], "left_anti")


def retried(results: DataFrame, retry: DataFrame, key: str) -> DataFrame:
    """Results of a batch (key, error, ...) with those that failed replaced by what a retry of each alone gave."""
    return results.where("error is null").unionByName(retry.join(results.where("error is not null").select(key), key, "left_semi"))


def progress(samples: DataFrame, job: str, at: str, done: str, span: int = 15) -> DataFrame:
    """Rows a second over the last so many seconds at each sample of a job: (job, at, rate), null at a job's start."""
    from pyspark.sql import Window

    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    w = Window.partitionBy(job).orderBy(seconds).rangeBetween(-span, 0)
    first_at, first_done = F.min(seconds).over(w), F.min(done).over(w)
    return samples.select(job, at, F.when(seconds > first_at, (F.max(done).over(w) - first_done) / (seconds - first_at)).alias("rate"))


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows: a ring buffer's content."""
    return df.orderBy(F.desc(order)).limit(n)


def diagnostics(df: DataFrame, order: str, value: str, reason: str, n: int) -> DataFrame:
    """One row over the last n: rows, mean, the upper median, and how many have a reason."""
    recent = last_n(df, order, n)
    ranked = recent.agg(F.array_sort(F.collect_list(value)).alias("v"), F.count("*").alias("n"), F.count_if(F.col(reason).isNotNull()).alias("with_reason"), F.avg(value).alias("mean"))
    return ranked.select("n", "with_reason", F.round("mean", 4).alias("mean"), F.element_at("v", (F.size("v") / 2).cast("int") + 1).alias("upper_median"))


_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_KEPT = "path string, text string, changed timestamp, part int"


def _merge(new: DataFrame, target: str, buckets: int) -> None:
    """Puts texts (path, text, changed) in place of older ones of the same path, writing anew only the partitions they
    fall in; doing it again changes nothing."""
    session = new.sparkSession
    keyed = new.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    latest = lambda df: df.groupBy("path", "part").agg(F.max_by("text", "changed").alias("text"), F.max("changed").alias("changed")).select("path", "text", "changed", "part")
    new = checkpointed(latest(keyed))
    parts = new.select("part").distinct()  # at most buckets rows
    old = session.read.schema(_KEPT).parquet(target).join(F.broadcast(parts), "part", "left_semi") if _exists(session, target) else session.createDataFrame([], _KEPT)
    merged = checkpointed(latest(old.select("path", "text", "changed", "part").unionByName(new)))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)


def stream_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, extension: str = "txt", buckets: int = 16) -> StreamingQuery:
    """Text files that appear in a folder, kept as a table (path, text, changed) under target, partitioned by a hash of the
    path; available files are taken and the stream ends. The stream knows files by their path: one changed under its name,
    or gone, is for refresh_folder."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").load(folder)
    rows = source.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("changed"))
    return rows.writeStream.foreachBatch(lambda batch, _: _merge(batch, target, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_folder(spark: SparkSession, folder: str, target: str, extension: str = "txt", buckets: int = 16) -> None:
    """Brings a table of stream_folder up to date with files changed under their name and files that are gone.

    The listing's paths and times are compared with the table's without reading any content; only files that differ are
    read. Partitions with gone files are written anew without them.
    """
    files = spark.read.format("binaryFile").schema(_FILES).option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").load(folder)
    kept = spark.read.schema(_KEPT).parquet(target)
    changed = checkpointed(files.select("path", F.col("modificationTime").alias("changed")).join(kept.select("path", "changed"), ["path", "changed"], "left_anti").select("path"))
    _merge(files.join(changed, "path", "left_semi").select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("changed")), target, buckets)
    kept = spark.read.schema(_KEPT).parquet(target)
    gone = checkpointed(kept.select("path", "part").join(files.select("path"), "path", "left_anti"))
    rest = checkpointed(kept.join(F.broadcast(gone.select("part").distinct()), "part", "left_semi").join(gone.select("path"), "path", "left_anti"))  # at most buckets rows
    emptied = gone.select("part").distinct().join(rest.select("part"), "part", "left_anti")
    # a partition that loses its last file keeps one row without a text, as an overwrite touches only partitions it has rows of
    blank = emptied.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("timestamp").alias("changed"), "part")
    rest.select("path", "text", "changed", "part").unionByName(blank).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target)


def folder_texts(spark: SparkSession, target: str) -> DataFrame:
    """The texts a folder's table holds: (path, text, changed)."""
    return spark.read.schema(_KEPT).parquet(target).where("path is not null").select("path", "text", "changed")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def windowed_counts(events: DataFrame, ts: str, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; on a stream, later ones than the watermark are left out. An extension:
    the question set has no event-time operators."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
