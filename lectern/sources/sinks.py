"""Sinks: tables replaced as a whole, log lines, letters, caches by content."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes df over those partitions it has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cached(spark: SparkSession, path: str, content_id: str, build: DataFrame) -> DataFrame:
    """Rows kept under a content id, built and written once."""
    where = f"{path}/content_id={content_id}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(where + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build.write.mode("overwrite").parquet(where)
    return spark.read.schema(build.schema).parquet(where)


_FIELD = re.compile(r"\{\{\s*([^{}\n]{1,60}?)\s*\}\}|«\s*([^«»\n]{1,60}?)\s*»|\[\s*([^\[\]\n]{1,60}?)\s*\]")


def fill(template: str, rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Letters: rows with the column letter, the template with fields replaced by columns as mapped, in one pass over
    its parts, so what a value holds is never a field. Fields without a column stay, and a null value is an empty text."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        field = next(g for g in m.groups() if g is not None)
        if field in mapping:
            parts += [F.lit(template[at : m.start()]), F.coalesce(F.col(mapping[field]).cast("string"), F.lit(""))]
            at = m.end()
    return rows.withColumn("letter", F.concat(*parts, F.lit(template[at:])))


def write_letters(letters: DataFrame, key: str, path: str) -> None:
    """Writes letters (column letter) as text, one folder a value of key."""
    letters.select("letter", key).repartition(key).write.partitionBy(key).text(path)


def propose_mapping(fields: list[str], columns: list[str]) -> list[tuple[str, str | None, str]]:
    """For each field its column and how sure: exact (equal letters and digits), proposed (the only column that
    starts with it; never filled in unasked), or unresolved."""
    from lectern.plans.compile import _plain

    bare = {c: re.sub(r"[^a-z0-9]", "", _plain(c)) for c in columns}
    out: list[tuple[str, str | None, str]] = []
    for f in fields:
        key = re.sub(r"[^a-z0-9]", "", _plain(f))
        exact = [c for c, b in bare.items() if b == key]
        begun = [c for c, b in bare.items() if key and b.startswith(key)]
        if len(exact) == 1:
            out.append((f, exact[0], "exact"))
        elif not exact and len(begun) == 1:
            out.append((f, begun[0], "proposed"))
        else:
            out.append((f, None, "unresolved"))
    return out


def first_appearance_groups(rows: DataFrame, key: str | None, index: str) -> DataFrame:
    """Groups of rows by key in the order their first row appears; without a key each row is a group."""
    keyed = rows.withColumn("_k", F.col(key).cast("string") if key else F.col(index).cast("string"))
    return keyed.groupBy("_k").agg(F.min(index).alias("first_row"), F.count("*").alias("n")).withColumnRenamed("_k", "key").orderBy("first_row")


def line_columns(rows: DataFrame, key: str) -> list[str]:
    """Columns whose value varies within some group: those of the lines, not of the letter. A null is a value too."""
    others = [c for c in rows.columns if c != key]
    text = {c: F.col(f"`{c}`").cast("string") for c in others}
    varies = {c: F.coalesce(F.min(v) != F.max(v), F.lit(False)) | ((F.count(v) > 0) & (F.count(v) < F.count("*"))) for c, v in text.items()}
    per = rows.groupBy(key).agg(*[v.alias(c) for c, v in varies.items()])
    seen = per.agg(*[F.max(f"`{c}`").alias(c) for c in others]).first()
    return [c for c in others if seen[c]]
