"""The entity base: resolution, merges with redirects, promotion, relations, integrity, reduction of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.phonetic import phonetic_key
from lectern.functions.text import bounded_damerau, fold, words_of
from lectern.operators.relational import follow_redirects

#: An entity drives a reduction if it is this sure and in at most this share of the files; a reduction must leave
#: at least so many files out and may keep few.
SURE, SELECTIVE, MIN_FILES, MIN_REDUCTION, MOST_DOCUMENTS = 0.80, 0.60, 8, 0.3, 15
#: Sources an entity needs to become active.
SOURCES = 2
# Forms of address that are no part of a name.
TITLES = ["m", "mme", "mlle", "monsieur", "madame", "dr", "dre", "docteur", "prof", "me", "herr", "frau", "mr", "mrs", "ms"]


def name_key(name: Column) -> Column:
    """The canonical key of a name: folded words without forms of address, in order."""
    return F.concat_ws(" ", F.filter(words_of(name), lambda w: ~w.isin(TITLES)))


def token_set_key(name: Column) -> Column:
    """The same words in any order have the same key."""
    return F.concat_ws(" ", F.array_sort(F.filter(words_of(name), lambda w: ~w.isin(TITLES))))


def entities(links: DataFrame) -> DataFrame:
    """Distinct names of links as entities: key, name (the commonest writing), type, mentions, files, confidence."""
    rows = links.where("surface is not null").withColumn("key", name_key(F.col("surface"))).where("key <> ''")
    writings = rows.groupBy("key", "surface").agg(F.count("*").alias("n"))
    names = writings.groupBy("key").agg(F.min_by("surface", F.struct(-F.col("n"), F.col("surface"))).alias("name"))
    facts = rows.groupBy("key").agg(F.count("*").alias("mentions"), F.countDistinct("domain", "relative_path").alias("files"), F.max("confidence").alias("confidence"), F.max("type_id").alias("type_id"))
    return names.join(facts, "key")


def promoted(found: DataFrame) -> DataFrame:
    """Entities with their status: active with enough different sources, else candidate."""
    return found.withColumn("status", F.when(F.col("files") >= SOURCES, "active").otherwise("candidate"))


def resolve(queries: DataFrame, base: DataFrame) -> DataFrame:
    """Outcome of each name of queries (name) against base (id, name): exact, token_set, fuzzy or none, ambiguous
    where the best signal has several. Fuzzy is the same phonetic key of all words and one edit in all; it never
    merges, it only proposes. Every signal is an equi-join; edits are checked within equal keys.
    """
    q = queries.select("name").distinct()
    words = lambda c: F.concat_ws(" ", F.filter(words_of(c), lambda w: ~w.isin(TITLES)))
    sound = phonetic_key(F.replace(token_set_key(F.col("name")), F.lit(" "), F.lit("")))
    qs = q.select("name", words(F.col("name")).alias("k0"), token_set_key(F.col("name")).alias("k1"), sound.alias("k2"))
    bs = base.select("id", words(F.col("name")).alias("k0"), token_set_key(F.col("name")).alias("k1"), sound.alias("k2"))
    exact = qs.join(bs.select("id", "k0"), "k0").select("name", "id", F.lit(0).alias("signal"))
    sets = qs.join(bs.select("id", "k1"), "k1").select("name", "id", F.lit(1).alias("signal"))
    near = qs.join(bs.select("id", "k2", F.col("k1").alias("other")), "k2").where(bounded_damerau(F.col("k1"), F.col("other"), 1).isNotNull()).select("name", "id", F.lit(2).alias("signal"))
    hits = exact.unionAll(sets).unionAll(near)
    best = hits.groupBy("name").agg(F.min("signal").alias("signal"))
    counted = hits.join(best, ["name", "signal"]).groupBy("name", "signal").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    signal = F.when(F.col("signal") == 0, "exact").when(F.col("signal") == 1, "token_set").when(F.col("signal") == 2, "fuzzy")
    return q.join(counted, "name", "left").select("name", F.when(F.col("n") == 1, F.col("id")).alias("id"), F.coalesce(signal, F.lit("none")).alias("signal"), F.when(F.col("n") > 1, "ambiguous").when((F.col("n") == 1) & (F.col("signal") == 2), "possible").when(F.col("n") == 1, "resolved").otherwise("unknown").alias("outcome"))


def effective(mentions: DataFrame, redirects: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Mentions with the entity their own was merged into, however often."""
    return mentions.join(follow_redirects(redirects).select(F.col("node").alias(entity), "root"), entity, "left").withColumn(entity, F.coalesce("root", entity)).drop("root")


def replay(log: DataFrame) -> DataFrame:
    """Merges in force after a log (seq, kind, id, into) of merge, unmerge and undo: the last word on each id counts."""
    last = log.where(F.col("kind").isin("merge", "unmerge")).groupBy("id").agg(F.max_by(F.struct("kind", "into"), "seq").alias("x"))
    return last.select("id", F.when(F.col("x.kind") == "merge", F.col("x.into")).alias("merged_into"))


def orphans(base: DataFrame, *uses: DataFrame, key: str = "id") -> DataFrame:
    """Entities nothing refers to."""
    left = base
    for u in uses:
        left = left.join(u.select(key), key, "left_anti")
    return left


def relations(rows: DataFrame, subject: str, obj: str, predicate: str, confidence: list[str]) -> DataFrame:
    """Relations two columns of the same row state: (subject, object, predicate, n, confidence)."""
    return (
        rows.where(F.col(subject).isNotNull() & F.col(obj).isNotNull())
        .groupBy(F.col(subject).alias("subject"), F.col(obj).alias("object"))
        .agg(F.count("*").alias("n"), F.min(F.least(*confidence) if len(confidence) > 1 else F.col(confidence[0])).alias("confidence"))
        .select("subject", "object", F.lit(predicate).alias("predicate"), "n", "confidence")
    )


def prefix_search(base: DataFrame, prefix: str, n: int) -> DataFrame:
    """Entities with a word that starts with a prefix: most mentioned first."""
    test = F.exists(words_of(F.col("name")), lambda w: F.startswith(w, fold(F.lit(prefix))))
    return base.where(test).orderBy(F.desc("mentions"), "name").limit(n)


def reduce_files(links: DataFrame, wanted: list[str], files: DataFrame) -> DataFrame:
    """The files a question about entities is put to: (relative_path, hits, confidence, reason), best first.

    Driving entities are those asked for that are sure enough and in few enough of the files. Their files come with
    reason entity, at most MOST_DOCUMENTS of them, and files the base has never read with reason unread, as nothing is known
    of them. Without a driving entity, among fewer than MIN_FILES files, or where fewer than a share of MIN_REDUCTION would
    be left out, all files come, with reason all. files: relative_path, each once.
    """
    keyed = links.where("surface is not null").withColumn("key", name_key(F.col("surface"))).where(F.col("key").isin([w.lower() for w in wanted]))
    listed = files.select("relative_path").distinct()
    total = listed.agg(F.count("*").alias("all"))  # one row
    per = keyed.groupBy("key").agg(F.countDistinct("relative_path").alias("files"), F.max("confidence").alias("sure"))
    driving = per.join(F.broadcast(total)).where((F.col("sure") >= SURE) & (F.col("files") <= SELECTIVE * F.col("all"))).select("key")
    hits = keyed.join(driving, "key").join(listed, "relative_path", "left_semi").groupBy("relative_path").agg(F.count("*").alias("hits"), F.max("confidence").alias("confidence"))
    unread = listed.join(links.select("relative_path"), "relative_path", "left_anti")
    # one row: whether the reduction is worth it
    kept = hits.agg(F.count("*").alias("hit")).join(F.broadcast(unread.agg(F.count("*").alias("unread")))).join(F.broadcast(total))
    use = kept.select(((F.col("hit") > 0) & (F.col("all") >= MIN_FILES) & (F.col("all") - F.col("hit") - F.col("unread") >= MIN_REDUCTION * F.col("all"))).alias("use"))
    best = hits.orderBy(F.desc("hits"), F.desc("confidence"), "relative_path").limit(MOST_DOCUMENTS).withColumn("reason", F.lit("entity"))
    rest = unread.select("relative_path", F.lit(0).cast("bigint").alias("hits"), F.lit(None).cast("double").alias("confidence"), F.lit("unread").alias("reason"))
    every = listed.select("relative_path", F.lit(0).cast("bigint").alias("hits"), F.lit(None).cast("double").alias("confidence"), F.lit("all").alias("reason"))
    out = best.unionByName(rest).join(F.broadcast(use)).where("use").unionByName(every.join(F.broadcast(use)).where("not use")).drop("use")
    return out.orderBy(F.desc("hits"), F.desc("confidence"), "relative_path")


def capped(mentions: DataFrame, source: str, most: int) -> DataFrame:
    """Each source's most confident mentions, at most so many: the cap on what a source may say."""
    w = Window.partitionBy(source).orderBy(F.desc("confidence"), "row_id")
    return mentions.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
