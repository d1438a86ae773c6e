"""The entity base over its relations: mentions, names, merges, and the reports drawn from them.

Mentions are rows (row_id, domain, relative_path, entity_id, surface, type_id, role, source, confidence, locator).
Names and merges are derived once per entity and are small beside the mentions; every report is an aggregation of
mentions by entity, joined with them afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import fold, words_of
from lectern.operators.knowledge import SOURCES
from lectern.operators.relational import best_per, follow_redirects

#: What a mention is made of.
MENTION = ["row_id", "domain", "relative_path", "entity_id", "surface", "type_id", "role", "source", "confidence", "locator"]
#: Roles in the order a sheet shows them.
ROLES = ["subject", "issuer", "recipient", "mentioned"]


def linked(mentions: DataFrame) -> DataFrame:
    """Mentions that name an entity, its id an integer; columns beyond MENTION are dropped, so names cannot clash."""
    return mentions.where("entity_id is not null").select(MENTION).withColumn("entity_id", F.col("entity_id").cast("bigint"))


def names(mentions: DataFrame) -> DataFrame:
    """The name of each entity (id, name): its commonest writing, the lesser of equally common ones."""
    writings = linked(mentions).where("surface is not null").groupBy(F.col("entity_id").alias("id"), "surface").agg(F.count("*").alias("n"))
    return best_per(writings, ["id"], [F.desc("n"), F.asc("surface")]).select("id", F.col("surface").alias("name"))


def merges(named: DataFrame) -> DataFrame:
    """Redirects (id, merged_into): entities of one folded name go to the one before them, so chains arise; the first has null."""
    from pyspark.sql import Window

    w = Window.partitionBy(fold(F.col("name"))).orderBy("id")
    return named.select("id", F.lag("id").over(w).alias("merged_into"))


def survivors(mentions: DataFrame) -> DataFrame:
    """Entities with their name, the entity they now are and its name: (id, name, root, root_name)."""
    named = names(mentions)
    ends = follow_redirects(merges(named)).select(F.col("node").alias("id"), "root")
    own = named.select(F.col("id").alias("root"), F.col("name").alias("root_name"))
    return named.join(ends, "id").join(own, "root").select("id", "name", "root", "root_name")


def effective_mentions(mentions: DataFrame) -> DataFrame:
    """Linked mentions with the surviving entity in entity_id and its name beside."""
    to = survivors(mentions).select(F.col("id").alias("entity_id"), "root", "root_name")
    return linked(mentions).join(to, "entity_id").drop("entity_id").withColumnsRenamed({"root": "entity_id", "root_name": "name"})


def prefix_search(mentions: DataFrame, prefix: str, n: int = 20) -> DataFrame:
    """Surviving entities one of whose writings has a word that starts so, each once, the most mentioned first."""
    test = F.exists(words_of(F.col("surface")), lambda w: F.startswith(w, fold(F.lit(prefix))))
    hits = effective_mentions(mentions).where(test)
    return hits.groupBy("entity_id", "name").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name", "entity_id").limit(n)


def weights(mentions: DataFrame, scope: Column) -> DataFrame:
    """Every surviving entity with its mentions and files in a scope, 0 where it has none there."""
    every = survivors(mentions).select(F.col("root").alias("entity_id"), F.col("root_name").alias("name")).distinct()
    inside = effective_mentions(mentions).where(scope).groupBy("entity_id").agg(F.count("*").alias("mentions"), F.countDistinct("domain", "relative_path").alias("files"))
    return every.join(inside, "entity_id", "left").na.fill(0, ["mentions", "files"])


def provenance(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Every linked mention with its file's title and type, null where the file has none or is gone."""
    known = files.select("domain", "relative_path", "title", "business_type")
    return linked(mentions).join(known, ["domain", "relative_path"], "left").select("row_id", "entity_id", "surface", "title", "business_type")


def roles(mentions: DataFrame) -> DataFrame:
    """Mentions of each surviving entity by role, with the role's place: (entity_id, role, position, n)."""
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    return effective_mentions(mentions).where("role is not null").groupBy("entity_id", "role").agg(F.count("*").alias("n")).select("entity_id", "role", place.alias("position"), "n")


def table_places(mentions: DataFrame) -> DataFrame:
    """Mentions in tables by file, sheet and column: (relative_path, sheet, column, entities, mentions)."""
    where = F.regexp_extract("locator", "^cells:([^!]*)!(.*)$", 1), F.regexp_extract("locator", "^cells:([^!]*)!(.*)$", 2)
    cells = linked(mentions).where(F.startswith("locator", F.lit("cells:")))
    return cells.groupBy("relative_path", where[0].alias("sheet"), where[1].alias("column")).agg(F.countDistinct("entity_id").alias("entities"), F.count("*").alias("mentions"))


def supporting_sources(mentions: DataFrame) -> DataFrame:
    """Different files behind each surviving entity, those of merged ones included, and whether they make it active."""
    per = effective_mentions(mentions).groupBy("entity_id").agg(F.countDistinct("domain", "relative_path").alias("sources"))
    return per.withColumn("status", F.when(F.col("sources") >= SOURCES, "active").otherwise("candidate"))


def facet(mentions: DataFrame, fields: DataFrame, n: int = 10) -> DataFrame:
    """The n active entities in most files, over mentions and profile fields that write a surviving entity's name."""
    known = effective_mentions(mentions)
    own = known.select("entity_id", "domain", "relative_path")
    by_name = known.select("entity_id", fold(F.col("name")).alias("key")).distinct()
    written = fields.where("kind = 'role_surface' and value is not null").select("domain", "relative_path", fold(F.col("value")).alias("key"))
    pairs = own.unionByName(written.join(by_name, "key").select("entity_id", "domain", "relative_path")).distinct()
    counted = pairs.groupBy("entity_id").agg(F.count("*").alias("files")).where(F.col("files") >= SOURCES)
    return counted.orderBy(F.desc("files"), "entity_id").limit(n)


def health(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Six lists of what wants attention, counted: (list, n)."""
    per = effective_mentions(mentions).groupBy("entity_id").agg(
        F.countDistinct("domain", "relative_path").alias("files"),
        F.count_if(F.col("domain") == "data").alias("in_tables"),
        F.count_if(F.col("domain") == "documents").alias("in_documents"),
        F.count("type_id").alias("typed"),
        F.max("confidence").alias("sure"),
    )
    one = per.agg(
        F.count_if(F.col("files") < SOURCES).alias("candidates"),
        F.count_if((F.col("in_documents") > 0) & (F.col("in_tables") == 0)).alias("only_in_documents"),
        F.count_if((F.col("in_tables") > 0) & (F.col("in_documents") == 0)).alias("only_in_tables"),
        F.count_if(F.col("typed") == 0).alias("without_type"),
        F.count_if(F.coalesce("sure", F.lit(0.0)) < 0.5).alias("unsure"),
    )
    bare = files.join(linked(mentions).select("domain", "relative_path"), ["domain", "relative_path"], "left_anti").agg(F.count("*").alias("files_without_entity"))
    row = one.join(F.broadcast(bare))  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("n")) for c in row.columns])).alias("x")).select("x.*")


def overview(mentions: DataFrame) -> DataFrame:
    """One row: surviving entities, merged ones, mentions, unlinked mentions, different writings, files."""
    ends = survivors(mentions).agg(F.countDistinct("root").alias("entities"), F.count_if(F.col("id") != F.col("root")).alias("merged"))
    rows = mentions.agg(
        F.count("entity_id").alias("mentions"),
        F.count_if(F.col("entity_id").isNull()).alias("unlinked"),
        F.countDistinct("surface").alias("writings"),
        F.countDistinct("domain", "relative_path").alias("files"),
    )
    return ends.join(F.broadcast(rows))  # one row each


def integrity(mentions: DataFrame, files: DataFrame, redirects: DataFrame) -> DataFrame:
    """Broken invariants, counted: (check, n), 0 where all is well.

    redirects (id, merged_into) may hold cycles; a node is in one if following it never ends, which is when after as many
    doublings as the number of redirects has bits it still moves.
    """
    at = ["domain", "relative_path"]
    counts = mentions.agg(
        F.count_if(F.col("surface").isNull() | (F.trim("surface") == "")).alias("blank_surface"),
        F.count_if(F.col("type_id").isNull()).alias("missing_type"),
        F.count_if(F.col("role").isNull()).alias("missing_role"),
        F.count_if(~F.coalesce("confidence", F.lit(0.0)).between(0, 1)).alias("confidence_out_of_range"),
        F.count_if(F.col("relative_path").isNull()).alias("missing_path"),
        (F.count("*") - F.countDistinct(F.col("row_id"))).alias("repeated_key"),
    )
    dangling = mentions.where("relative_path is not null").join(files.select(at), at, "left_anti").agg(F.count("*").alias("dangling_mention"))
    again = files.groupBy(at).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_file"))
    gone = redirects.where("merged_into is not null").join(redirects.select(F.col("id").alias("merged_into")), "merged_into", "left_anti").agg(F.count("*").alias("redirect_to_nothing"))
    itself = redirects.agg(F.count_if(F.col("id") == F.col("merged_into")).alias("redirect_to_itself"))
    twice = redirects.groupBy("id").agg(F.countDistinct("merged_into").alias("n")).where("n > 1").agg(F.count("*").alias("several_redirects"))
    row = counts
    for other in (dangling, again, gone, itself, twice):
        row = row.join(F.broadcast(other))  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in row.columns])).alias("x")).select("x.*")


def sheet(mentions: DataFrame, entity: int) -> DataFrame:
    """What is known of one surviving entity: (section, key, n) of its roles, types, domains and writings."""
    own = effective_mentions(mentions).where(F.col("entity_id") == entity)
    parts = [F.struct(F.lit(s).alias("section"), F.col(c).alias("key")) for s, c in (("role", "role"), ("type", "type_id"), ("domain", "domain"), ("writing", "surface"), ("source", "source"))]
    return own.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("key is not null").groupBy("section", "key").agg(F.count("*").alias("n"))


def partners(mentions: DataFrame) -> DataFrame:
    """Open matches between surviving entities: those whose writings have the same words in another order."""
    key = F.concat_ws(" ", F.array_sort(words_of(F.col("surface"))))
    rows = effective_mentions(mentions).select("entity_id", key.alias("key")).where("key <> ''").distinct()
    few = rows.groupBy("key").agg(F.min("entity_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    # an entity meets the least of its key, not every other one
    return rows.join(few.select("key", "least"), "key").where("entity_id <> least").select(F.col("least").alias("a"), F.col("entity_id").alias("b")).distinct()


def page(found: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a result with the total of the whole in every row."""
    whole = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(whole))
