"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Each text is cut where its own content says so: a chunk has at least CHUNK_MIN characters and
ends at the next sentence or line end, at the latest after CHUNK_MAX. A chunk's identifier is its
SHA-256. Identifiers are verified by bytes: distinct (identifier, chunk) pairs are counted, and an
identifier that stands for two different chunks is replaced by the chunk itself. Documents are
equal when their ordered lists of identifiers are. Chunk texts move once, after a map-side
distinct; whole documents never move. Lists are grouped after a map-side count; documents find their group by the
SHA-256 of their list, or by the list itself if two lists have one (which is looked for). Groups of two and more are broadcast
if they are at most BROADCAST_GROUPS rows of fixed size, so that a large group isn't brought to one task.

Defined results: a null text counts as empty, and all empty texts are equal (their list is
empty). A null doc_id loses against any other; a group of null ids only has keep_id null and keeps
its rows. Repeated rows with one doc_id share their decision. An empty table gives no rows. Extra
columns are ignored by ``exact_groups`` and carried by ``drop_exact_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common

CHUNK_MIN, CHUNK_MAX = 256, 1024
#: More colliding identifiers than this stop the query; none has ever been seen for SHA-256.
MOST_COLLISIONS = 64
BROADCAST_GROUPS = 500_000


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The text's chunks in order; joined, they give the text again."""
    pattern = rf"(?s)(?:.{{{least - 1},{most - 1}}}?[.!?\n]|.{{1,{most}}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def collisions(docs: DataFrame) -> Column:
    """One array: the identifiers that stand for more than one chunk (a scalar subquery)."""
    # Not explode(), for which the optimizer would cut every text twice to see whether it has chunks.
    pairs = docs.select(F.explode_outer(chunks(F.col("text"))).alias("chunk")).where("chunk IS NOT NULL").select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    twice = pairs.groupBy("id").count().where("count > 1").select("id").limit(MOST_COLLISIONS + 1)
    found = twice.agg(F.collect_list("id").alias("ids"))
    return found.select(F.when(F.size("ids") > MOST_COLLISIONS, F.raise_error(F.lit("too many identifier collisions"))).otherwise(F.col("ids"))).scalar()


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, recipe array<binary>, text_sha256) for each row of docs."""
    own = common.texts(docs)
    cut = own.select("doc_id", chunks(F.col("text")).alias("parts"), F.sha2(F.col("text"), 256).alias("text_sha256"), collisions(own).alias("twice"))
    plain = F.transform("parts", identifier)
    safe = F.transform("parts", lambda c: F.when(F.array_contains(F.col("twice"), identifier(c)), F.encode(c, "UTF-8")).otherwise(identifier(c)))
    return cut.select("doc_id", F.when(F.size("twice") == 0, plain).otherwise(safe).alias("recipe"), "text_sha256")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; the largest doc_id of equal texts stays."""
    key = F.unhex(F.sha2(F.to_json("recipe").cast("binary"), 256))
    listed = common.written(recipes(docs).withColumn("key", key), "recipes")
    groups = common.written(listed.groupBy("key", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    by = ["key"] if groups.groupBy("key").count().where("count > 1").isEmpty() else ["key", "recipe"]
    several = groups.where("group_size > 1").select(*by, "keep_id", "group_size")
    if by == ["key"] and several.count() <= BROADCAST_GROUPS:
        several = F.broadcast(several)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return listed.join(several, by, "left").select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row with a larger doc_id holds."""
    return common.without(docs, exact_groups(docs).where(~F.col("kept")))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
