"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Targets: sources in code point order (null last) weigh 5, 2, 1 in turn and share all words; no
source's target exceeds REPEAT times its own words, and what it can't take is reshared by weight.
That is a water level: a source is full when REPEAT * words / weight is below the level, and the
level follows from running sums over the sources in that order.

Schedule: during training time t in [0, 1] source s is drawn at the rate
target * (1 + a * (2t - 1)); a in [-1, 1] is its trend (early or late). The integral is the demand
for its words up to t, and its inverse gives each document's training position: a source's
documents stand in a fixed pseudo-random order (MD5 of doc_id), their words make a stream, the
stream is repeated as often as the target asks, and a document comes when demand reaches its
first word. The last document of a stream is cut at the target's last word.

Running sums over a source's documents never bring a source into one task: words are summed per
(source, bucket of the order), the buckets' sums are accumulated, then documents are accumulated
within their bucket.

Defined results: null text: size 0; null doc_id: ordered by the MD5 of the empty text; repeated
rows count as often as they occur (ties in order are broken by size); a source without words has
target 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm import common

WEIGHTS = (5, 2, 1)
REPEAT = 3
#: Trend of the sources' schedules, repeating: falling, level, rising.
TRENDS = (-0.5, 0.0, 0.5)
#: Leading hex digits of the order key that make a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, ord, bucket) for each row of docs."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("ord"),
    ).withColumn("bucket", F.substring("ord", 1, BUCKET_DIGITS))


def targets(by_source: DataFrame) -> DataFrame:
    """(source, source_size, weight, trend, target) from (source, source_size); one row a source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = lambda values: F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))
    w = by_source.select("source", "source_size", weigh(WEIGHTS).cast("long").alias("weight"), weigh(TRENDS).alias("trend"))
    cap = F.lit(REPEAT) * F.col("source_size")
    fullness = W.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fullness.rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.select("*", cap.alias("cap"), (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"))
    # Full: its own share of what the fuller ones leave exceeds its cap. In this order those come first.
    w = w.withColumn("full", F.col("left") * F.col("weight") > F.col("cap") * F.col("left_weight"))
    rest = w.select("*", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every).alias("open_weight"), F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)).alias("taken_by_full"), F.sum("source_size").over(every).alias("all_words"))
    level = (F.col("all_words") - F.col("taken_by_full")) * F.col("weight") / F.col("open_weight")
    return rest.select("source", "source_size", "weight", "trend", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def streams(docs: DataFrame) -> DataFrame:
    """Each document with its source's target and the words before it in its source's stream."""
    own = sized(docs)
    by_bucket = own.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    # Buckets and sources are few rows: at most 4096 buckets for each source.
    ahead = by_bucket.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("bucket_start"))
    ahead = ahead.select(F.col("source").alias("s"), "bucket", "bucket_start").join(by_source, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    within = W.partitionBy("source", "bucket").orderBy("ord", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    run = own.select("*", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("in_bucket"))
    met = run.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (run["bucket"] == ahead["bucket"]))
    return met.select("doc_id", "source", "size", "ord", "source_size", "trend", "target", (F.col("bucket_start") + F.col("in_bucket")).alias("start"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken; then source, copies and the first training position."""
    whole = F.expr("CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END").cast("long")
    d = streams(docs).withColumn("words", F.round("target").cast("long")).withColumn("epochs", whole)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("epochs") * F.col("source_size") - F.col("start")))
    d = d.withColumn("part", part.cast("long"))
    d = d.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0)))
    return d.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", F.when(F.col("copies") > 0, position(F.col("start"))).alias("position"), "start", "ord")


def position(word):
    """When demand reaches this word of the source's stream: the inverse of t + trend * (t * t - t)."""
    share = word / F.greatest(F.col("target"), F.lit(1.0))
    a, b = F.col("trend"), F.lit(1.0) - F.col("trend")
    return F.when(a == 0, share).otherwise(2 * share / (b + F.sqrt(b * b + 4 * a * share)))


def schedule(docs: DataFrame) -> DataFrame:
    """One row for each copy, in training order: position, doc_id, source, copy, words."""
    d = mixed(docs)
    trends = targets(d.groupBy("source").agg(F.sum("size").alias("source_size"))).select(F.col("source").alias("s"), "trend")
    d = d.join(trends, F.col("source").eqNullSafe(F.col("s"))).where("copies > 0")
    d = d.select("*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    return d.select(position(F.col("start") + F.col("copy") * F.col("source_size")).alias("position"), "doc_id", "source", "copy", words.alias("words")).orderBy("position", "doc_id", "copy")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix in training order: with each document its copies and the position of the first (null if it has none)."""
    d = mixed(common.table(spark, sf_dir, "documents"))
    return d.orderBy("position", "ord").select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight,
        ([-0.5, 0.0, 0.5])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS trend
      FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, source, source_size, weight, false AS is_full FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         is_full OR (sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0)) * weight
                    > 3 * source_size * sum(CASE WHEN NOT is_full THEN weight END) OVER ()
  FROM fill WHERE step < (SELECT count(*) FROM s)),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE
    ((sum(source_size) OVER () - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0)) * weight)::BIGINT
      / (sum(CASE WHEN NOT is_full THEN weight END) OVER ())::BIGINT END AS target
  FROM fill WHERE step = (SELECT count(*) FROM s)),
r AS (
  SELECT d.*, t.source_size, t.target, (SELECT trend FROM s WHERE s.source IS NOT DISTINCT FROM d.source) AS a,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
    CASE WHEN t.source_size > 0 THEN floor(round(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - epochs * source_size - start))::BIGINT AS part, start::DOUBLE / greatest(target, 1.0) AS share FROM r),
c AS (SELECT *, CASE WHEN size > 0 THEN epochs + (part > 0)::BIGINT ELSE 0 END::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN CASE WHEN a = 0 THEN share ELSE 2 * share / ((1.0 - a) + sqrt((1.0 - a) * (1.0 - a) + 4 * a * share)) END END AS position
FROM c
"""
