"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are hashed, GRAM neighbours are hashed together, and of each SLIDE neighbouring grams the least
hash is a fingerprint, kept with its place. WINDOW = GRAM + SLIDE - 1 words always contain one, and equal words give equal
ones, so where a document holds a benchmark window it has the window's fingerprint, at most SLIDE - 1 words after the
window's start. Fingerprints of all documents meet those of the benchmark; from the places where they meet, hits are extended
to the windows around and compared as text. Items shorter than a window are one window of their own length,
fingerprinted whole.

The benchmark's fingerprints and windows, and the places where documents meet them, are broadcast only
when counted and at most BROADCAST_ROWS; beyond that the same joins shuffle.

Defined results: null texts have no words (n_words 0, nothing hit) and wordless items no windows; null
item ids count as the empty id; repeated items count once. Every row of documents gives one row, judged by its own
text: a document is its doc_id, which may be null, and the 64-bit hash of its text (sub). An empty benchmark hits nothing; an empty table gives no rows. Extra columns
are ignored by ``hits`` and carried by ``drop_contaminated``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm import common

WINDOW = 8
GRAM = 5
SLIDE = WINDOW - GRAM + 1
CONTAMINATED_ITEMS = 2
BROADCAST_ROWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def exploded(df: DataFrame, *columns, **arrays: str) -> DataFrame:
    """columns and a row for each element of the array, as the name given to it.

    Not explode(): for that the optimizer infers that the array isn't empty, and computes it, and what it is made from, once more.
    """
    (array, name), = arrays.items()
    return df.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, wherever body uses it: the optimizer would write it out again within a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def grams(h: Column, length: int) -> Column:
    """Hashes of each run of length hashes of h; the length is part of what is hashed."""
    each = F.transform(F.sequence(F.lit(0), F.size(h) - length), lambda i: F.xxhash64(F.lit(length), *(F.get(h, i + j) for j in range(length))))
    return F.when(F.size(h) >= length, each).otherwise(F.array().cast("array<bigint>"))


def picks(words: Column, short: list[int]) -> Column:
    """(print, place, length) of a text's fingerprints: least hashes, and whole runs of the short lengths.

    length is that of the windows which a print stands for. Of equal least hashes every place is picked.
    """
    picked = lambda m: lambda x, i: F.struct(x.alias("print"), i.alias("place"), F.lit(m).alias("length"))

    def of_windows(g: Column) -> Column:
        least = F.transform(g, lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, SLIDE))))
        whole = F.slice(least, F.lit(1), F.greatest(F.size(g) - (SLIDE - 1), F.lit(0)))
        # A gram is the least of some window if it is the greatest of the least hashes of the windows that hold it.
        return bound(whole, lambda m: F.filter(F.transform(g, picked(WINDOW)), lambda e: e["print"] == F.greatest(*(F.get(m, e["place"] - j) for j in range(SLIDE)))))

    own = lambda h: F.concat(bound(grams(h, GRAM), of_windows), *(F.transform(grams(h, m), picked(m)) for m in short))
    return bound(F.transform(words, lambda w: F.xxhash64(w)), own)


def windows(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, length, window (its words joined by spaces) of every (start from 0, length) in the column spans."""
    each = exploded(df, *keys, "words", spans="span")
    text = F.array_join(F.slice("words", F.col("span.start") + 1, F.col("span.length")), " ")
    return each.select(*keys, "span.start", "span.length", text.alias("window"))


def span(start, length) -> Column:
    return F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"))


def around(places: Column, n: Column) -> Column:
    """The spans of whole windows of a text of n words that places, (place, length) of picks, can lie in."""
    def spans(p):
        first = F.when(p["length"] == WINDOW, F.greatest(F.lit(0), p["place"] - (SLIDE - 1))).otherwise(p["place"])
        last = F.least(p["place"], n - p["length"])
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda s: span(s, p["length"]))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))

    return F.array_distinct(F.flatten(F.transform(places, spans)))


def bounded(df: DataFrame) -> DataFrame:
    """df to broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs."""
    return judged(docs, benchmark).drop("sub")


def documents(docs: DataFrame) -> DataFrame:
    return common.texts(docs).select("doc_id", F.xxhash64("text").alias("sub"), "text")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """hits, with sub."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())  # at most WINDOW values
    short = [m for m in lengths if m < WINDOW]
    own = documents(docs).select("doc_id", "sub", words(F.col("text")).alias("words"))
    empty = F.sha2(F.lit(""), 256)
    if not lengths:
        return own.select("doc_id", "sub", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty.alias("items_sha256"), F.lit(False).alias("contaminated"))
    m = F.least(F.size("words"), F.lit(WINDOW))
    every = F.transform(F.sequence(F.lit(0), F.size("words") - m), lambda i: span(i, m))
    item_windows = common.written(windows(items.withColumn("spans", every), ["item_id"]).select("item_id", "window").distinct(), "windows")
    # A window is fingerprinted like a document: it has its least hash, or its own whole hash.
    apart = item_windows.select("window").distinct().select(F.split("window", " ").alias("words"))
    prints = exploded(apart.withColumn("picks", picks(F.col("words"), short)), "words", picks="pick").where(F.col("pick.length") == F.least(F.size("words"), F.lit(WINDOW)))
    prints = bounded(common.written(prints.select("pick.print").distinct(), "prints")).select("print", F.lit(1).alias("met"))
    # One pass over the texts: a row for each fingerprint, and one without for the number of words.
    none = F.lit(None).cast("struct<print:bigint,place:int,length:int>")
    marked = own.select("doc_id", "sub", F.size("words").alias("n_words"), F.explode_outer(F.concat(F.array(none), picks(F.col("words"), short))).alias("pick")).select("doc_id", "sub", "n_words", "pick.*")
    met = marked.join(prints, "print", "left").where("print IS NULL OR met = 1")
    met = common.written(met.groupBy("doc_id", "sub", "place", "length").agg(F.max("n_words").cast("long").alias("n_words"), F.count(F.lit(1)).alias("rows")), "met")
    flags = met.where("place IS NULL").select("doc_id", "sub", "n_words", "rows")
    # A document's places are at most as many as its words and their lengths; all of them are counted before a broadcast.
    places = met.where("place IS NOT NULL").select("doc_id", "sub", "place", "length")
    few = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    suspects = places.groupBy(F.col("doc_id").alias("id"), F.col("sub").alias("id_sub")).agg(F.collect_list(F.struct("place", "length")).alias("places"))
    suspects = common.written(suspects, "suspects")
    suspects = F.broadcast(suspects) if few else suspects
    near = documents(docs).join(suspects, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sub") == F.col("id_sub"))).select("doc_id", "sub", words(F.col("text")).alias("words"), "places")
    found = windows(near.withColumn("spans", around(F.col("places"), F.size("words"))), ["doc_id", "sub"]).join(bounded(item_windows.select("window").distinct()), "window", "left_semi")
    found = common.written(found.select("doc_id", "sub", "start", "length", "window").distinct(), "hits")
    each = flags.select("doc_id", "sub", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))
    same = lambda name: each["doc_id"].eqNullSafe(F.col(f"{name}_doc")) & (each["sub"] == F.col(f"{name}_sub"))
    return each.join(covered(found), same("hit"), "left").join(item_lists(found, item_windows), same("item"), "left").select(
        "doc_id", "sub", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", empty).alias("items_sha256"), (F.coalesce("n_items", F.lit(0)) >= CONTAMINATED_ITEMS).alias("contaminated"),
    )


def covered(found: DataFrame) -> DataFrame:
    """hit_doc, hit_sub, n_hit: words of a document under its hits, each once."""
    spans = found.groupBy("doc_id", "sub", "start").agg((F.col("start") + F.max("length")).alias("stop"))  # of several lengths the longest
    before = W.partitionBy("doc_id", "sub").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    return spans.select("doc_id", "sub", fresh.alias("fresh")).groupBy(F.col("doc_id").alias("hit_doc"), F.col("sub").alias("hit_sub")).agg(F.sum("fresh").alias("n_hit"))


def item_lists(found: DataFrame, item_windows: DataFrame) -> DataFrame:
    """item_doc, item_sub, n_items, items_sha256: the distinct items whose windows a document holds."""
    pairs = found.select("doc_id", "sub", "window").distinct().join(item_windows, "window").select("doc_id", "sub", "item_id").distinct()
    listed = pairs.groupBy(F.col("doc_id").alias("item_doc"), F.col("sub").alias("item_sub")).agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    return listed.select("item_doc", "item_sub", F.size("ids").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents."""
    gone = common.written(judged(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__gone"), F.col("sub").alias("__sub")).distinct(), "gone")
    own_sub = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bounded(gone), docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (own_sub == F.col("__sub")), "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(8, len(w)) AS l, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS win
       FROM bw, unnest(range(1, greatest(len(w) - 7, 1) + 1)) t(i) WHERE len(w) > 0),
hit AS (SELECT doc_id, i, l, win FROM (
          SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS win
          FROM dw, (SELECT DISTINCT l FROM iw) ls, unnest(range(1, len(w) - l + 2)) t(i))
        WHERE win IN (SELECT win FROM iw)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + l)) t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, item_id FROM hit JOIN iw USING (win)) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
