"""Bounded labelled samples for the classifiers, and hashing of terms in Python workers."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common


def remainder(doc_id, modulus: int):
    """crc32 of doc_id as text, modulo modulus; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(labels: DataFrame, target: str, modulus: int, held: int, bound: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most bound rows of either class, and how many rows each class has.

    Rows whose remainder is held never enter. Repeated labels of a document count once (the largest);
    null labels or ids not at all. The choice follows a hash of doc_id, so reruns agree.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.where(remainder(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound) for c in (0, 1)]
    return chosen[0].unionByName(chosen[1]), counts


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(label, text); the sample's size is bounded, so it is broadcast."""
    return common.texts(docs).join(F.broadcast(chosen), "doc_id").select("label", "text")


class Buckets(dict):
    """word -> hashed bucket; forgets what it knows when it grows too large."""

    def __init__(self, bits: int, limit: int = 200_000):
        super().__init__()
        self.mask, self.limit = (1 << bits) - 1, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & self.mask
        return found
