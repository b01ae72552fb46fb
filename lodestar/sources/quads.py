"""Reading and writing triples and quads, and an index-like view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.terms import lexical

_TERM = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
LINE = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}(?:\s+(<[^>]*>|_:[^\s.]+))?\s*\.\s*(?:#.*)?$"
STRING = "^^<http://www.w3.org/2001/XMLSchema#string>"


def typed(term):
    """A plain literal gets its datatype."""
    return F.when(term.startswith('"') & term.endswith('"'), F.concat(term, F.lit(STRING))).otherwise(term)


def read_ntriples(spark: SparkSession, path: str, graph: str = "") -> DataFrame:
    """s, p, o, g from N-Triples or N-Quads lines; comments and empty lines go, a malformed line stops the read."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("value", LINE, i)
    checked = lines.withColumn("value", F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), "value"))))
    return checked.select(typed(part(1)).alias("s"), part(2).alias("p"), typed(part(3)).alias("o"), F.when(part(4) == "", F.lit(graph)).otherwise(part(4)).alias("g"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.text(path)


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, g from Parquet; partitioned by p, patterns with a constant predicate prune files."""
    return spark.read.parquet(path)


def write_quads(quads: DataFrame, path: str, partition_by_predicate: bool = False) -> None:
    writer = quads.write.partitionBy("p") if partition_by_predicate else quads.write
    writer.parquet(path)


class QuadIndex:
    """Lookups over a table of triples; each is a filter that reaches the scan."""

    def __init__(self, triples: DataFrame):
        self.triples = triples.select("s", "p", "o").distinct()

    def add(self, triples: DataFrame) -> QuadIndex:
        return QuadIndex(self.triples.unionByName(triples.select("s", "p", "o")))

    def _of(self, want: str, **given: str) -> DataFrame:
        found = self.triples
        for column, term in given.items():
            found = found.where(F.col(column) == term)
        return found.select(want).distinct()

    def objects(self, p: str, s: str) -> DataFrame:
        return self._of("o", p=p, s=s)

    def subjects(self, p: str, o: str) -> DataFrame:
        return self._of("s", p=p, o=o)

    objects_for_subject = lambda self, s, p: self.objects(p, s)
    subjects_for_object = lambda self, o, p: self.subjects(p, o)

    def pairs(self, p: str) -> DataFrame:
        return self.triples.where(F.col("p") == p).select("s", "o")

    def has(self, p: str, s: str, lexical_object: str) -> bool:
        """Whether s p has an object of this lexical form, whatever its datatype."""
        return not self.triples.where((F.col("p") == p) & (F.col("s") == s) & (lexical(F.col("o")) == lexical_object)).isEmpty()
