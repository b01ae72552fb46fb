"""The corpus pipeline: toxic documents go, of equal texts one stays, of similar texts one stays,
contaminated documents go, and what is left is mixed by source.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents; the last returns a row for each document with its words in the mix (taken), its copies
and its first training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import common, decontamination, exact_dedup, mixing, ngram_join, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is judged by its own text, whatever its doc_id; null and empty texts are those of the model's bias. Repeated rows go or stay alike."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row with the largest doc_id stays. Rows without a doc_id, and copies that share one, stay."""
    return exact_dedup.drop_exact_copies(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts the row with the least doc_id (null last) stays, of several texts with it the one of the least hash.
    Rows of one doc_id and one text go or stay together; null texts and texts without words are like no other and stay."""
    return ngram_join.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is judged by its own text, whatever its doc_id; null texts stay, as all do where there is no benchmark."""
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs, in training order; null texts have size 0 and no copies, null sources are a source of their own."""
    d = mixing.mixed(docs)
    return d.orderBy("position", "ord").select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The first stage learns a model, which SQL can't express; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
