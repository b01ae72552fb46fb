"""What the operators share: reading tables and written intermediates."""

from __future__ import annotations

import ctypes
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.shared import gathered, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, go."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def in_workers(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with a worker's free memory given back to the system when a task ends: workers stay for later tasks."""

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return df.mapInArrow(lean, schema)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_setting = threading.RLock()


def written(df: DataFrame, label: str, batch: int | None = None, rows: int | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back.

    The files survive the loss of executors; the owner of the shared folder clears it. batch: bytes that go
    to a Python worker at once, where rows are large and the session allows more. It is a setting of the session while
    df is planned and written, so such writes wait for each other; it changes how fast other queries are, not what they give.
    rows: about how many rows come at most, where that is known; they go to few files (see gathered()).
    """
    spark = df.sparkSession
    df = df if rows is None else gathered(df, rows)
    path = f"{shared_dir(spark)}/lodestar-{label}-{uuid.uuid4().hex}"
    if batch is None:
        df.write.option("compression", "zstd").parquet(path)
    else:
        with _setting:
            usual = spark.conf.get(BATCH)
            spark.conf.set(BATCH, str(batch))
            try:
                df.select("*").write.option("compression", "zstd").parquet(path)  # a plan made before keeps the session's own
            finally:
                spark.conf.set(BATCH, usual)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(texts: DataFrame) -> int:
    """Bytes of the column text, by which buckets are sized."""
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions, which a cluster sizes with its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that are broadcast at most; more are joined by shuffling.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, all its columns, without the rows whose doc_id is in gone (doc_id).

    The ids are counted first; a bounded number is broadcast, so that texts don't move. Rows with a
    null doc_id can't be told apart and stay.
    """
    ids = written(gone.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == ids["__gone"], "left_anti")
