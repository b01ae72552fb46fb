"""Reasoning over a stream of triples: every micro-batch is new input of the fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestar.plans.engine import KEY, Reasoner


def materialise(reasoner: Reasoner, stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the Parquet tables path/source and path/inferred/<batch> up to date with a stream of s, p, o.

    A batch adds its triples to the sources and writes the closure of all of them that isn't there yet. A
    repeated batch overwrites its own files, so the result is exact after a restart.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(*KEY).distinct().write.mode("overwrite").parquet(f"{path}/source/batch={number}")
        sources = spark.read.parquet(f"{path}/source").where(f"batch <= {number}").select(*KEY)
        inferred = reasoner.infer(sources)
        if number:
            known = spark.read.parquet(f"{path}/inferred").where(f"batch < {number}").select(*KEY)
            inferred = inferred.join(known, KEY, "left_anti")
        inferred.write.mode("overwrite").parquet(f"{path}/inferred/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
