"""Closures and components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.shared import written

#: Shares of a clique whose pairs are made in tasks of their own.
SALTS = 16


def transitive_closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b) for every path from a to b, by doubling: paths meet paths, so rounds grow with the log of the longest."""
    found = written(edges.select("a", "b").distinct(), "closure")
    new = found
    for _ in range(most_rounds):
        left = new.join(found.select(F.col("a").alias("m"), F.col("b").alias("z")), F.col("b") == F.col("m")).select("a", F.col("z").alias("b"))
        right = found.join(new.select(F.col("a").alias("m"), F.col("b").alias("z")), F.col("b") == F.col("m")).select("a", F.col("z").alias("b"))
        new = written(left.union(right).distinct().join(found, ["a", "b"], "left_anti"), "closure")
        if new.isEmpty():
            return found
        found = written(found.union(new), "closure")
    raise RuntimeError("the closure did not settle")


def connected_components(edges: DataFrame, most_rounds: int = 64, rows: int | None = None) -> DataFrame:
    """(node, label): the least node of each component, by label propagation with pointer jumping. rows: number of edges, if known."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", None if rows is None else 2 * rows)
    most = both.count()  # of nodes
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels", most)
    for _ in range(most_rounds):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        above = lower.select(F.col("node").alias("top"), F.col("label").alias("next"))
        step = written(lower.join(above, F.col("label") == F.col("top")).select("node", "old", F.least("label", "next").alias("label")), "labels", most)
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("the components did not settle")


def same_as_pairs(same: DataFrame) -> DataFrame:
    """All ordered pairs of different terms that owl:sameAs links (s, o) connect, by components.

    The closure of equality without pairwise iteration; only the result itself is quadratic in a clique.
    """
    labels = connected_components(same.where("s <> o").select(F.col("s").alias("a"), F.col("o").alias("b")))
    # The members are few beside their pairs: the left ones are dealt out, so that no task makes all pairs of a clique.
    parts = int(same.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).repartition(parts, "label", "salt")
    right = labels.select(F.col("node").alias("o"), "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).repartition(parts, "label", "salt")
    return left.join(right, ["label", "salt"]).where("node <> o").select(F.col("node").alias("s"), "o")
