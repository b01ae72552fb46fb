"""RDF collections as a relation (head, pos, member, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.terms import FIRST, NIL, REST, name
from lodestar.sources.shared import written

#: Predicates whose objects are list heads.
LISTED = [name(f"owl:{p}") for p in "intersectionOf unionOf oneOf members distinctMembers propertyChainAxiom hasKey".split()]
SCHEMA = "head string, pos int, member string, size int"


def list_table(triples: DataFrame) -> DataFrame:
    """Members of every list that a list-valued predicate names, numbered from 0, by pointer doubling.

    A list ends at rdf:nil or where a cell or its rest is missing; a head without a first cell has no members.
    Of several firsts or rests of a cell the least counts. A cell that comes round again ends the list.
    """
    spark = triples.sparkSession
    heads = triples.where(F.col("p").isin(LISTED) & (F.col("o") != NIL)).select(F.col("o").alias("head")).distinct()
    cells = triples.where(F.col("p") == FIRST).groupBy("s").agg(F.min("o").alias("member"))
    if cells.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    step = triples.where((F.col("p") == REST) & (F.col("o") != NIL)).groupBy("s").agg(F.min("o").alias("t"))
    step = written(step.join(cells.select(F.col("s").alias("t")), "t", "left_semi"), "steps")
    reach = written(heads.join(cells.select(F.col("s").alias("head")), "head", "left_semi").select("head", F.col("head").alias("cell"), F.lit(0).alias("pos")), "reach")
    size, stride = reach.count(), 1
    while True:
        further = reach.join(step, reach["cell"] == step["s"]).select("head", F.col("t").alias("cell"), (F.col("pos") + stride).alias("pos"))
        reach = written(reach.unionByName(further).groupBy("head", "cell").agg(F.min("pos").alias("pos")), "reach")
        grown = reach.count()
        if grown == size:
            break
        size, stride = grown, 2 * stride
        ahead = step.select(F.col("s").alias("t"), F.col("t").alias("u"))
        step = written(step.join(ahead, "t").select("s", F.col("u").alias("t")), "steps")
    members = reach.join(cells, reach["cell"] == cells["s"]).select("head", "pos", "member")
    sizes = members.groupBy("head").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return written(members.join(sizes, "head").select("head", "pos", "member", "size"), "lists")
