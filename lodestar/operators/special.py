"""Rules that no conjunctive query says: chains, keys, intersections and literals.

Each takes (triples, lists, new) and returns s, p, o, premises of its derivations over the whole graph, or, where new is
given (the triples that came last, among triples), at least of all that rest on one of these. Rules over schema triples that are
new themselves must be called without.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import xsd
from lodestar.functions.terms import DIFFERENT, FALSE, SAME, TYPE, is_literal, lexical, name
from lodestar.operators.match import PREMISES

CHAIN, KEY, INTERSECTION = (name(f"owl:{p}") for p in ("propertyChainAxiom", "hasKey", "intersectionOf"))


def triple(s, p, o) -> Column:
    of = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(of(s).alias("s"), of(p).alias("p"), of(o).alias("o"))


def result(df: DataFrame, s, p, o, *premises: Column) -> DataFrame:
    head = triple(s, p, o)
    return df.select(head["s"].alias("s"), head["p"].alias("p"), head["o"].alias("o"), F.array(*premises).cast(PREMISES).alias("premises"))


def subjects(new: DataFrame, as_: str) -> DataFrame:
    return new.select(F.col("s").alias(as_)).distinct()


def chains(t: DataFrame, lists: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """prp-spo2: paths grow by one property of their chain a step; chains of one property don't count.

    Paths start from their first edge, or from each new edge at each place, and grow to the right, then to the left.
    """
    axiom = t.where(F.col("p") == CHAIN).select(F.col("s").alias("chain_p"), F.col("o").alias("head"))
    links = axiom.join(lists.where("size >= 2"), "head")
    longest = links.agg(F.max("size")).first()[0] or 0
    edges = t.select(F.col("s").alias("a"), F.col("p").alias("member"), F.col("o").alias("b"))
    at = lambda pos: links.where(F.col("pos") == pos).select("chain_p", "head", "size", "member")
    edge = triple(F.col("a"), F.col("member"), F.col("b"))

    def started(pos: int) -> DataFrame:
        first = edges if new is None else new.select(F.col("s").alias("a"), F.col("p").alias("member"), F.col("o").alias("b"))
        return at(pos).join(first, "member").select("chain_p", "head", "size", F.col("a").alias("x"), F.col("b").alias("z"), F.array(edge).alias("why"))

    def grown(path: DataFrame, pos: int, right: bool) -> DataFrame:
        step = path.join(at(pos).drop("size"), ["chain_p", "head"]).join(edges, "member")
        if right:
            return step.where("z = a").select("chain_p", "head", "size", "x", F.col("b").alias("z"), F.concat("why", F.array(edge)).alias("why"))
        return step.where("x = b").select("chain_p", "head", "size", F.col("a").alias("x"), "z", F.concat(F.array(edge), "why").alias("why"))

    found = []
    for start in range(1 if new is None else longest):
        path, whole = started(start), []
        for pos in range(start + 1, longest + 1):
            whole.append(path.where(F.col("size") == pos))
            path = grown(path.where(F.col("size") > pos), pos, True) if pos < longest else path
        if whole:
            done = reduce(DataFrame.unionByName, whole)
            for pos in range(start - 1, -1, -1):
                done = grown(done, pos, False)
            found.append(done)
    if not found:
        return result(t.where("false"), F.col("s"), F.col("p"), F.col("o"))
    lead = F.array(triple(F.col("chain_p"), CHAIN, F.col("head")))
    return reduce(DataFrame.unionByName, found).select(F.col("x").alias("s"), F.col("chain_p").alias("p"), F.col("z").alias("o"), F.concat(lead, "why").cast(PREMISES).alias("premises"))


def keys(t: DataFrame, lists: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """prp-key: instances with a common lexical value of every key have a tuple of values in common.

    An instance has a tuple for each choice among its values of each key: one where they are single. Instances meet by
    whole tuples, so that no key of few values pairs them. The empty list of keys makes all instances of its class equal.
    """
    axiom = t.where(F.col("p") == KEY).select(F.col("s").alias("c"), F.col("o").alias("head"))
    instances = t.where(F.col("p") == TYPE).select(F.col("s").alias("x"), F.col("o").alias("c"))
    members = axiom.join(lists.select("head", "member").distinct(), "head")
    sizes = members.groupBy("c", "head").agg(F.count(F.lit(1)).alias("of"))
    values = t.select(F.col("s").alias("x"), F.col("p").alias("member"), lexical(F.col("o")).alias("v"), F.col("o").alias("term"))
    held = members.join(values, "member").join(instances, ["c", "x"]).groupBy("c", "head", "x", "member", "v").agg(F.min("term").alias("term"))
    choices = held.groupBy("c", "head", "x", "member").agg(F.sort_array(F.collect_list(F.struct("member", "v", "term"))).alias("choices"))
    whole = choices.groupBy("c", "head", "x").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("member", "choices"))).alias("keys")).join(sizes, ["c", "head"]).where("n = of")
    start = F.array(F.array().cast("array<struct<member:string,v:string,term:string>>"))
    longer = lambda done, key: F.flatten(F.transform(done, lambda d: F.transform(key["choices"], lambda e: F.concat(d, F.array(e)))))
    tuples = whole.select("c", "head", "x", F.explode_outer(F.aggregate("keys", start, longer)).alias("own"))
    tuples = tuples.select("c", "head", "x", "own", F.transform("own", lambda e: F.struct(e["member"], e["v"])).alias("tuple"))
    other = tuples.select("c", "head", "tuple", F.col("x").alias("y"), F.col("own").alias("theirs"))
    on = ["c", "head", "tuple"]
    if new is None:
        pairs = tuples.join(other, on).where("x < y")
    else:  # either instance has a new triple
        pairs = tuples.join(subjects(new, "x"), "x", "left_semi").join(other, on).where("x < y").unionByName(tuples.join(other.join(subjects(new, "y"), "y", "left_semi"), on).where("x < y"))
    lead = lambda: (triple(F.col("c"), KEY, F.col("head")), triple(F.col("x"), TYPE, F.col("c")), triple(F.col("y"), TYPE, F.col("c")))
    fact = lambda s: lambda e: triple(F.col(s), e["member"], e["term"])
    facts = F.sort_array(F.concat(F.transform("own", fact("x")), F.transform("theirs", fact("y"))))
    full = pairs.select(F.col("x").alias("s"), F.lit(SAME).alias("p"), F.col("y").alias("o"), F.concat(F.array(*lead()), facts).cast(PREMISES).alias("premises"))
    empty = axiom.join(lists.select("head").distinct(), "head", "left_anti")
    one, two = instances, instances.withColumnRenamed("x", "y")
    every = empty.join(one, "c").join(two, "c").where("x < y")
    if new is not None:
        every = empty.join(one.join(subjects(new, "x"), "x", "left_semi"), "c").join(two, "c").where("x < y").unionByName(empty.join(one, "c").join(two.join(subjects(new, "y"), "y", "left_semi"), "c").where("x < y"))
    return full.unionByName(result(every, F.col("x"), SAME, F.col("y"), *lead()))


def intersections(t: DataFrame, lists: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """cls-int1: a division: individuals typed by as many different members as the list has."""
    axiom = t.where(F.col("p") == INTERSECTION).select(F.col("s").alias("c"), F.col("o").alias("head"))
    members = axiom.join(lists.select("head", "member").distinct(), "head")
    sizes = members.groupBy("c", "head").agg(F.count(F.lit(1)).alias("of"))
    types = t.where(F.col("p") == TYPE).select(F.col("s").alias("x"), F.col("o").alias("member")).distinct()
    if new is not None:
        types = types.join(subjects(new.where(F.col("p") == TYPE), "x"), "x", "left_semi")
    typed = members.join(types, "member")
    found = typed.groupBy("c", "head", "x").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(triple(F.col("x"), TYPE, F.col("member")))).alias("facts"))
    full = found.join(sizes, ["c", "head"]).where("n = of")
    return full.select(F.col("x").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"), F.concat(F.array(triple(F.col("c"), INTERSECTION, F.col("head"))), F.col("facts")).cast(PREMISES).alias("premises"))


def literal_types(t: DataFrame, lists: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """dt-type2."""
    good = xsd.with_values(t if new is None else new, "o")
    return result(good, F.col("o"), TYPE, F.col("dt"), triple(F.col("s"), F.col("p"), F.col("o")))


def literal_clashes(t: DataFrame, lists: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """dt-not-type: the 1,400 or so disjoint pairs are a relation of fixed size."""
    apart = t.sparkSession.createDataFrame(xsd.disjoint_types(), "d1 string, d2 string")

    def met(used_in: DataFrame, typed_in: DataFrame) -> DataFrame:
        used = xsd.with_values(used_in, "o").select("s", "p", "o", F.col("dt").alias("d1"))
        typed = typed_in.where(is_literal(F.col("s")) & (F.col("p") == TYPE)).select(F.col("s").alias("lit"), F.col("o").alias("d2"))
        return used.join(typed, used["o"] == typed["lit"]).join(F.broadcast(apart), ["d1", "d2"])

    both = met(t, t) if new is None else met(new, t).unionByName(met(t, new))
    return result(both, *FALSE, triple(F.col("s"), F.col("p"), F.col("o")), triple(F.col("lit"), TYPE, F.col("d1")), triple(F.col("lit"), TYPE, F.col("d2")))


def _typed_literals(t: DataFrame) -> DataFrame:
    typed = t.where(is_literal(F.col("s")) & (F.col("p") == TYPE)).groupBy(F.col("s").alias("lit")).agg(F.min("o").alias("type"))
    return xsd.with_values(typed, "lit").select("lit", F.col("type").alias("dt"), "lex", "kind", "canon")


def _literal_pairs(t: DataFrame, new: DataFrame | None, on: list[str]) -> DataFrame:
    a = _typed_literals(t)
    b = a.select("kind", *(F.col(c).alias(f"{c}2") for c in ("lit", "dt", "lex")), F.col("canon").alias("canon" if "canon" in on else "canon2"))
    apart = "lit < lit2 AND lex <> lex2"
    if new is None:
        return a.join(b, on).where(apart)
    typed = new.where(is_literal(F.col("s")) & (F.col("p") == TYPE))
    return a.join(subjects(typed, "lit"), "lit", "left_semi").join(b, on).where(apart).unionByName(a.join(b.join(subjects(typed, "lit2"), "lit2", "left_semi"), on).where(apart))


def equal_literals(t: DataFrame, lists: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """dt-eq: literals meet by value, so only equal ones are paired."""
    met = _literal_pairs(t, new, ["kind", "canon"])
    return result(met, F.col("lit"), SAME, F.col("lit2"), triple(F.col("lit"), TYPE, F.col("dt")), triple(F.col("lit2"), TYPE, F.col("dt2")))


def different_literals(t: DataFrame, lists: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """dt-diff: its result is quadratic in the literals of a kind by definition."""
    met = _literal_pairs(t, new, ["kind"]).where("canon <> canon2")
    return result(met, F.col("lit"), DIFFERENT, F.col("lit2"), triple(F.col("lit"), TYPE, F.col("dt")), triple(F.col("lit2"), TYPE, F.col("dt2")))


#: id, function, constants that a graph must hold; None: any literal.
RULES = [
    ("prp-spo2", chains, [CHAIN]),
    ("prp-key", keys, [KEY]),
    ("cls-int1", intersections, [INTERSECTION]),
]
DATATYPE_RULES = [("dt-type2", literal_types, []), ("dt-not-type", literal_clashes, [])]
DATATYPE_JOINS = [("dt-eq", equal_literals, []), ("dt-diff", different_literals, [])]
