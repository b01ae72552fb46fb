"""Special rules over what is new, against the same rules over everything; keys with several values."""

import random

import pytest

from lodestar.functions.terms import literal, name
from lodestar.operators import special
from lodestar.operators.lists import list_table
from lodestar.sources.lift import list_triples

TYPE = name("rdf:type")


def ex(x):
    return f"<ex:{x}>"


def graph(seed):
    r = random.Random(seed)
    schema = [(ex("C"), special.KEY, ex("K")), (ex("D"), special.KEY, name("rdf:nil")), (ex("p"), special.CHAIN, ex("L2")), (ex("q"), special.CHAIN, ex("L3")), (ex("I"), special.INTERSECTION, ex("M"))]
    schema += list_triples({ex("K"): [ex("k1"), ex("k2")], ex("L2"): [ex("e"), ex("f")], ex("L3"): [ex("e"), ex("e"), ex("f")], ex("M"): [ex("C"), ex("D")]})
    data = set()
    for i in range(12):
        data.add((ex(i), TYPE, ex("C")))
        if r.random() < 0.3:
            data.add((ex(i), TYPE, ex("D")))
        for k in ("k1", "k2"):
            data |= {(ex(i), ex(k), literal(str(r.randrange(3)))) for _ in range(r.randint(0, 2))}
        data |= {(ex(i), ex(r.choice("ef")), ex(r.randrange(12))) for _ in range(3)}
    data |= {(literal(x, d), TYPE, name(d2)) for x, d, d2 in (("1", "xsd:int", "xsd:int"), ("01", "xsd:short", "xsd:short"), ("2", "xsd:int", "xsd:string"))}
    data |= {(ex(3), ex("v"), literal("1", "xsd:int")), (ex(4), ex("v"), literal("2", "xsd:int"))}
    return schema, sorted(data)


def found(df):
    return {tuple(x[:3]) for x in df.select("s", "p", "o").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_new_triples_give_what_they_add(spark, seed):
    schema, data = graph(seed)
    random.Random(seed).shuffle(data)
    columns = "s string, p string, o string"
    old, new = spark.createDataFrame(schema + data[:-14], columns), spark.createDataFrame(data[-14:], columns)
    every = old.unionByName(new).cache()
    lists = list_table(every).cache()
    for rule, function, _ in [*special.RULES, *special.DATATYPE_RULES, *special.DATATYPE_JOINS]:
        whole, before, added = found(function(every, lists)), found(function(old, lists)), found(function(every, lists, new))
        assert whole - before <= added <= whole, rule


def test_keys_against_pairs(spark):
    schema, data = graph(5)
    every = spark.createDataFrame(schema + data, "s string, p string, o string")
    values = {}
    for s, p, o in data:
        values.setdefault((s, p), set()).add(o)
    typed = {c: sorted(s for s, p, o in data if p == TYPE and o == ex(c)) for c in "CD"}
    want = {(x, special.SAME, y) for x in typed["C"] for y in typed["C"] if x < y and all(values.get((x, ex(k)), set()) & values.get((y, ex(k)), set()) for k in ("k1", "k2"))}
    want |= {(x, special.SAME, y) for x in typed["D"] for y in typed["D"] if x < y}
    assert found(special.keys(every, list_table(every))) == want and want
