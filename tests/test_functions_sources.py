"""Terms, XSD values, lists, readers, graph operators and the stream."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import terms, xsd
from lodestar.functions.terms import literal, name
from lodestar.operators import graphs, lists
from lodestar.plans import rules
from lodestar.plans.engine import Reasoner
from lodestar.sources import lift, quads
from lodestar.streaming.incremental import materialise

VALUES = [
    ("5", "int", "integer", "5"), ("+05", "int", "integer", "5"), ("-0", "integer", "integer", "0"), (" 7 ", "long", "integer", "7"), ("0x10", "integer", "integer", None), ("", "integer", "integer", None),
    ("300", "byte", "integer", None), ("-129", "byte", "integer", None), ("-1", "nonNegativeInteger", "integer", None), ("18446744073709551615", "unsignedLong", "integer", "18446744073709551615"),
    ("18446744073709551616", "unsignedLong", "integer", None), ("1" * 45, "integer", "integer", "1" * 45), ("1" * 45, "long", "integer", None), ("+1.0", "decimal", "decimal", "1.0"), (".5", "decimal", "decimal", None),
    ("1e2", "double", "double", "100.0"), ("100", "double", "double", "100.0"), ("-0", "float", "float", "-0.0"), (" NaN", "float", "float", "NaN"), ("1e400", "double", "double", None), ("INF", "double", "double", "INF"), ("x", "double", "double", None),
    ("1", "boolean", "boolean", "true"), ("yes", "boolean", "boolean", None), ("aF", "hexBinary", "binary", "AF"), ("a b", "base64Binary", "binary", "ab"), ("2020-01-01", "date", "temporal", "2020-01-01"), ("a", "string", "string", "a"), ("a", "anyAtomicType", None, None),
]


def test_xsd_values(spark):
    df = spark.createDataFrame([(i, literal(lex, f"xsd:{dt}")) for i, (lex, dt, _, _) in enumerate(VALUES)], "i int, t string")
    got = {r.i: (r.k, r.c) for r in df.select("i", xsd.kind_of(F.col("t")).alias("k"), xsd.canonical(F.col("t")).alias("c")).collect()}
    assert got == {i: (k, c) for i, (_, _, k, c) in enumerate(VALUES)}
    staged = {r.i: (r.kind, r.canon) for r in xsd.with_values(df, "t").collect()}
    assert staged == {i: x for i, x in got.items() if x[1] is not None}


def test_values_equal_and_disjoint_types(spark):
    pairs = [(literal("1", "xsd:int"), literal("01", "xsd:short"), True), (literal("0", "xsd:float"), literal("-0", "xsd:float"), False), (literal("1", "xsd:int"), literal("1", "xsd:decimal"), None)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in df.select(xsd.values_equal(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]
    apart = set(xsd.disjoint_types())
    pair = lambda a, b: (name(f"xsd:{a}"), name(f"xsd:{b}")) in apart
    assert pair("negativeInteger", "unsignedByte") and pair("string", "int") and not pair("int", "double") and not pair("int", "long") and not pair("anyAtomicType", "int")


def test_terms(spark):
    df = spark.createDataFrame([("<a>",), ("_:b",), (literal('q"\n\\'),), (literal("x", language="en"),)], "t string")
    got = df.select(terms.is_literal(F.col("t")), terms.lexical(F.col("t")), terms.datatype(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(False, "<a>", None), (False, "_:b", None), (True, 'q\\"\\n\\\\', name("xsd:string")), (True, "x", None)]


def test_lists(spark):
    cell = lift.list_triples({"<L>": [f"<m{i}>" for i in range(11)], "<K>": ["<x>"]})
    heads = [("<c>", name("owl:unionOf"), h) for h in ("<L>", "<K>", "<missing>", terms.NIL)]
    loop = [("<d>", name("owl:oneOf"), "<Z>"), ("<Z>", terms.FIRST, "<z>"), ("<Z>", terms.REST, "<Z>")]
    got = {}
    for r in lists.list_table(spark.createDataFrame([*cell, *heads, *loop], "s string, p string, o string")).collect():
        got.setdefault(r.head, {})[r.pos] = r.member
    assert got == {"<L>": {i: f"<m{i}>" for i in range(11)}, "<K>": {0: "<x>"}, "<Z>": {0: "<z>"}}


def test_ntriples_and_index(spark, tmp_path):
    (tmp_path / "in.nt").write_text('# note\n<a> <p> "x\\" y" .\n_:b <p> "1"^^<http://www.w3.org/2001/XMLSchema#int> <g> . # end\n\n<a> <p> "z"@en .\n')
    q = quads.read_ntriples(spark, str(tmp_path / "in.nt"), "<d>")
    assert {tuple(r) for r in q.collect()} == {("<a>", "<p>", literal('x" y'), "<d>"), ("_:b", "<p>", literal("1", "xsd:int"), "<g>"), ("<a>", "<p>", '"z"@en', "<d>")}
    quads.write_ntriples(q, str(tmp_path / "out"))
    assert {tuple(r) for r in quads.read_ntriples(spark, str(tmp_path / "out"), "<d>").select("s", "p", "o").collect()} == {tuple(r)[:3] for r in q.collect()}
    quads.write_quads(q, str(tmp_path / "pq"), partition_by_predicate=True)
    assert quads.read_quads(spark, str(tmp_path / "pq")).count() == 3
    (tmp_path / "bad.nt").write_text("<a> <p> .\n")
    with pytest.raises(Exception, match="not a triple"):
        quads.read_ntriples(spark, str(tmp_path / "bad.nt")).collect()
    index = quads.QuadIndex(q)
    assert index.objects("<p>", "<a>").count() == 2 and index.has("<p>", "_:b", "1") and not index.has("<p>", "_:b", "2")
    assert [r.s for r in index.subjects("<p>", '"z"@en').collect()] == ["<a>"] and index.pairs("<p>").count() == 3
    assert index.add(spark.createDataFrame([("<a>", "<q>", "<c>")], "s string, p string, o string")).objects_for_subject("<a>", "<q>").count() == 1


def test_closure_and_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (21, 20)], "a int, b int")
    assert {tuple(r) for r in graphs.transitive_closure(e).collect()} == {(i, j) for i in range(9) for j in range(i + 1, 10)} | {(20, 20), (20, 21), (21, 20), (21, 21)}
    assert {r.node: r.label for r in graphs.connected_components(e).collect()} == {i: 0 for i in range(10)} | {20: 20, 21: 20}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "s string, p string, o string"
    r = Reasoner(spark, [c for c in rules.CLAUSES if c.id == "eq-trans"])
    for batch in ([("<a>", terms.SAME, "<b>")], [("<b>", terms.SAME, "<c>")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        materialise(r, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [(x.s, x.o) for x in spark.read.parquet(str(tmp_path / "out/inferred")).collect()] == [("<a>", "<c>")]
