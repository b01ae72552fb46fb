import pytest

from lodestar.functions.terms import literal
from lodestar.plans.catalog import triples
from lodestar.plans.engine import OwlRlReasoner
from lodestar.plans.entailment import Case, entails, parts, passes

COLUMNS = "s string, p string, o string"


def case(name, kind, premise, conclusion=""):
    return Case(name, kind, tuple(triples(premise)), tuple(triples(conclusion)) if conclusion else ())


FAMILY = "<ex:a> <ex:parent> <ex:b>\n<ex:b> <ex:parent> <ex:c>\n"
CASES = [
    case("transitive", "entails", FAMILY + "<ex:parent> rdfs:subPropertyOf <ex:ancestor>\n<ex:ancestor> rdf:type owl:TransitiveProperty", "<ex:a> <ex:ancestor> <ex:c>"),
    case("some_blank", "entails", FAMILY + "<ex:parent> rdfs:range <ex:Person>", "<ex:a> <ex:parent> _:x\n_:x rdf:type <ex:Person>\n_:x <ex:parent> _:y"),
    case("one_blank_two_ends", "entails_not", FAMILY, "_:x <ex:parent> _:x"),
    case("no_converse", "entails_not", "<ex:A> rdfs:subClassOf <ex:B>\n<ex:i> rdf:type <ex:B>", "<ex:i> rdf:type <ex:A>"),
    case("disjoint", "inconsistent", "<ex:A> owl:disjointWith <ex:B>\n<ex:i> rdf:type <ex:A>\n<ex:i> rdf:type <ex:B>"),
    case("irreflexive", "inconsistent", "<ex:p> rdf:type owl:IrreflexiveProperty\n<ex:i> <ex:p> <ex:i>"),
    case("apart", "consistent", "<ex:A> owl:disjointWith <ex:B>\n<ex:i> rdf:type <ex:A>\n<ex:j> rdf:type <ex:B>"),
    case("same", "entails", "<ex:p> rdf:type owl:FunctionalProperty\n<ex:i> <ex:p> <ex:x>\n<ex:i> <ex:p> <ex:y>\n<ex:y> <ex:q> <ex:z>", "<ex:x> <ex:q> _:z\n_:other owl:sameAs <ex:x>"),
]


@pytest.mark.parametrize("c", CASES, ids=lambda c: c.id)
def test_cases(spark, c):
    assert passes(OwlRlReasoner(spark, datatype_joins=False), c)


def test_conclusions(spark):
    t = spark.createDataFrame([("<a>", "<p>", "<b>"), ("<b>", "<q>", "<c>"), ("<d>", "<q>", literal("x"))], COLUMNS)
    assert entails(t, []) and entails(t, [("<a>", "<p>", "<b>")]) and not entails(t, [("<a>", "<p>", "<c>")])
    assert entails(t, [("_:x", "<p>", "_:y.1"), ("_:y.1", "<q>", "_:z")]) and not entails(t, [("_:x", "<p>", "_:y"), ("_:y", "<q>", literal("x"))])
    assert entails(t, [("_:x", "<p>", "_:y"), ("_:u", "<q>", literal("x"))])
    assert len(parts([("_:x", "<p>", "_:y"), ("_:u", "<q>", "_:v"), ("_:y", "<q>", "_:u"), ("<a>", "<p>", "<b>")])) == 2
    assert not entails(t.where("false"), [("_:x", "<p>", "_:y")])


def test_unknown_kinds_fail(spark):
    with pytest.raises(ValueError):
        passes(OwlRlReasoner(spark, equality_ref=False, datatype_value_space=False), Case("x", "maybe", (("<a>", "<b>", "<c>"),)))
