"""The reasoner's queries, one or more for each rule, and their DuckDB oracles.

A case names its lifts, schema triples and lists; Spark applies the rule to that graph, and the
oracle is written against the same graph as a table t(s, p, o), independently of the rule's clause. Rules that only
mark a contradiction return what contradicts (because).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.terms import FALSE as FALSE_TRIPLE
from lodestar.functions.terms import SAME, literal, name
from lodestar.operators import graphs
from lodestar.operators.lists import list_table
from lodestar.plans import engine
from lodestar.plans.axioms import axioms as owl_axioms
from lodestar.plans.rules import CLAUSES
from lodestar.sources import lift
from lodestar.sources.shared import written


def ex(local: str) -> str:
    return f"<ex:{local}>"


def triples(text: str) -> list[tuple[str, str, str]]:
    """Lines of three words; words with a known prefix or <...> are terms, "0" and "1" cardinalities."""
    term = lambda w: w if w.startswith(("<", "_:")) else literal(w.strip('"'), "xsd:nonNegativeInteger") if w.startswith('"') else name(w)
    return [tuple(term(w) for w in line.split()) for line in text.strip().split("\n")]


@dataclass
class Case:
    rule: str
    lifts: list[str]
    schema: list[tuple[str, str, str]]
    sql: str
    lists: dict[str, list[str]] = field(default_factory=dict)
    because: bool = False
    fixpoint: bool = False

    def run(self, spark, sf_dir: str) -> DataFrame:
        t = lift.graph(spark, sf_dir, self.lifts, self.schema, self.lists)
        if self.fixpoint:
            rules = self.rule.split()
            return engine.Reasoner(spark, [c for c in CLAUSES if c.id in rules], most_rounds=60).infer(t)
        lists = list_table(t) if self.lists else None
        found = engine.apply_once(t, self.rule, lists, premises=self.because)
        if self.because:
            say = F.transform("premises", lambda x: F.concat_ws(" ", x["s"], x["p"], x["o"]))
            return found.select("s", "p", "o", F.array_join(say, " . ").alias("because")).distinct()
        return found

    def oracle(self) -> str:
        return f"{lift.graph_sql(self.lifts, self.schema, self.lists)} {lift.terms_in(self.sql)}"


FALSE = "'@owl:Thing' AS s, '@rdfs:subClassOf' AS p, '@owl:Nothing' AS o"
A, B, C, D, E, G = (f"concat({x}.s, ' ', {x}.p, ' ', {x}.o)" for x in "abcdef")
NOT_LITERAL = "NOT starts_with({}, '\"')"


def why(*parts: str) -> str:
    return f"SELECT DISTINCT {FALSE}, concat({", ' . ', ".join(parts)}) AS because"


COMMON_RESTRICTION = triples("<ex:R> owl:onProperty <ex:placedBy>")
PLACES = triples("<ex:locatedIn> rdf:type owl:TransitiveProperty\n<ex:locatedIn> rdfs:domain <ex:Located>\n<ex:Located> rdfs:subClassOf <ex:Place>")
RESTRICTIONS = triples(
    "<ex:R1> owl:onProperty <ex:p1>\n<ex:R2> owl:onProperty <ex:p2>\n<ex:R3> owl:onProperty <ex:p1>\n<ex:p1> rdfs:subPropertyOf <ex:p2>\n<ex:p3> rdfs:subPropertyOf <ex:p1>\n<ex:R4> owl:onProperty <ex:p3>"
)
FILLERS = "{r}\n<ex:F1> rdfs:subClassOf <ex:F2>\n<ex:F2> rdfs:subClassOf <ex:F3>"
CARD = "<ex:R> owl:onProperty <ex:suppliedBy>\n<ex:R> owl:{kind} \"{n}\""
TYPED_LITERALS = "lit AS (SELECT DISTINCT s AS l, split_part(substr(s, 2), '\"', 1) AS lex, CAST(split_part(substr(s, 2), '\"', 1) AS BIGINT) AS v FROM t WHERE p = '@rdf:type' AND starts_with(s, '\"'))"
SIZE_TYPES = [(literal(str(n), "xsd:integer"), name("rdf:type"), name("xsd:integer")) for n in range(1, 51)] + [(literal(f"{n:03}", "xsd:short"), name("rdf:type"), name("xsd:short")) for n in range(1, 51, 2)]




CASES: dict[str, Case] = {
    # equality
    "eq_ref": Case("eq-ref", ["placed_by", "called"], [], "SELECT DISTINCT x AS s, '@owl:sameAs' AS p, x AS o FROM (SELECT s AS x FROM t UNION SELECT p FROM t UNION SELECT o FROM t WHERE NOT starts_with(o, '\"'))"),
    "eq_sym": Case("eq-sym", ["copies"], [], "SELECT DISTINCT o AS s, p, s AS o FROM t WHERE p = '@owl:sameAs'"),
    "eq_trans": Case("eq-trans", ["copies"], triples("<ex:doc/0> owl:sameAs <ex:zero>\n<ex:zero> owl:sameAs <ex:nil>\n<ex:zero> owl:sameAs <ex:doc/0>"), "SELECT DISTINCT a.s AS s, a.p AS p, b.o AS o FROM t a JOIN t b ON a.o = b.s AND a.p = b.p WHERE a.p = '@owl:sameAs' AND a.s <> b.o"),
    "eq_rep_s": Case("eq-rep-s", ["copies", "doc_lang"], [], "SELECT DISTINCT a.o AS s, b.p AS p, b.o AS o FROM t a JOIN t b ON a.s = b.s WHERE a.p = '@owl:sameAs' AND a.s <> a.o"),
    "eq_rep_o": Case("eq-rep-o", ["placed_by"], triples("<ex:cust/1> owl:sameAs <ex:me>\n<ex:cust/2> owl:sameAs <ex:you>\n<ex:cust/4> owl:sameAs <ex:them>\n<ex:cust/4> owl:sameAs <ex:cust/4>"), "SELECT DISTINCT b.s AS s, b.p AS p, a.o AS o FROM t a JOIN t b ON a.s = b.o WHERE a.p = '@owl:sameAs' AND a.s <> a.o"),
    "eq_diff1": Case("eq-diff1", ["copies", "first_differs"], triples("<ex:a> owl:sameAs <ex:b>\n<ex:b> owl:differentFrom <ex:a>\n<ex:c> owl:sameAs <ex:d>\n<ex:c> owl:differentFrom <ex:d>"), f"{why(A, B)} FROM t a JOIN t b ON (a.s = b.s AND a.o = b.o) OR (a.s = b.o AND a.o = b.s) WHERE a.p = '@owl:sameAs' AND b.p = '@owl:differentFrom'", because=True),
    "eq_diff2": Case("eq-diff2", ["copies"], triples("<ex:all> owl:members <ex:L>\n<ex:x> owl:sameAs <ex:z>\n<ex:all2> owl:members <ex:L2>"), f"{why(A, B)} FROM t a JOIN lst x ON a.o = x.head JOIN lst y ON a.o = y.head AND x.pos <> y.pos JOIN t b ON b.p = '@owl:sameAs' AND b.s = x.member AND b.o = y.member WHERE a.p = '@owl:members'", lists={ex("L"): [ex("x"), ex("y"), ex("z")], ex("L2"): [ex("x")]}, because=True),
    "eq_diff3": Case("eq-diff3", ["copies"], triples("<ex:all> owl:distinctMembers <ex:L>\n<ex:z> owl:sameAs <ex:x>"), f"{why(A, B)} FROM t a JOIN lst x ON a.o = x.head JOIN lst y ON a.o = y.head AND x.pos <> y.pos JOIN t b ON b.p = '@owl:sameAs' AND b.s = x.member AND b.o = y.member WHERE a.p = '@owl:distinctMembers'", lists={ex("L"): [ex("x"), ex("y"), ex("z")]}, because=True),
    # properties
    "prp_dom": Case("prp-dom", ["placed_by", "has_part"], triples("<ex:placedBy> rdfs:domain <ex:Order>\n<ex:hasPart> rdfs:domain <ex:Basket>"), "SELECT DISTINCT b.s AS s, '@rdf:type' AS p, a.o AS o FROM t a JOIN t b ON b.p = a.s WHERE a.p = '@rdfs:domain'"),
    "prp_rng": Case("prp-rng", ["placed_by", "size"], triples("<ex:placedBy> rdfs:range <ex:Customer>\n<ex:size> rdfs:range <ex:Size>"), "SELECT DISTINCT b.o AS s, '@rdf:type' AS p, a.o AS o FROM t a JOIN t b ON b.p = a.s WHERE a.p = '@rdfs:range' AND NOT starts_with(b.o, '\"')"),
    "prp_symp": Case("prp-symp", ["borders", "called"], triples("<ex:borders> rdf:type owl:SymmetricProperty\n<ex:called> rdf:type owl:SymmetricProperty"), "SELECT DISTINCT b.o AS s, b.p AS p, b.s AS o FROM t a JOIN t b ON b.p = a.s WHERE a.p = '@rdf:type' AND a.o = '@owl:SymmetricProperty' AND NOT starts_with(b.o, '\"')"),
    "prp_asyp": Case("prp-asyp", ["borders", "back_border"], triples("<ex:borders> rdf:type owl:AsymmetricProperty"), f"{why(A, B, C)} FROM t a JOIN t b ON b.p = a.s JOIN t c ON c.p = b.p AND c.s = b.o AND c.o = b.s WHERE a.p = '@rdf:type' AND a.o = '@owl:AsymmetricProperty'", because=True),
    "prp_irp": Case("prp-irp", ["borders", "self_border"], triples("<ex:borders> rdf:type owl:IrreflexiveProperty"), f"{why(A, B)} FROM t a JOIN t b ON b.p = a.s AND b.s = b.o WHERE a.p = '@rdf:type' AND a.o = '@owl:IrreflexiveProperty'", because=True),
    "prp_rflx": Case("prp-rflx", ["nation_thing"], triples("<ex:near> rdf:type owl:ReflexiveProperty\n<ex:like> rdf:type owl:ReflexiveProperty"), "SELECT DISTINCT b.s AS s, a.s AS p, b.s AS o FROM t a, t b WHERE a.p = '@rdf:type' AND a.o = '@owl:ReflexiveProperty' AND b.p = '@rdf:type' AND b.o = '@owl:Thing'"),
    "prp_spo1": Case("prp-spo1", ["placed_by", "has_part"], triples("<ex:placedBy> rdfs:subPropertyOf <ex:relatedTo>\n<ex:hasPart> rdfs:subPropertyOf <ex:relatedTo>"), "SELECT DISTINCT b.s AS s, a.o AS p, b.o AS o FROM t a JOIN t b ON b.p = a.s WHERE a.p = '@rdfs:subPropertyOf'"),
    "prp_eqp1": Case("prp-eqp1", ["placed_by"], triples("<ex:placedBy> owl:equivalentProperty <ex:buyer>"), "SELECT DISTINCT b.s AS s, a.o AS p, b.o AS o FROM t a JOIN t b ON b.p = a.s WHERE a.p = '@owl:equivalentProperty'"),
    "prp_eqp2": Case("prp-eqp2", ["placed_by"], triples("<ex:buyer> owl:equivalentProperty <ex:placedBy>"), "SELECT DISTINCT b.s AS s, a.s AS p, b.o AS o FROM t a JOIN t b ON b.p = a.o WHERE a.p = '@owl:equivalentProperty'"),
    "prp_inv1": Case("prp-inv1", ["has_part"], triples("<ex:hasPart> owl:inverseOf <ex:partOf>"), "SELECT DISTINCT b.o AS s, a.o AS p, b.s AS o FROM t a JOIN t b ON b.p = a.s WHERE a.p = '@owl:inverseOf' AND NOT starts_with(b.o, '\"')"),
    "prp_inv2": Case("prp-inv2", ["has_part"], triples("<ex:partOf> owl:inverseOf <ex:hasPart>"), "SELECT DISTINCT b.o AS s, a.s AS p, b.s AS o FROM t a JOIN t b ON b.p = a.o WHERE a.p = '@owl:inverseOf' AND NOT starts_with(b.o, '\"')"),
    "prp_trp": Case("prp-trp", ["next_turn", "borders"], triples("<ex:nextTurn> rdf:type owl:TransitiveProperty\n<ex:borders> rdf:type owl:TransitiveProperty"), "SELECT DISTINCT b.s AS s, b.p AS p, c.o AS o FROM t a JOIN t b ON b.p = a.s JOIN t c ON c.p = a.s AND c.s = b.o WHERE a.p = '@rdf:type' AND a.o = '@owl:TransitiveProperty' AND b.s <> c.o"),
    "prp_spo2": Case("prp-spo2", ["placed_by", "cust_nation", "region_member"], triples("<ex:orderedFrom> owl:propertyChainAxiom <ex:L>\n<ex:soldTo> owl:propertyChainAxiom <ex:L3>\n<ex:one> owl:propertyChainAxiom <ex:L1>"), "SELECT DISTINCT a.s AS s, '<ex:orderedFrom>' AS p, b.o AS o FROM t a JOIN t b ON a.o = b.s WHERE a.p = '<ex:placedBy>' AND b.p = '<ex:locatedIn>' UNION SELECT a.s, '<ex:soldTo>', c.o FROM t a JOIN t b ON a.o = b.s JOIN t c ON b.o = c.s WHERE a.p = '<ex:placedBy>' AND b.p = '<ex:locatedIn>' AND c.p = '<ex:inRegion>'", lists={ex("L"): [ex("placedBy"), ex("locatedIn")], ex("L3"): [ex("placedBy"), ex("locatedIn"), ex("inRegion")], ex("L1"): [ex("placedBy")]}),
    "prp_fp": Case("prp-fp", ["digest_source", "digest_source_name"], triples("<ex:source> rdf:type owl:FunctionalProperty\n<ex:sourceName> rdf:type owl:FunctionalProperty"), "SELECT DISTINCT b.o AS s, '@owl:sameAs' AS p, c.o AS o FROM t a JOIN t b ON b.p = a.s JOIN t c ON c.p = a.s AND c.s = b.s AND b.o < c.o WHERE a.p = '@rdf:type' AND a.o = '@owl:FunctionalProperty' AND NOT (starts_with(b.o, '\"') AND starts_with(c.o, '\"'))"),
    "prp_fp_dif": Case("prp-fp-dif", ["region_member", "regions_differ"], triples("<ex:inRegion> rdf:type owl:FunctionalProperty"), "SELECT DISTINCT x.s AS s, '@owl:differentFrom' AS p, y.s AS o FROM t a JOIN t d ON d.p = '@owl:differentFrom' JOIN t x ON x.p = a.s AND x.o = d.s JOIN t y ON y.p = a.s AND y.o = d.o WHERE a.p = '@rdf:type' AND a.o = '@owl:FunctionalProperty' AND x.s <> y.s"),
    "prp_ifp": Case("prp-ifp", ["digest"], triples("<ex:digest> rdf:type owl:InverseFunctionalProperty"), "SELECT DISTINCT b.s AS s, '@owl:sameAs' AS p, c.s AS o FROM t a JOIN t b ON b.p = a.s JOIN t c ON c.p = a.s AND c.o = b.o AND b.s < c.s WHERE a.p = '@rdf:type' AND a.o = '@owl:InverseFunctionalProperty'"),
    "prp_ifp_dif": Case("prp-ifp-dif", ["region_member", "nations_differ"], triples("<ex:inRegion> rdf:type owl:InverseFunctionalProperty"), "SELECT DISTINCT x.o AS s, '@owl:differentFrom' AS p, y.o AS o FROM t a JOIN t d ON d.p = '@owl:differentFrom' JOIN t x ON x.p = a.s AND x.s = d.s JOIN t y ON y.p = a.s AND y.s = d.o WHERE a.p = '@rdf:type' AND a.o = '@owl:InverseFunctionalProperty' AND x.o <> y.o"),
    "prp_pdw": Case("prp-pdw", ["likes", "dislikes"], triples("<ex:likes> owl:propertyDisjointWith <ex:dislikes>"), "SELECT DISTINCT CASE WHEN b.o = c.o THEN '@owl:Thing' ELSE b.o END AS s, CASE WHEN b.o = c.o THEN '@rdfs:subClassOf' ELSE '@owl:differentFrom' END AS p, CASE WHEN b.o = c.o THEN '@owl:Nothing' ELSE c.o END AS o FROM t a JOIN t b ON b.p = a.s JOIN t c ON c.p = a.o AND c.s = b.s WHERE a.p = '@owl:propertyDisjointWith'"),
    "prp_adp": Case("prp-adp", ["likes", "dislikes"], triples("<ex:n> rdf:type owl:AllDisjointProperties\n<ex:n> owl:members <ex:L>"), f"SELECT DISTINCT {FALSE}, concat(a.s, ' ', a.p, ' ', a.o, ' . ', b.s, ' ', b.p, ' ', b.o, ' . ', c.s, ' ', c.p, ' ', c.o, ' . ', d.s, ' ', d.p, ' ', d.o) AS because FROM t a JOIN t b ON b.s = a.s JOIN lst x ON x.head = b.o JOIN lst y ON y.head = b.o AND x.pos < y.pos JOIN t c ON c.p = x.member JOIN t d ON d.p = y.member AND d.s = c.s AND d.o = c.o WHERE a.o = '@owl:AllDisjointProperties' AND b.p = '@owl:members' UNION SELECT c.o, '@owl:differentFrom', d.o, concat({A}, ' . ', {B}, ' . ', {C}, ' . ', {D}) FROM t a JOIN t b ON b.s = a.s JOIN lst x ON x.head = b.o JOIN lst y ON y.head = b.o AND x.pos < y.pos JOIN t c ON c.p = x.member JOIN t d ON d.p = y.member AND d.s = c.s AND d.o <> c.o WHERE a.o = '@owl:AllDisjointProperties' AND b.p = '@owl:members'", lists={ex("L"): [ex("likes"), ex("dislikes")]}, because=True),
    "prp_key": Case("prp-key", ["digest", "doc_lang", "doc_type"], triples("<ex:Document> owl:hasKey <ex:L>"), "SELECT DISTINCT x.s AS s, '@owl:sameAs' AS p, y.s AS o FROM t x JOIN t y ON x.s < y.s AND x.p = '<ex:digest>' AND y.p = x.p AND x.o = y.o JOIN t k ON k.s = x.s AND k.p = '<ex:lang>' JOIN t m ON m.s = y.s AND m.p = k.p AND m.o = k.o", lists={ex("L"): [ex("digest"), ex("lang")]}),
    "prp_key_empty": Case("prp-key", ["nation_type"], triples("<ex:NationOf/0> owl:hasKey rdf:nil"), "SELECT DISTINCT a.s AS s, '@owl:sameAs' AS p, b.s AS o FROM t a JOIN t b ON a.o = b.o AND a.p = b.p AND a.s < b.s WHERE a.p = '@rdf:type' AND a.o = '<ex:NationOf/0>'"),
    "prp_npa1": Case("prp-npa1", ["not_border", "npa_source", "npa_border", "npa_p_border", "borders"], [], f"{why(A, B, C, D, E)} FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:sourceIndividual' JOIN t c ON c.s = a.s AND c.p = '@owl:assertionProperty' JOIN t d ON d.s = a.s AND d.p = '@owl:targetIndividual' JOIN t e ON e.s = b.o AND e.p = c.o AND e.o = d.o WHERE a.o = '@owl:NegativePropertyAssertion'", because=True),
    "prp_npa2": Case("prp-npa2", ["not_border", "npa_source", "npa_name", "npa_p_name", "called"], [], f"{why(A, B, C, D, E)} FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:sourceIndividual' JOIN t c ON c.s = a.s AND c.p = '@owl:assertionProperty' JOIN t d ON d.s = a.s AND d.p = '@owl:targetValue' JOIN t e ON e.s = b.o AND e.p = c.o AND split_part(e.o, '\"', 2) = split_part(d.o, '\"', 2) WHERE a.o = '@owl:NegativePropertyAssertion'", because=True),
    "scm_chain_trans": Case("scm-chain-trans", ["next_turn"], triples("<ex:nextTurn> owl:propertyChainAxiom <ex:L>\n<ex:borders> owl:propertyChainAxiom <ex:M>\n<ex:near> owl:propertyChainAxiom <ex:N>"), "SELECT DISTINCT a.s AS s, '@rdf:type' AS p, '@owl:TransitiveProperty' AS o FROM t a JOIN lst x ON x.head = a.o JOIN lst y ON y.head = a.o WHERE a.p = '@owl:propertyChainAxiom' AND x.size = 2 AND x.pos = 0 AND y.pos = 1 AND x.member = a.s AND y.member = a.s", lists={ex("L"): [ex("nextTurn")] * 2, ex("M"): [ex("borders"), ex("near")], ex("N"): [ex("near")] * 3}),
    # classes
    "cls_nothing2": Case("cls-nothing2", ["nation_nothing"], [], f"{why(A)} FROM t a WHERE a.p = '@rdf:type' AND a.o = '@owl:Nothing'", because=True),
    "cls_int1": Case("cls-int1", ["good", "toxic", "doc_type"], triples("<ex:Odd> owl:intersectionOf <ex:L>\n<ex:None> owl:intersectionOf rdf:nil"), "SELECT s, '@rdf:type' AS p, '<ex:Odd>' AS o FROM t WHERE p = '@rdf:type' AND o IN ('<ex:HighQuality>', '<ex:Toxic>') GROUP BY s HAVING count(DISTINCT o) = 2", lists={ex("L"): [ex("HighQuality"), ex("Toxic")]}),
    "cls_int2": Case("cls-int2", ["good"], triples("<ex:HighQuality> owl:intersectionOf <ex:L>"), "SELECT DISTINCT b.s AS s, b.p AS p, x.member AS o FROM t a JOIN lst x ON x.head = a.o JOIN t b ON b.o = a.s AND b.p = '@rdf:type' WHERE a.p = '@owl:intersectionOf'", lists={ex("L"): [ex("Readable"), ex("Clean")]}),
    "cls_uni": Case("cls-uni", ["good", "toxic"], triples("<ex:Labelled> owl:unionOf <ex:L>"), "SELECT DISTINCT b.s AS s, b.p AS p, a.s AS o FROM t a JOIN lst x ON x.head = a.o JOIN t b ON b.o = x.member AND b.p = '@rdf:type' WHERE a.p = '@owl:unionOf'", lists={ex("L"): [ex("HighQuality"), ex("Toxic")]}),
    "cls_com": Case("cls-com", ["good", "toxic"], triples("<ex:HighQuality> owl:complementOf <ex:Toxic>"), f"{why(A, B, C)} FROM t a JOIN t b ON b.o = a.s JOIN t c ON c.o = a.o AND c.s = b.s WHERE a.p = '@owl:complementOf' AND b.p = '@rdf:type' AND c.p = '@rdf:type'", because=True),
    "cls_svf1": Case("cls-svf1", ["region_member", "borders", "nation_type"], triples("<ex:R> owl:onProperty <ex:borders>\n<ex:R> owl:someValuesFrom <ex:NationOf/2>"), "SELECT DISTINCT x.s AS s, '@rdf:type' AS p, a.s AS o FROM t a JOIN t b ON a.s = b.s JOIN t x ON x.p = b.o JOIN t y ON y.s = x.o AND y.p = '@rdf:type' AND y.o = a.o WHERE a.p = '@owl:someValuesFrom' AND b.p = '@owl:onProperty' AND a.o <> '@owl:Thing'"),
    "cls_svf2": Case("cls-svf2", ["placed_by"], [*COMMON_RESTRICTION, *triples("<ex:R> owl:someValuesFrom owl:Thing")], "SELECT DISTINCT x.s AS s, '@rdf:type' AS p, a.s AS o FROM t a JOIN t b ON a.s = b.s JOIN t x ON x.p = b.o WHERE a.p = '@owl:someValuesFrom' AND a.o = '@owl:Thing' AND b.p = '@owl:onProperty'"),
    "cls_avf": Case("cls-avf", ["placed_by", "order_type"], triples("<ex:Status/O> owl:onProperty <ex:placedBy>\n<ex:Status/O> owl:allValuesFrom <ex:Waiting>"), "SELECT DISTINCT x.o AS s, '@rdf:type' AS p, a.o AS o FROM t a JOIN t b ON a.s = b.s JOIN t c ON c.o = a.s AND c.p = '@rdf:type' JOIN t x ON x.p = b.o AND x.s = c.s WHERE a.p = '@owl:allValuesFrom' AND b.p = '@owl:onProperty' AND NOT starts_with(x.o, '\"')"),
    "cls_hv1": Case("cls-hv1", ["order_type"], triples("<ex:Status/F> owl:onProperty <ex:state>\n<ex:Status/F> owl:hasValue <ex:final>"), "SELECT DISTINCT c.s AS s, b.o AS p, a.o AS o FROM t a JOIN t b ON a.s = b.s JOIN t c ON c.o = a.s AND c.p = '@rdf:type' WHERE a.p = '@owl:hasValue' AND b.p = '@owl:onProperty'"),
    "cls_hv2": Case("cls-hv2", ["status"], [(ex("Open"), name("owl:onProperty"), ex("status")), (ex("Open"), name("owl:hasValue"), literal("O"))], "SELECT DISTINCT c.s AS s, '@rdf:type' AS p, a.s AS o FROM t a JOIN t b ON a.s = b.s JOIN t c ON c.p = b.o AND c.o = a.o WHERE a.p = '@owl:hasValue' AND b.p = '@owl:onProperty'"),
    "cls_oo": Case("cls-oo", ["nation_region"], [(ex("Few"), name("owl:oneOf"), ex("L"))], "SELECT DISTINCT x.member AS s, '@rdf:type' AS p, a.s AS o FROM t a JOIN lst x ON x.head = a.o WHERE a.p = '@owl:oneOf' AND NOT starts_with(x.member, '\"')", lists={ex("L"): [ex("nation/1"), ex("nation/2"), literal("three")]}),
    "cls_maxc1": Case("cls-maxc1", ["has_supp", "order_type"], triples(CARD.format(kind="maxCardinality", n=0).replace("<ex:R>", "<ex:Status/P>")), f"{why(A, B, C, D)} FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:onProperty' JOIN t c ON c.o = a.s AND c.p = '@rdf:type' JOIN t d ON d.p = b.o AND d.s = c.s WHERE a.p = '@owl:maxCardinality' AND split_part(a.o, '\"', 2) = '0'", because=True),
    "cls_maxc2": Case("cls-maxc2", ["has_supp", "order_type"], triples(CARD.format(kind="maxCardinality", n=1).replace("<ex:R>", "<ex:Status/P>")), "SELECT DISTINCT d.o AS s, '@owl:sameAs' AS p, e.o AS o FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:onProperty' JOIN t c ON c.o = a.s AND c.p = '@rdf:type' JOIN t d ON d.p = b.o AND d.s = c.s JOIN t e ON e.p = b.o AND e.s = c.s AND d.o < e.o WHERE a.p = '@owl:maxCardinality' AND split_part(a.o, '\"', 2) = '1'"),
    "cls_maxqc1": Case("cls-maxqc1", ["borders", "nation_type"], triples('<ex:NationOf/1> owl:onProperty <ex:borders>\n<ex:NationOf/1> owl:maxQualifiedCardinality "0"\n<ex:NationOf/1> owl:onClass <ex:NationOf/2>'), f"{why(A, B, C, D, E, G)} FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:onProperty' JOIN t c ON c.s = a.s AND c.p = '@owl:onClass' JOIN t d ON d.o = a.s AND d.p = '@rdf:type' JOIN t e ON e.p = b.o AND e.s = d.s JOIN t f ON f.s = e.o AND f.p = '@rdf:type' AND f.o = c.o WHERE a.p = '@owl:maxQualifiedCardinality' AND split_part(a.o, '\"', 2) = '0' AND c.o <> '@owl:Thing'", because=True),
    "cls_maxqc2": Case("cls-maxqc2", ["borders", "nation_type"], triples('<ex:NationOf/1> owl:onProperty <ex:borders>\n<ex:NationOf/1> owl:maxQualifiedCardinality "0"\n<ex:NationOf/1> owl:onClass owl:Thing'), f"{why(A, B, C, D, E)} FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:onProperty' JOIN t c ON c.s = a.s AND c.p = '@owl:onClass' AND c.o = '@owl:Thing' JOIN t d ON d.o = a.s AND d.p = '@rdf:type' JOIN t e ON e.p = b.o AND e.s = d.s WHERE a.p = '@owl:maxQualifiedCardinality' AND split_part(a.o, '\"', 2) = '0'", because=True),
    "cls_maxqc3": Case("cls-maxqc3", ["borders", "back_border", "self_border", "nation_type"], triples('<ex:NationOf/1> owl:onProperty <ex:borders>\n<ex:NationOf/1> owl:maxQualifiedCardinality "1"\n<ex:NationOf/1> owl:onClass <ex:NationOf/2>\n<ex:nation/0> rdf:type <ex:NationOf/2>'), "SELECT DISTINCT e.o AS s, '@owl:sameAs' AS p, g.o AS o FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:onProperty' JOIN t c ON c.s = a.s AND c.p = '@owl:onClass' JOIN t d ON d.o = a.s AND d.p = '@rdf:type' JOIN t e ON e.p = b.o AND e.s = d.s JOIN t f ON f.s = e.o AND f.p = '@rdf:type' AND f.o = c.o JOIN t g ON g.p = b.o AND g.s = d.s AND e.o < g.o JOIN t h ON h.s = g.o AND h.p = '@rdf:type' AND h.o = c.o WHERE a.p = '@owl:maxQualifiedCardinality' AND split_part(a.o, '\"', 2) = '1' AND c.o <> '@owl:Thing'"),
    "cls_maxqc4": Case("cls-maxqc4", ["has_supp", "order_type"], triples('<ex:Status/P> owl:onProperty <ex:suppliedBy>\n<ex:Status/P> owl:maxQualifiedCardinality "1"\n<ex:Status/P> owl:onClass owl:Thing'), "SELECT DISTINCT d.o AS s, '@owl:sameAs' AS p, e.o AS o FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:onProperty' JOIN t q ON q.s = a.s AND q.p = '@owl:onClass' AND q.o = '@owl:Thing' JOIN t c ON c.o = a.s AND c.p = '@rdf:type' JOIN t d ON d.p = b.o AND d.s = c.s JOIN t e ON e.p = b.o AND e.s = c.s AND d.o < e.o WHERE a.p = '@owl:maxQualifiedCardinality' AND split_part(a.o, '\"', 2) = '1'"),
    # class axioms
    "cax_sco": Case("cax-sco", ["brand", "brand_class", "maker_class"], [], "SELECT DISTINCT b.s AS s, b.p AS p, a.o AS o FROM t a JOIN t b ON b.o = a.s AND b.p = '@rdf:type' WHERE a.p = '@rdfs:subClassOf'"),
    "cax_eqc1": Case("cax-eqc1", ["brand", "brand_equal"], [], "SELECT DISTINCT b.s AS s, b.p AS p, a.o AS o FROM t a JOIN t b ON b.o = a.s AND b.p = '@rdf:type' WHERE a.p = '@owl:equivalentClass'"),
    "cax_eqc2": Case("cax-eqc2", ["good"], triples("<ex:Fine> owl:equivalentClass <ex:HighQuality>"), "SELECT DISTINCT b.s AS s, b.p AS p, a.s AS o FROM t a JOIN t b ON b.o = a.o AND b.p = '@rdf:type' WHERE a.p = '@owl:equivalentClass'"),
    "cax_dw": Case("cax-dw", ["good", "toxic"], triples("<ex:HighQuality> owl:disjointWith <ex:Toxic>"), f"{why(A, B, C)} FROM t a JOIN t b ON b.o = a.s JOIN t c ON c.o = a.o AND c.s = b.s WHERE a.p = '@owl:disjointWith' AND b.p = '@rdf:type' AND c.p = '@rdf:type'", because=True),
    "cax_adc": Case("cax-adc", ["good", "toxic"], triples("<ex:n> rdf:type owl:AllDisjointClasses\n<ex:n> owl:members <ex:L>"), f"{why(A, B, C, D)} FROM t a JOIN t b ON b.s = a.s AND b.p = '@owl:members' JOIN lst x ON x.head = b.o JOIN lst y ON y.head = b.o AND x.pos < y.pos JOIN t c ON c.o = x.member AND c.p = '@rdf:type' JOIN t d ON d.o = y.member AND d.p = '@rdf:type' AND d.s = c.s WHERE a.o = '@owl:AllDisjointClasses'", lists={ex("L"): [ex("HighQuality"), ex("Toxic"), ex("Other")]}, because=True),
    # schema
    "scm_cls": Case("scm-cls", ["brand_decl"], [], "SELECT s, '@rdfs:subClassOf' AS p, s AS o FROM t UNION SELECT s, '@owl:equivalentClass', s FROM t UNION SELECT s, '@rdfs:subClassOf', '@owl:Thing' FROM t UNION SELECT '@owl:Nothing', '@rdfs:subClassOf', s FROM t"),
    "scm_op": Case("scm-op", ["placed_by"], triples("<ex:placedBy> rdf:type owl:ObjectProperty"), "SELECT s, '@rdfs:subPropertyOf' AS p, s AS o FROM t WHERE o = '@owl:ObjectProperty' UNION SELECT s, '@owl:equivalentProperty', s FROM t WHERE o = '@owl:ObjectProperty'"),
    "scm_dp": Case("scm-dp", ["size"], triples("<ex:size> rdf:type owl:DatatypeProperty"), "SELECT s, '@rdfs:subPropertyOf' AS p, s AS o FROM t WHERE o = '@owl:DatatypeProperty' UNION SELECT s, '@owl:equivalentProperty', s FROM t WHERE o = '@owl:DatatypeProperty'"),
    "scm_eqc1": Case("scm-eqc1", ["brand_equal"], [], "SELECT s, '@rdfs:subClassOf' AS p, o FROM t UNION SELECT o, '@rdfs:subClassOf', s FROM t"),
    "scm_eqc2": Case("scm-eqc2", ["brand_class", "maker_class"], triples("<ex:Product> rdfs:subClassOf <ex:Maker/1>\n<ex:Product> rdfs:subClassOf <ex:Product>"), "SELECT DISTINCT a.s AS s, '@owl:equivalentClass' AS p, a.o AS o FROM t a JOIN t b ON a.s = b.o AND a.o = b.s AND a.p = b.p WHERE a.p = '@rdfs:subClassOf'"),
    "scm_eqp1": Case("scm-eqp1", ["placed_by"], triples("<ex:placedBy> owl:equivalentProperty <ex:buyer>"), "SELECT s, '@rdfs:subPropertyOf' AS p, o FROM t WHERE p = '@owl:equivalentProperty' UNION SELECT o, '@rdfs:subPropertyOf', s FROM t WHERE p = '@owl:equivalentProperty'"),
    "scm_eqp2": Case("scm-eqp2", ["placed_by"], triples("<ex:a> rdfs:subPropertyOf <ex:b>\n<ex:b> rdfs:subPropertyOf <ex:a>\n<ex:b> rdfs:subPropertyOf <ex:c>"), "SELECT DISTINCT a.s AS s, '@owl:equivalentProperty' AS p, a.o AS o FROM t a JOIN t b ON a.s = b.o AND a.o = b.s AND a.p = b.p WHERE a.p = '@rdfs:subPropertyOf'"),
    "scm_sco": Case("scm-sco", ["brand_class", "maker_class"], triples("<ex:Product> rdfs:subClassOf <ex:Maker/1>"), "SELECT DISTINCT a.s AS s, a.p AS p, b.o AS o FROM t a JOIN t b ON a.o = b.s AND a.p = b.p WHERE a.p = '@rdfs:subClassOf' AND a.s <> b.o"),
    "scm_spo": Case("scm-spo", ["placed_by"], triples("<ex:a> rdfs:subPropertyOf <ex:b>\n<ex:b> rdfs:subPropertyOf <ex:a>\n<ex:b> rdfs:subPropertyOf <ex:c>"), "SELECT DISTINCT a.s AS s, a.p AS p, b.o AS o FROM t a JOIN t b ON a.o = b.s AND a.p = b.p WHERE a.p = '@rdfs:subPropertyOf' AND a.s <> b.o"),
    "scm_dom1": Case("scm-dom1", ["brand_class", "maker_class"], triples("<ex:made> rdfs:domain <ex:Brand#11>\n<ex:sold> rdfs:domain <ex:Maker/2>"), "SELECT DISTINCT a.s AS s, a.p AS p, b.o AS o FROM t a JOIN t b ON b.s = a.o AND b.p = '@rdfs:subClassOf' WHERE a.p = '@rdfs:domain'"),
    "scm_dom2": Case("scm-dom2", ["placed_by"], triples("<ex:relatedTo> rdfs:domain <ex:Order>\n<ex:placedBy> rdfs:subPropertyOf <ex:relatedTo>"), "SELECT DISTINCT b.s AS s, a.p AS p, a.o AS o FROM t a JOIN t b ON b.o = a.s AND b.p = '@rdfs:subPropertyOf' WHERE a.p = '@rdfs:domain'"),
    "scm_rng1": Case("scm-rng1", ["brand_class", "maker_class"], triples("<ex:made> rdfs:range <ex:Brand#11>\n<ex:sold> rdfs:range <ex:Maker/2>"), "SELECT DISTINCT a.s AS s, a.p AS p, b.o AS o FROM t a JOIN t b ON b.s = a.o AND b.p = '@rdfs:subClassOf' WHERE a.p = '@rdfs:range'"),
    "scm_rng2": Case("scm-rng2", ["placed_by"], triples("<ex:relatedTo> rdfs:range <ex:Agent>\n<ex:placedBy> rdfs:subPropertyOf <ex:relatedTo>"), "SELECT DISTINCT b.s AS s, a.p AS p, a.o AS o FROM t a JOIN t b ON b.o = a.s AND b.p = '@rdfs:subPropertyOf' WHERE a.p = '@rdfs:range'"),
    "scm_int": Case("scm-int", ["nation_type"], triples("<ex:Odd> owl:intersectionOf <ex:L>"), "SELECT DISTINCT a.s AS s, '@rdfs:subClassOf' AS p, x.member AS o FROM t a JOIN lst x ON x.head = a.o WHERE a.p = '@owl:intersectionOf'", lists={ex("L"): [ex("NationOf/1"), ex("NationOf/2"), ex("NationOf/3")]}),
    "scm_uni": Case("scm-uni", ["nation_type"], triples("<ex:Any> owl:unionOf <ex:L>"), "SELECT DISTINCT x.member AS s, '@rdfs:subClassOf' AS p, a.s AS o FROM t a JOIN lst x ON x.head = a.o WHERE a.p = '@owl:unionOf'", lists={ex("L"): [ex(f"NationOf/{i}") for i in range(5)]}),
    "scm_hv": Case("scm-hv", ["nation_type"], [*RESTRICTIONS, *triples("<ex:R1> owl:hasValue <ex:v>\n<ex:R2> owl:hasValue <ex:v>\n<ex:R3> owl:hasValue <ex:w>\n<ex:R4> owl:hasValue <ex:v>")], "SELECT DISTINCT a.s AS s, '@rdfs:subClassOf' AS p, b.s AS o FROM t a JOIN t b ON a.o = b.o AND a.p = b.p AND a.s <> b.s JOIN t c ON c.s = a.s AND c.p = '@owl:onProperty' JOIN t d ON d.s = b.s AND d.p = '@owl:onProperty' JOIN t e ON e.s = c.o AND e.o = d.o AND e.p = '@rdfs:subPropertyOf' WHERE a.p = '@owl:hasValue'"),
    "scm_svf1": Case("scm-svf1", ["nation_type"], [*RESTRICTIONS, *triples("<ex:R1> owl:someValuesFrom <ex:F1>\n<ex:R3> owl:someValuesFrom <ex:F2>\n<ex:R5> owl:someValuesFrom <ex:F1>\n<ex:R5> owl:onProperty <ex:p1>\n<ex:F1> rdfs:subClassOf <ex:F2>")], "SELECT DISTINCT a.s AS s, '@rdfs:subClassOf' AS p, b.s AS o FROM t a JOIN t b ON a.p = b.p AND a.s <> b.s JOIN t c ON c.s = a.s AND c.p = '@owl:onProperty' JOIN t d ON d.s = b.s AND d.p = c.p AND d.o = c.o WHERE a.p = '@owl:someValuesFrom' AND (a.o = b.o OR EXISTS (SELECT 1 FROM t e WHERE e.s = a.o AND e.o = b.o AND e.p = '@rdfs:subClassOf'))"),
    "scm_svf2": Case("scm-svf2", ["nation_type"], [*RESTRICTIONS, *triples("<ex:R1> owl:someValuesFrom <ex:F1>\n<ex:R2> owl:someValuesFrom <ex:F1>\n<ex:R4> owl:someValuesFrom <ex:F1>")], "SELECT DISTINCT a.s AS s, '@rdfs:subClassOf' AS p, b.s AS o FROM t a JOIN t b ON a.o = b.o AND a.p = b.p AND a.s <> b.s JOIN t c ON c.s = a.s AND c.p = '@owl:onProperty' JOIN t d ON d.s = b.s AND d.p = '@owl:onProperty' JOIN t e ON e.s = c.o AND e.o = d.o AND e.p = '@rdfs:subPropertyOf' WHERE a.p = '@owl:someValuesFrom'"),
    "scm_avf1": Case("scm-avf1", ["nation_type"], [*RESTRICTIONS, *triples("<ex:R1> owl:allValuesFrom <ex:F1>\n<ex:R3> owl:allValuesFrom <ex:F2>\n<ex:F1> rdfs:subClassOf <ex:F2>")], "SELECT DISTINCT a.s AS s, '@rdfs:subClassOf' AS p, b.s AS o FROM t a JOIN t b ON a.p = b.p AND a.s <> b.s JOIN t c ON c.s = a.s AND c.p = '@owl:onProperty' JOIN t d ON d.s = b.s AND d.p = c.p AND d.o = c.o JOIN t e ON e.s = a.o AND e.o = b.o AND e.p = '@rdfs:subClassOf' WHERE a.p = '@owl:allValuesFrom'"),
    "scm_avf2": Case("scm-avf2", ["nation_type"], [*RESTRICTIONS, *triples("<ex:R1> owl:allValuesFrom <ex:F1>\n<ex:R2> owl:allValuesFrom <ex:F1>\n<ex:R4> owl:allValuesFrom <ex:F1>")], "SELECT DISTINCT b.s AS s, '@rdfs:subClassOf' AS p, a.s AS o FROM t a JOIN t b ON a.o = b.o AND a.p = b.p AND a.s <> b.s JOIN t c ON c.s = a.s AND c.p = '@owl:onProperty' JOIN t d ON d.s = b.s AND d.p = '@owl:onProperty' JOIN t e ON e.s = c.o AND e.o = d.o AND e.p = '@rdfs:subPropertyOf' WHERE a.p = '@owl:allValuesFrom'"),
    # datatypes
    "dt_type2": Case("dt-type2", ["size", "padded", "bad_size"], [], "SELECT DISTINCT o AS s, '@rdf:type' AS p, split_part(o, '^^', 2) AS o FROM t WHERE starts_with(o, '\"') AND (split_part(o, '^^', 2) <> '@xsd:byte' OR CAST(split_part(o, '\"', 2) AS BIGINT) <= 127)"),
    "dt_not_type": Case("dt-not-type", ["size"], [(literal(str(n), "xsd:integer"), name("rdf:type"), name(f"xsd:{d}")) for n, d in ((1, "string"), (2, "decimal"), (3, "boolean"), (4, "negativeInteger"), (5, "integer"))], f"SELECT DISTINCT {FALSE}, concat({A}, ' . ', a.o, ' @rdf:type @xsd:integer . ', {B}) AS because FROM t a JOIN t b ON b.s = a.o WHERE b.p = '@rdf:type' AND b.o IN ('@xsd:string', '@xsd:boolean')", because=True),
    "dt_eq": Case("dt-eq", ["nation_region"], SIZE_TYPES, f", {TYPED_LITERALS} SELECT DISTINCT least(x.l, y.l) AS s, '@owl:sameAs' AS p, greatest(x.l, y.l) AS o FROM lit x JOIN lit y ON x.v = y.v AND x.lex <> y.lex"),
    "dt_diff": Case("dt-diff", ["nation_region"], SIZE_TYPES, f", {TYPED_LITERALS} SELECT DISTINCT x.l AS s, '@owl:differentFrom' AS p, y.l AS o FROM lit x JOIN lit y ON x.v <> y.v AND x.l < y.l"),
    "dt_diff_functional": Case("dt-diff", ["digest_source_name"], triples("<ex:sourceName> rdf:type owl:FunctionalProperty"), f"{why(A, B, C)} FROM t a JOIN t b ON b.p = a.s JOIN t c ON c.p = a.s AND c.s = b.s AND b.o < c.o WHERE a.o = '@owl:FunctionalProperty'", because=True),
    # fixpoints
    "closure_trp": Case("prp-trp", ["cust_nation", "supp_nation", "nation_region", "next_turn"], triples("<ex:locatedIn> rdf:type owl:TransitiveProperty\n<ex:nextTurn> rdf:type owl:TransitiveProperty"), ", r AS (SELECT s, p, o FROM t WHERE p IN ('<ex:locatedIn>', '<ex:nextTurn>') UNION SELECT r.s, r.p, t.o FROM r JOIN t ON r.o = t.s AND r.p = t.p) SELECT s, p, o FROM r WHERE s <> o EXCEPT SELECT s, p, o FROM t", fixpoint=True),
    "closure_sco": Case("scm-sco cax-sco", ["brand", "brand_class", "maker_class"], triples("<ex:Product> rdfs:subClassOf <ex:Ware>"), ", c AS (SELECT s, o FROM t WHERE p = '@rdfs:subClassOf' UNION SELECT c.s, t.o FROM c JOIN t ON c.o = t.s AND t.p = '@rdfs:subClassOf') SELECT s, '@rdfs:subClassOf' AS p, o FROM c WHERE s <> o EXCEPT SELECT s, p, o FROM t UNION (SELECT t.s, t.p, c.o FROM t JOIN c ON t.o = c.s WHERE t.p = '@rdf:type')", fixpoint=True),
    "closure_geography": Case("prp-trp prp-dom cax-sco", ["cust_nation", "nation_region"], PLACES, ", r AS (SELECT s, p, o FROM t WHERE p = '<ex:locatedIn>' UNION SELECT r.s, r.p, t.o FROM r JOIN t ON r.o = t.s AND r.p = t.p) SELECT DISTINCT s, p, o FROM (SELECT * FROM r UNION SELECT s, '@rdf:type', c FROM r, (VALUES ('<ex:Located>'), ('<ex:Place>')) v(c)) EXCEPT SELECT s, p, o FROM t", fixpoint=True),
    "closure_same_as": Case("eq-sym eq-trans", ["copies"], [], "SELECT DISTINCT x.d AS s, '@owl:sameAs' AS p, y.d AS o FROM (SELECT s AS d, o AS g FROM t UNION SELECT o, o FROM t) x JOIN (SELECT s AS d, o AS g FROM t UNION SELECT o, o FROM t) y ON x.g = y.g AND x.d <> y.d EXCEPT SELECT s, p, o FROM t", fixpoint=True),
}


def same_as_components(spark, sf_dir: str) -> DataFrame:
    """The same closure as closure_same_as by components, without iterated pairs; the given pairs are included."""
    pairs = graphs.same_as_pairs(lift.lift(spark, sf_dir, "copies"))
    return pairs.select("s", F.lit(SAME).alias("p"), "o")


def transitive_by_doubling(spark, sf_dir: str) -> DataFrame:
    t = lift.lift(spark, sf_dir, "next_turn")
    return graphs.transitive_closure(t.select(F.col("s").alias("a"), F.col("o").alias("b"))).select(F.col("a").alias("s"), F.lit(ex("nextTurn")).alias("p"), F.col("b").alias("o"))


#: The whole reasoner runs with its default options on customers, suppliers, parts and places, which grow with the tables.
WORLD = ["cust_nation", "supp_nation", "nation_region", "brand", "brand_class", "maker_class"]
WORLD_SCHEMA = [
    *PLACES,
    *triples("<ex:locatedIn> owl:inverseOf <ex:contains>\n<ex:locatedIn> rdfs:subPropertyOf <ex:near>\n<ex:near> rdf:type owl:SymmetricProperty\n<ex:Place> owl:equivalentClass <ex:Site>\n<ex:Place> owl:disjointWith <ex:Product>"),
]
MARKED = ["good", "toxic"]
MARKED_SCHEMA = triples("<ex:HighQuality> owl:disjointWith <ex:Toxic>\n<ex:HighQuality> rdfs:subClassOf <ex:Readable>")
G = ["urn:g"]


def quads(spark, sf_dir: str, lifts: list[str], schema: list[tuple[str, str, str]]) -> DataFrame:
    """The lifts in graph urn:g, and a triple of another graph that no query may use."""
    own = lift.graph(spark, sf_dir, lifts, schema).select("s", "p", "o", F.lit("urn:g").alias("g"))
    other = spark.createDataFrame([(ex("region/0"), ex("locatedIn"), ex("elsewhere"), "urn:other")], "s string, p string, o string, g string")
    return own.unionByName(other)


def owl_closure(spark, sf_dir: str) -> DataFrame:
    """All that the rules infer."""
    return engine.OwlRlReasoner(spark).infer(quads(spark, sf_dir, WORLD, WORLD_SCHEMA), G)


def provenance_all(spark, sf_dir: str) -> DataFrame:
    """Each inferred triple and whether it is explained: it has premises, all of them seeds or inferred in earlier rounds."""
    found = written(engine.OwlRlReasoner(spark).provenance_all(quads(spark, sf_dir, WORLD, WORLD_SCHEMA), G), "provenance")
    each = found.select("s", "p", "o", "origin", "round", F.explode_outer("premises").alias("q"))
    earlier = found.select(F.col("s").alias("qs"), F.col("p").alias("qp"), F.col("o").alias("qo"), F.col("round").alias("before"))
    met = each.join(earlier, (F.col("q.s") == F.col("qs")) & (F.col("q.p") == F.col("qp")) & (F.col("q.o") == F.col("qo")), "left")
    inferred = (F.col("q.origin") == "inference") & (F.col("before") < F.col("round"))
    good = F.coalesce(F.when(F.col("q.origin").isin("source", "axiom"), F.col("before").isNull()).otherwise(inferred), F.lit(False))
    return met.groupBy("s", "p", "o", "origin").agg(F.bool_and(good).alias("explained"))


def provenance_for(spark, sf_dir: str) -> DataFrame:
    """What rests below one triple: a customer's region."""
    region = spark.sql(lift.terms_in("SELECT concat('<ex:region/', n_regionkey, '>') FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey = 1"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation")}).first()[0]
    found = engine.OwlRlReasoner(spark).provenance_for(quads(spark, sf_dir, WORLD, WORLD_SCHEMA), G, (ex("cust/1"), ex("locatedIn"), region))
    return found.select("s", "p", "o", "origin", "rule", "depth")


def report_all(spark, sf_dir: str) -> DataFrame:
    """A result for each inferred triple, with the verdict on the whole graph."""
    report = engine.OwlRlReasoner(spark).report_all(quads(spark, sf_dir, WORLD, WORLD_SCHEMA), G)
    return report.results.select("target_graph", "severity", "detail.s", "detail.p", "detail.o", F.lit(report.consistent).alias("consistent"), F.lit(report.marker_consistent).alias("marker_consistent"))


def report_for(spark, sf_dir: str) -> DataFrame:
    """The result for the mark of inconsistency, where documents of high quality are disjoint from toxic ones."""
    found = engine.OwlRlReasoner(spark).report_for(quads(spark, sf_dir, MARKED, MARKED_SCHEMA), G, FALSE_TRIPLE)
    return found.select("target_graph", "severity", "detail.s", "detail.p", "detail.o", "detail.rule")


def closure_sql() -> str:
    """Tables base (sources and axioms) and final (all that holds) of the world, each family of rules as its own recursion."""
    fixed = ", ".join("(" + ", ".join("'" + x + "'" for x in r) + ")" for r in owl_axioms())
    return lift.graph_sql(WORLD, WORLD_SCHEMA) + lift.terms_in(f""",
base AS (SELECT s, p, o FROM t UNION SELECT * FROM (VALUES {fixed}) v(s, p, o)),
kinds AS (SELECT s FROM base WHERE p = '@rdf:type' AND o = '@owl:Class'),
sub0 AS (SELECT s, o FROM base WHERE p IN ('@rdfs:subClassOf', '@owl:equivalentClass') UNION SELECT o, s FROM base WHERE p = '@owl:equivalentClass'
         UNION SELECT s, s FROM kinds UNION SELECT s, '@owl:Thing' FROM kinds UNION SELECT '@owl:Nothing', s FROM kinds),
sub AS (SELECT s, o FROM sub0 UNION SELECT sub.s, sub0.o FROM sub JOIN sub0 ON sub.o = sub0.s WHERE sub.s <> sub0.o),
equal AS (SELECT a.s, a.o FROM sub a JOIN sub b ON a.s = b.o AND a.o = b.s),
loc AS (SELECT s, o FROM base WHERE p = '<ex:locatedIn>' UNION SELECT loc.s, base.o FROM loc JOIN base ON base.p = '<ex:locatedIn>' AND base.s = loc.o WHERE loc.s <> base.o),
facts AS (SELECT s, '<ex:locatedIn>' AS p, o FROM loc UNION SELECT o, '<ex:contains>', s FROM loc UNION SELECT s, '<ex:near>', o FROM loc UNION SELECT o, '<ex:near>', s FROM loc),
dom AS (SELECT s, o FROM base WHERE p = '@rdfs:domain' UNION SELECT base.s, sub.o FROM base JOIN sub ON base.o = sub.s WHERE p = '@rdfs:domain'),
typed AS (SELECT s, o FROM base WHERE p = '@rdf:type' UNION SELECT facts.s, dom.o FROM facts JOIN dom ON facts.p = dom.s),
every AS (SELECT * FROM base UNION SELECT s, '@rdfs:subClassOf', o FROM sub UNION SELECT s, '@owl:equivalentClass', o FROM equal UNION SELECT * FROM facts
          UNION SELECT s, '@rdfs:domain', o FROM dom UNION SELECT s, '@rdf:type', o FROM typed UNION SELECT typed.s, '@rdf:type', sub.o FROM typed JOIN sub ON typed.o = sub.s),
final AS (SELECT * FROM every UNION SELECT x, '@owl:sameAs', x FROM (SELECT s AS x FROM every UNION SELECT p FROM every UNION SELECT o FROM every UNION SELECT '@owl:sameAs'))""")


def queries() -> dict:
    found = {k: c.run for k, c in CASES.items()}
    for f in (same_as_components, transitive_by_doubling, owl_closure, provenance_all, provenance_for, report_all, report_for):
        found[f.__name__] = f
    return found


def oracle_sql() -> dict:
    found = {k: c.oracle() for k, c in CASES.items()}
    turn = lift.graph_sql(["next_turn"], [])
    found["transitive_by_doubling"] = f"{turn}, r AS (SELECT s, p, o FROM t UNION SELECT r.s, r.p, t.o FROM r JOIN t ON r.o = t.s) SELECT s, p, o FROM r"
    groups = "(SELECT s AS d, o AS g FROM t UNION SELECT o, o FROM t)"
    found["same_as_components"] = lift.graph_sql(["copies"], []) + lift.terms_in(f" SELECT DISTINCT x.d AS s, '@owl:sameAs' AS p, y.d AS o FROM {groups} x JOIN {groups} y ON x.g = y.g AND x.d <> y.d")
    inferred = "SELECT s, p, o FROM final EXCEPT SELECT s, p, o FROM base"
    found["owl_closure"] = f"{closure_sql()} {inferred}"
    found["provenance_all"] = f"{closure_sql()} SELECT s, p, o, 'inference' AS origin, true AS explained FROM ({inferred})"
    found["report_all"] = f"{closure_sql()} SELECT 'urn:g' AS target_graph, 'Info' AS severity, s, p, o, true AS consistent, true AS marker_consistent FROM ({inferred})"
    way = "t a JOIN t b ON a.o = b.s AND b.p = a.p WHERE a.s = '<ex:cust/1>' AND a.p = '<ex:locatedIn>'"
    found["provenance_for"] = lift.graph_sql(WORLD, WORLD_SCHEMA) + lift.terms_in(f"""
SELECT a.s, a.p, b.o, 'inference' AS origin, 'prp-trp' AS rule, 0 AS depth FROM {way} UNION ALL SELECT a.s, a.p, a.o, 'source', NULL, 1 FROM {way}
UNION ALL SELECT b.s, b.p, b.o, 'source', NULL, 1 FROM {way} UNION ALL SELECT s, p, o, 'source', NULL, 1 FROM t WHERE s = '<ex:locatedIn>' AND o = '@owl:TransitiveProperty'""")
    found["report_for"] = lift.graph_sql(MARKED, MARKED_SCHEMA) + lift.terms_in(f" SELECT DISTINCT 'urn:g' AS target_graph, 'Violation' AS severity, {FALSE}, 'cax-dw' AS rule FROM t a JOIN t b ON a.s = b.s WHERE a.o = '<ex:HighQuality>' AND b.o = '<ex:Toxic>'")
    return found


def entry(spark, sf_dir: str) -> DataFrame:
    return CASES["closure_geography"].run(spark, sf_dir)
