"""One application of each rule on small graphs: what must and what must not come out."""

import pytest

from lodestar.functions.terms import FALSE, literal, name
from lodestar.operators.lists import list_table
from lodestar.plans import rules
from lodestar.plans.axioms import axioms
from lodestar.plans.engine import apply_once
from lodestar.sources.lift import list_triples


def term(w):
    if w.startswith(("<", "_:")):
        return w
    if w.startswith('"'):
        lex, _, dt = w[1:].partition('"')
        return literal(lex, dt.lstrip("^") or "xsd:string")
    return name(w) if ":" in w else f"<{w}>"


def graph(text):
    return [tuple(map(term, part.split())) for part in text.split(" ; ") if part.strip()]


T, S = "rdf:type", "owl:sameAs"
# rule | graph | lists | expected | absent
CASES = [
    ("eq-ref", "a p b ; a p \"x\"", {}, f"a {S} a ; p {S} p ; b {S} b", f'"x" {S} "x"'),
    ("eq-sym", f"a {S} b", {}, f"b {S} a", ""),
    ("eq-trans", f"a {S} b ; b {S} c ; b {S} a", {}, f"a {S} c", f"a {S} a"),
    ("eq-rep-s", f"a {S} b ; a p c", {}, "b p c", ""),
    ("eq-rep-o", f"a {S} b ; c p a", {}, "c p b", ""),
    ("eq-diff1", f"a {S} b ; b owl:differentFrom a", {}, "FALSE", ""),
    ("eq-diff1", f"a {S} b ; a owl:differentFrom c", {}, "", "FALSE"),
    ("eq-diff2", f"n owl:members L ; b {S} a", {"L": "a b"}, "FALSE", ""),
    ("eq-diff2", "n owl:members L", {"L": "a"}, "", "FALSE"),
    ("eq-diff3", f"n owl:distinctMembers L ; a {S} b", {"L": "a c b"}, "FALSE", ""),
    ("prp-dom", "p rdfs:domain c ; x p y", {}, f"x {T} c", f"y {T} c"),
    ("prp-rng", 'p rdfs:range c ; x p y ; x p "z"', {}, f"y {T} c", f'"z" {T} c'),
    ("prp-symp", f'p {T} owl:SymmetricProperty ; x p y ; x p "z"', {}, "y p x", '"z" p x'),
    ("prp-asyp", f"p {T} owl:AsymmetricProperty ; x p y ; y p x", {}, "FALSE", ""),
    ("prp-asyp", f"p {T} owl:AsymmetricProperty ; x p y", {}, "", "FALSE"),
    ("prp-irp", f"p {T} owl:IrreflexiveProperty ; x p x", {}, "FALSE", ""),
    ("prp-rflx", f'p {T} owl:ReflexiveProperty ; _:b {T} owl:Thing ; "l" {T} owl:Thing', {}, "_:b p _:b", '"l" p "l"'),
    ("prp-trp", f"p {T} owl:TransitiveProperty ; x p y ; y p z ; y p x", {}, "x p z", "x p x"),
    ("prp-spo1", "p rdfs:subPropertyOf q ; x p y", {}, "x q y", ""),
    ("prp-spo2", "p owl:propertyChainAxiom L ; x a y ; y b z", {"L": "a b"}, "x p z", "x p y"),
    ("prp-spo2", "p owl:propertyChainAxiom L ; x a y", {"L": "a"}, "", "x p y"),
    ("prp-eqp1", "p owl:equivalentProperty q ; x p y", {}, "x q y", ""),
    ("prp-eqp2", "p owl:equivalentProperty q ; x q y", {}, "x p y", ""),
    ("prp-inv1", 'p owl:inverseOf q ; x p y ; x p "l"', {}, "y q x", '"l" q x'),
    ("prp-inv2", "p owl:inverseOf q ; x q y", {}, "y p x", ""),
    ("prp-fp", f'p {T} owl:FunctionalProperty ; x p y ; x p z ; w p "1" ; w p "2"', {}, f"y {S} z", f'"1" {S} "2" ; FALSE'),
    ("dt-diff", f'p {T} owl:FunctionalProperty ; w p "1" ; w p "2"', {}, "FALSE", ""),
    ("prp-fp-dif", f"p {T} owl:FunctionalProperty ; y p a ; z p b ; a owl:differentFrom b", {}, "y owl:differentFrom z", ""),
    ("prp-ifp", f"p {T} owl:InverseFunctionalProperty ; y p a ; z p a", {}, f"y {S} z", ""),
    ("prp-ifp-dif", f"p {T} owl:InverseFunctionalProperty ; y p a ; z p b ; y owl:differentFrom z", {}, "a owl:differentFrom b", ""),
    ("prp-pdw", "p owl:propertyDisjointWith q ; x p y ; x q y", {}, "FALSE", ""),
    ("prp-pdw", 'p owl:propertyDisjointWith q ; x p _:a ; x q _:b ; w p "1" ; w q "2"', {}, "_:a owl:differentFrom _:b", 'FALSE ; "1" owl:differentFrom "2"'),
    ("prp-adp", f"n {T} owl:AllDisjointProperties ; n owl:members L ; x p y ; x r y", {"L": "p q r"}, "FALSE", ""),
    ("prp-adp", "n owl:members L ; x p y ; x r y", {"L": "p q r"}, "", "FALSE"),
    ("prp-key", f'c owl:hasKey L ; x {T} c ; y {T} c ; x k "1" ; y k "1"^^xsd:int ; x m "2" ; y m "2"', {"L": "k m"}, f"x {S} y", ""),
    ("prp-key", f'c owl:hasKey L ; x {T} c ; y {T} c ; x k "1" ; y k "1" ; x m "2"', {"L": "k m"}, "", f"x {S} y"),
    ("prp-key", f"c owl:hasKey rdf:nil ; x {T} c ; y {T} c", {}, f"x {S} y", ""),
    ("prp-npa1", f"n {T} owl:NegativePropertyAssertion ; n owl:sourceIndividual x ; n owl:assertionProperty p ; n owl:targetIndividual y ; x p y", {}, "FALSE", ""),
    ("prp-npa2", f'n {T} owl:NegativePropertyAssertion ; n owl:sourceIndividual x ; n owl:assertionProperty p ; n owl:targetValue "1" ; x p "1"^^xsd:int', {}, "FALSE", ""),
    ("scm-chain-trans", "p owl:propertyChainAxiom L ; q owl:propertyChainAxiom M", {"L": "p p", "M": "q q q"}, f"p {T} owl:TransitiveProperty", f"q {T} owl:TransitiveProperty"),
    ("cls-nothing2", f"x {T} owl:Nothing", {}, "FALSE", ""),
    ("cls-int1", f"a owl:intersectionOf L ; x {T} b ; x {T} c ; y {T} b", {"L": "b c"}, f"x {T} a", f"y {T} a"),
    ("cls-int1", f"a owl:intersectionOf rdf:nil ; x {T} b", {}, "", f"x {T} a"),
    ("cls-int2", f"a owl:intersectionOf L ; x {T} a", {"L": "b c"}, f"x {T} b ; x {T} c", ""),
    ("cls-uni", f"a owl:unionOf L ; x {T} c", {"L": "b c"}, f"x {T} a", ""),
    ("cls-com", f"a owl:complementOf b ; x {T} a ; x {T} b", {}, "FALSE", ""),
    ("cls-svf1", f"r owl:someValuesFrom d ; r owl:onProperty p ; x p y ; y {T} d ; z p w", {}, f"x {T} r", f"z {T} r"),
    ("cls-svf2", "r owl:someValuesFrom owl:Thing ; r owl:onProperty p ; x p y", {}, f"x {T} r", ""),
    ("cls-avf", f'r owl:allValuesFrom d ; r owl:onProperty p ; x {T} r ; x p y ; x p "l"', {}, f"y {T} d", f'"l" {T} d'),
    ("cls-hv1", f"r owl:hasValue v ; r owl:onProperty p ; x {T} r", {}, "x p v", ""),
    ("cls-hv2", "r owl:hasValue v ; r owl:onProperty p ; x p v ; y p w", {}, f"x {T} r", f"y {T} r"),
    ("cls-maxc1", f'r owl:maxCardinality "0"^^xsd:int ; r owl:onProperty p ; x {T} r ; x p y', {}, "FALSE", ""),
    ("cls-maxc2", f'r owl:maxCardinality "1" ; r owl:onProperty p ; x {T} r ; x p y ; x p z', {}, f"y {S} z", ""),
    ("cls-maxqc1", f'r owl:maxQualifiedCardinality "0" ; r owl:onProperty p ; r owl:onClass d ; x {T} r ; x p y ; y {T} d', {}, "FALSE", ""),
    ("cls-maxqc2", f'r owl:maxQualifiedCardinality "0" ; r owl:onProperty p ; r owl:onClass owl:Thing ; x {T} r ; x p y', {}, "FALSE", ""),
    ("cls-maxqc3", f'r owl:maxQualifiedCardinality "1" ; r owl:onProperty p ; r owl:onClass d ; x {T} r ; x p y ; x p z ; x p w ; y {T} d ; z {T} d', {}, f"y {S} z", f"w {S} y ; w {S} z"),
    ("cls-maxqc4", f'r owl:maxQualifiedCardinality "1" ; r owl:onProperty p ; r owl:onClass owl:Thing ; x {T} r ; x p y ; x p z', {}, f"y {S} z", ""),
    ("cls-oo", "a owl:oneOf L", {"L": 'x y "l"'}, f"x {T} a ; y {T} a", f'"l" {T} a'),
    ("cax-sco", f"a rdfs:subClassOf b ; x {T} a", {}, f"x {T} b", ""),
    ("cax-eqc1", f"a owl:equivalentClass b ; x {T} a", {}, f"x {T} b", ""),
    ("cax-eqc2", f"a owl:equivalentClass b ; x {T} b", {}, f"x {T} a", ""),
    ("cax-dw", f"a owl:disjointWith b ; x {T} a ; x {T} b", {}, "FALSE", ""),
    ("cax-adc", f"n {T} owl:AllDisjointClasses ; n owl:members L ; x {T} a ; x {T} c", {"L": "a b c"}, "FALSE", ""),
    ("cax-adc", f"n {T} owl:AllDisjointClasses ; n owl:members L ; x {T} a", {"L": "a b c"}, "", "FALSE"),
    ("scm-cls", f"a {T} owl:Class", {}, "a rdfs:subClassOf a ; a owl:equivalentClass a ; a rdfs:subClassOf owl:Thing ; owl:Nothing rdfs:subClassOf a", ""),
    ("scm-op", f"p {T} owl:ObjectProperty", {}, "p rdfs:subPropertyOf p ; p owl:equivalentProperty p", ""),
    ("scm-dp", f"p {T} owl:DatatypeProperty", {}, "p rdfs:subPropertyOf p ; p owl:equivalentProperty p", ""),
    ("scm-eqc1", "a owl:equivalentClass b", {}, "a rdfs:subClassOf b ; b rdfs:subClassOf a", ""),
    ("scm-eqc2", "a rdfs:subClassOf b ; b rdfs:subClassOf a ; b rdfs:subClassOf c", {}, "a owl:equivalentClass b", "b owl:equivalentClass c"),
    ("scm-eqp1", "a owl:equivalentProperty b", {}, "a rdfs:subPropertyOf b ; b rdfs:subPropertyOf a", ""),
    ("scm-eqp2", "a rdfs:subPropertyOf b ; b rdfs:subPropertyOf a", {}, "a owl:equivalentProperty b", ""),
    ("scm-sco", "a rdfs:subClassOf b ; b rdfs:subClassOf c ; b rdfs:subClassOf a", {}, "a rdfs:subClassOf c", "a rdfs:subClassOf a"),
    ("scm-spo", "a rdfs:subPropertyOf b ; b rdfs:subPropertyOf c", {}, "a rdfs:subPropertyOf c", ""),
    ("scm-dom1", "p rdfs:domain a ; a rdfs:subClassOf b", {}, "p rdfs:domain b", ""),
    ("scm-dom2", "q rdfs:domain a ; p rdfs:subPropertyOf q", {}, "p rdfs:domain a", ""),
    ("scm-rng1", "p rdfs:range a ; a rdfs:subClassOf b", {}, "p rdfs:range b", ""),
    ("scm-rng2", "q rdfs:range a ; p rdfs:subPropertyOf q", {}, "p rdfs:range a", ""),
    ("scm-int", "a owl:intersectionOf L", {"L": "b c"}, "a rdfs:subClassOf b ; a rdfs:subClassOf c", ""),
    ("scm-uni", "a owl:unionOf L", {"L": "b c"}, "b rdfs:subClassOf a ; c rdfs:subClassOf a", ""),
    ("scm-hv", "c owl:hasValue v ; c owl:onProperty p ; d owl:hasValue v ; d owl:onProperty q ; p rdfs:subPropertyOf q", {}, "c rdfs:subClassOf d", "d rdfs:subClassOf c"),
    ("scm-svf1", "c owl:someValuesFrom e ; c owl:onProperty p ; d owl:someValuesFrom f ; d owl:onProperty p ; e rdfs:subClassOf f", {}, "c rdfs:subClassOf d", "d rdfs:subClassOf c ; c rdfs:subClassOf c"),
    ("scm-svf1", "c owl:someValuesFrom e ; c owl:onProperty p ; d owl:someValuesFrom e ; d owl:onProperty p ; g owl:someValuesFrom e ; g owl:onProperty q", {}, "c rdfs:subClassOf d ; d rdfs:subClassOf c", "c rdfs:subClassOf g"),
    ("scm-svf2", "c owl:someValuesFrom e ; c owl:onProperty p ; d owl:someValuesFrom e ; d owl:onProperty q ; p rdfs:subPropertyOf q", {}, "c rdfs:subClassOf d", "d rdfs:subClassOf c"),
    ("scm-avf1", "c owl:allValuesFrom e ; c owl:onProperty p ; d owl:allValuesFrom f ; d owl:onProperty p ; e rdfs:subClassOf f", {}, "c rdfs:subClassOf d", ""),
    ("scm-avf2", "c owl:allValuesFrom e ; c owl:onProperty p ; d owl:allValuesFrom e ; d owl:onProperty q ; p rdfs:subPropertyOf q", {}, "d rdfs:subClassOf c", "c rdfs:subClassOf d"),
    ("dt-type2", 'x p "5"^^xsd:int ; x p "abc"^^xsd:int ; x p "300"^^xsd:byte', {}, f'"5"^^xsd:int {T} xsd:int', f'"abc"^^xsd:int {T} xsd:int ; "300"^^xsd:byte {T} xsd:byte'),
    ("dt-not-type", f'x p "5"^^xsd:negativeInteger ; x p "-5"^^xsd:negativeInteger ; "-5"^^xsd:negativeInteger {T} xsd:nonNegativeInteger', {}, "FALSE", ""),
    ("dt-not-type", f'x p "1"^^xsd:int ; y p "1"^^xsd:string ; "1"^^xsd:int {T} xsd:decimal', {}, "", "FALSE"),
    ("dt-eq", f'"1"^^xsd:int {T} xsd:int ; "01"^^xsd:short {T} xsd:short ; "2"^^xsd:int {T} xsd:int', {}, f'"01"^^xsd:short {S} "1"^^xsd:int', f'"1"^^xsd:int {S} "2"^^xsd:int'),
    ("dt-diff", f'"1"^^xsd:int {T} xsd:int ; "2"^^xsd:int {T} xsd:int ; "2"^^xsd:decimal {T} xsd:decimal', {}, '"1"^^xsd:int owl:differentFrom "2"^^xsd:int', '"1"^^xsd:int owl:differentFrom "2"^^xsd:decimal'),
]


@pytest.mark.parametrize("rule,given,lists,expected,absent", CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_rule(spark, rule, given, lists, expected, absent):
    listed = {term(h): [term(m) for m in ms.split()] for h, ms in lists.items()}
    t = spark.createDataFrame([*graph(given), *list_triples(listed)], "s string, p string, o string")
    out = {tuple(r) for r in apply_once(t, rule, list_table(t) if lists else None).collect()}
    want = lambda text: {FALSE if part == "FALSE" else graph(part)[0] for part in text.split(" ; ") if part}
    assert want(expected) <= out
    assert not want(absent) & out


def test_every_rule_has_a_case():
    assert {c[0] for c in CASES} == set(rules.PRIORITY)


def test_tables():
    assert len(axioms()) == len(set(axioms())) == 75
    assert len(rules.DESCRIPTIONS) == 78
    assert len(rules.PRIORITY) == 77
    assert len(rules.VIOLATIONS) == 20
