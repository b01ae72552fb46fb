"""The rules as conjunctive queries, one clause a line.

id: body ; guards => heads. A body joins triple patterns; [?l ?i ?m ?n] is element m at place i of list l with n
elements. Guards: res(x) not a literal, both_lit(a b), not_lits(a b), ne(a b), lt(a b) in term order, same(a b) and
other(a b) by lexical form, zero(k) and one(k). FALSE is the mark of inconsistency.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lodestar.functions.terms import FALSE, TYPE, name

DELTA_RULES = """
eq-ref: ?s ?p ?o => ?s owl:sameAs ?s . ?p owl:sameAs ?p
eq-ref: ?s ?p ?o ; res(?o) => ?o owl:sameAs ?o
eq-sym: ?x owl:sameAs ?y => ?y owl:sameAs ?x
eq-rep-s: ?x owl:sameAs ?y . ?x ?p ?v ; ne(?x ?y) => ?y ?p ?v
eq-rep-o: ?x owl:sameAs ?y . ?u ?p ?x ; ne(?x ?y) => ?u ?p ?y
eq-diff1: ?x owl:sameAs ?y . ?x owl:differentFrom ?y => FALSE
eq-diff1: ?x owl:sameAs ?y . ?y owl:differentFrom ?x => FALSE
prp-dom: ?p rdfs:domain ?c . ?x ?p ?y => ?x rdf:type ?c
prp-rng: ?p rdfs:range ?c . ?x ?p ?y ; res(?y) => ?y rdf:type ?c
prp-symp: ?p rdf:type owl:SymmetricProperty . ?x ?p ?y ; res(?y) => ?y ?p ?x
prp-irp: ?p rdf:type owl:IrreflexiveProperty . ?x ?p ?x => FALSE
prp-rflx: ?p rdf:type owl:ReflexiveProperty . ?x rdf:type owl:Thing ; res(?x) => ?x ?p ?x
prp-spo1: ?p rdfs:subPropertyOf ?q . ?x ?p ?y => ?x ?q ?y
prp-eqp1: ?p owl:equivalentProperty ?q . ?x ?p ?y => ?x ?q ?y
prp-eqp2: ?p owl:equivalentProperty ?q . ?x ?q ?y => ?x ?p ?y
prp-inv1: ?p owl:inverseOf ?q . ?x ?p ?y ; res(?y) => ?y ?q ?x
prp-inv2: ?p owl:inverseOf ?q . ?x ?q ?y ; res(?y) => ?y ?p ?x
cls-nothing2: ?x rdf:type owl:Nothing => FALSE
cls-int2: ?c owl:intersectionOf ?l . [?l ?i ?d ?n] . ?x rdf:type ?c => ?x rdf:type ?d
cls-uni: ?c owl:unionOf ?l . [?l ?i ?d ?n] . ?x rdf:type ?d => ?x rdf:type ?c
cls-com: ?c owl:complementOf ?d . ?x rdf:type ?c . ?x rdf:type ?d => FALSE
cls-svf2: ?c owl:someValuesFrom owl:Thing . ?c owl:onProperty ?p . ?x ?p ?y => ?x rdf:type ?c
cls-hv1: ?c owl:hasValue ?v . ?c owl:onProperty ?p . ?x rdf:type ?c => ?x ?p ?v
cls-hv2: ?c owl:hasValue ?v . ?c owl:onProperty ?p . ?x ?p ?v => ?x rdf:type ?c
cls-oo: ?c owl:oneOf ?l . [?l ?i ?m ?n] ; res(?m) => ?m rdf:type ?c
cax-sco: ?c rdfs:subClassOf ?d . ?x rdf:type ?c => ?x rdf:type ?d
cax-eqc1: ?c owl:equivalentClass ?d . ?x rdf:type ?c => ?x rdf:type ?d
cax-eqc2: ?c owl:equivalentClass ?d . ?x rdf:type ?d => ?x rdf:type ?c
cax-dw: ?c owl:disjointWith ?d . ?x rdf:type ?c . ?x rdf:type ?d => FALSE
scm-cls: ?c rdf:type owl:Class => ?c rdfs:subClassOf ?c . ?c owl:equivalentClass ?c . ?c rdfs:subClassOf owl:Thing . owl:Nothing rdfs:subClassOf ?c
scm-op: ?p rdf:type owl:ObjectProperty => ?p rdfs:subPropertyOf ?p . ?p owl:equivalentProperty ?p
scm-dp: ?p rdf:type owl:DatatypeProperty => ?p rdfs:subPropertyOf ?p . ?p owl:equivalentProperty ?p
scm-eqc1: ?c owl:equivalentClass ?d => ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c
scm-eqp1: ?p owl:equivalentProperty ?q => ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p
scm-int: ?c owl:intersectionOf ?l . [?l ?i ?d ?n] => ?c rdfs:subClassOf ?d
scm-uni: ?c owl:unionOf ?l . [?l ?i ?d ?n] => ?d rdfs:subClassOf ?c
"""

JOIN_RULES = """
eq-trans: ?x owl:sameAs ?y . ?y owl:sameAs ?z ; ne(?x ?z) => ?x owl:sameAs ?z
eq-diff2: ?n owl:members ?l . [?l ?i ?a ?k] . [?l ?j ?b ?k] . ?a owl:sameAs ?b ; ne(?i ?j) => FALSE
eq-diff3: ?n owl:distinctMembers ?l . [?l ?i ?a ?k] . [?l ?j ?b ?k] . ?a owl:sameAs ?b ; ne(?i ?j) => FALSE
prp-fp: ?p rdf:type owl:FunctionalProperty . ?x ?p ?a . ?x ?p ?b ; lt(?a ?b) other(?a ?b) not_lits(?a ?b) => ?a owl:sameAs ?b
dt-diff: ?p rdf:type owl:FunctionalProperty . ?x ?p ?a . ?x ?p ?b ; lt(?a ?b) other(?a ?b) both_lit(?a ?b) => FALSE
prp-fp-dif: ?p rdf:type owl:FunctionalProperty . ?a owl:differentFrom ?b . ?x ?p ?a . ?y ?p ?b ; ne(?x ?y) => ?x owl:differentFrom ?y
prp-ifp: ?p rdf:type owl:InverseFunctionalProperty . ?a ?p ?x . ?b ?p ?x ; lt(?a ?b) => ?a owl:sameAs ?b
prp-trp: ?p rdf:type owl:TransitiveProperty . ?x ?p ?y . ?y ?p ?z ; ne(?x ?z) => ?x ?p ?z
prp-asyp: ?p rdf:type owl:AsymmetricProperty . ?x ?p ?y . ?y ?p ?x => FALSE
prp-pdw: ?p owl:propertyDisjointWith ?q . ?x ?p ?y . ?x ?q ?z ; same(?y ?z) => FALSE
prp-pdw: ?p owl:propertyDisjointWith ?q . ?x ?p ?y . ?x ?q ?z ; other(?y ?z) res(?y) res(?z) => ?y owl:differentFrom ?z
prp-adp: ?n rdf:type owl:AllDisjointProperties . ?n owl:members ?l . [?l ?i ?p ?k] . [?l ?j ?q ?k] . ?x ?p ?y . ?x ?q ?z ; lt(?i ?j) same(?y ?z) => FALSE
prp-adp: ?n rdf:type owl:AllDisjointProperties . ?n owl:members ?l . [?l ?i ?p ?k] . [?l ?j ?q ?k] . ?x ?p ?y . ?x ?q ?z ; lt(?i ?j) other(?y ?z) res(?y) res(?z) => ?y owl:differentFrom ?z
prp-ifp-dif: ?p rdf:type owl:InverseFunctionalProperty . ?a owl:differentFrom ?b . ?a ?p ?x . ?b ?p ?y ; ne(?x ?y) => ?x owl:differentFrom ?y
scm-chain-trans: ?p owl:propertyChainAxiom ?l . [?l ?i ?p ?n] . [?l ?j ?p ?n] ; lt(?i ?j) two(?n) => ?p rdf:type owl:TransitiveProperty
prp-npa1: ?n rdf:type owl:NegativePropertyAssertion . ?n owl:sourceIndividual ?x . ?n owl:assertionProperty ?p . ?n owl:targetIndividual ?y . ?x ?p ?y => FALSE
prp-npa2: ?n rdf:type owl:NegativePropertyAssertion . ?n owl:sourceIndividual ?x . ?n owl:assertionProperty ?p . ?n owl:targetValue ?v . ?x ?p ?w ; same(?v ?w) => FALSE
cls-svf1: ?c owl:someValuesFrom ?d . ?c owl:onProperty ?p . ?x ?p ?y . ?y rdf:type ?d ; ne(?d owl:Thing) => ?x rdf:type ?c
cls-avf: ?c owl:allValuesFrom ?d . ?c owl:onProperty ?p . ?x rdf:type ?c . ?x ?p ?y ; res(?y) => ?y rdf:type ?d
cls-maxc1: ?c owl:maxCardinality ?k . ?c owl:onProperty ?p . ?x rdf:type ?c . ?x ?p ?y ; zero(?k) => FALSE
cls-maxc2: ?c owl:maxCardinality ?k . ?c owl:onProperty ?p . ?x rdf:type ?c . ?x ?p ?a . ?x ?p ?b ; one(?k) lt(?a ?b) => ?a owl:sameAs ?b
cls-maxqc1: ?c owl:maxQualifiedCardinality ?k . ?c owl:onProperty ?p . ?c owl:onClass ?d . ?x rdf:type ?c . ?x ?p ?y . ?y rdf:type ?d ; zero(?k) ne(?d owl:Thing) => FALSE
cls-maxqc2: ?c owl:maxQualifiedCardinality ?k . ?c owl:onProperty ?p . ?c owl:onClass owl:Thing . ?x rdf:type ?c . ?x ?p ?y ; zero(?k) => FALSE
cls-maxqc3: ?c owl:maxQualifiedCardinality ?k . ?c owl:onProperty ?p . ?c owl:onClass ?d . ?x rdf:type ?c . ?x ?p ?a . ?a rdf:type ?d . ?x ?p ?b . ?b rdf:type ?d ; one(?k) lt(?a ?b) ne(?d owl:Thing) => ?a owl:sameAs ?b
cls-maxqc4: ?c owl:maxQualifiedCardinality ?k . ?c owl:onProperty ?p . ?c owl:onClass owl:Thing . ?x rdf:type ?c . ?x ?p ?a . ?x ?p ?b ; one(?k) lt(?a ?b) => ?a owl:sameAs ?b
cax-adc: ?n rdf:type owl:AllDisjointClasses . ?n owl:members ?l . [?l ?i ?c ?k] . [?l ?j ?d ?k] . ?x rdf:type ?c . ?x rdf:type ?d ; lt(?i ?j) => FALSE
scm-sco: ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e ; ne(?c ?e) => ?c rdfs:subClassOf ?e
scm-eqc2: ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c => ?c owl:equivalentClass ?d
scm-spo: ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r ; ne(?p ?r) => ?p rdfs:subPropertyOf ?r
scm-eqp2: ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p => ?p owl:equivalentProperty ?q
scm-dom1: ?p rdfs:domain ?c . ?c rdfs:subClassOf ?d => ?p rdfs:domain ?d
scm-dom2: ?q rdfs:domain ?c . ?p rdfs:subPropertyOf ?q => ?p rdfs:domain ?c
scm-rng1: ?p rdfs:range ?c . ?c rdfs:subClassOf ?d => ?p rdfs:range ?d
scm-rng2: ?q rdfs:range ?c . ?p rdfs:subPropertyOf ?q => ?p rdfs:range ?c
scm-hv: ?c owl:hasValue ?v . ?c owl:onProperty ?p . ?d owl:hasValue ?v . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q ; ne(?c ?d) => ?c rdfs:subClassOf ?d
scm-svf1: ?c owl:someValuesFrom ?e . ?c owl:onProperty ?p . ?d owl:someValuesFrom ?e . ?d owl:onProperty ?p ; ne(?c ?d) => ?c rdfs:subClassOf ?d
scm-svf1: ?c owl:someValuesFrom ?e . ?c owl:onProperty ?p . ?d owl:someValuesFrom ?f . ?d owl:onProperty ?p . ?e rdfs:subClassOf ?f ; ne(?c ?d) => ?c rdfs:subClassOf ?d
scm-svf2: ?c owl:someValuesFrom ?e . ?c owl:onProperty ?p . ?d owl:someValuesFrom ?e . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q ; ne(?c ?d) => ?c rdfs:subClassOf ?d
scm-avf1: ?c owl:allValuesFrom ?e . ?c owl:onProperty ?p . ?d owl:allValuesFrom ?f . ?d owl:onProperty ?p . ?e rdfs:subClassOf ?f ; ne(?c ?d) => ?c rdfs:subClassOf ?d
scm-avf2: ?c owl:allValuesFrom ?e . ?c owl:onProperty ?p . ?d owl:allValuesFrom ?e . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q ; ne(?c ?d) => ?d rdfs:subClassOf ?c
"""

#: Rules that a conjunctive query can't say; lodestar.operators.special has them.
SPECIAL = {
    "prp-spo2": "a path along the properties of ?p's chain => its ends by ?p",
    "prp-key": "two instances of ?c with a common value of every key of ?c => owl:sameAs",
    "cls-int1": "?x typed by every member of ?c's intersection => ?x rdf:type ?c",
    "dt-type2": "a well-typed literal => its datatype as rdf:type",
    "dt-not-type": "a literal typed by two datatypes without a common value => FALSE",
    "dt-eq": "two typed literals of one value => owl:sameAs",
    "dt-diff": "two typed literals of one kind and different values => owl:differentFrom",
}
#: Seeded, never derived.
SEEDED = {"prp-ap": "the built-in annotation properties are typed owl:AnnotationProperty"}

# Rules whose derivations are reported as violations.
VIOLATIONS = frozenset(
    "eq-diff1 eq-diff2 eq-diff3 prp-fp-dif prp-ifp-dif prp-irp prp-asyp prp-adp prp-npa1 prp-npa2 prp-pdw "
    "cls-nothing2 cls-com cls-maxc1 cls-maxqc1 cls-maxqc3 cax-dw cax-adc dt-diff dt-not-type".split()
)


@dataclass(frozen=True)
class Atom:
    """A triple pattern (s, p, o) or a list pattern (list, place, member, size); variables start with ?."""

    terms: tuple[str, ...]

    @property
    def is_list(self) -> bool:
        return len(self.terms) == 4

    @property
    def variables(self) -> set[str]:
        return {t for t in self.terms if t.startswith("?")}

    @property
    def needs(self) -> str | None:
        """The constant a graph must hold for the pattern to match: a predicate, or the class of a type."""
        if self.is_list or self.terms[1].startswith("?"):
            return None
        return f"a {self.terms[2]}" if self.terms[1] == TYPE and not self.terms[2].startswith("?") else self.terms[1]


@dataclass(frozen=True)
class Clause:
    id: str
    body: tuple[Atom, ...]
    guards: tuple[tuple[str, tuple[str, ...]], ...]
    heads: tuple[tuple[str, str, str], ...]
    text: str = field(compare=False)


def _term(word: str) -> str:
    return word if word.startswith(("?", "<", "_:", '"')) else name(word)


def parse(line: str) -> Clause:
    rule, _, rest = line.partition(": ")
    left, _, right = rest.partition(" => ")
    body, _, guards = left.partition(" ; ")
    atoms = tuple(Atom(tuple(_term(w) for w in part.strip(" []").split())) for part in body.split(" . "))
    heads = (FALSE,) if right == "FALSE" else tuple(tuple(_term(w) for w in part.split()) for part in right.split(" . "))
    tests = tuple((f, tuple(_term(w) for w in args.split())) for f, args in re.findall(r"(\w+)\(([^)]*)\)", guards))
    return Clause(rule.strip(), atoms, tests, heads, rest)


DELTA = [parse(x) for x in DELTA_RULES.strip().split("\n")]
JOIN = [parse(x) for x in JOIN_RULES.strip().split("\n")]
CLAUSES = [*DELTA, *JOIN]


def _descriptions() -> dict[str, str]:
    found: dict[str, str] = {}
    for c in CLAUSES:
        found[c.id] = f"{found[c.id]}; or {c.text}" if c.id in found else c.text
    for k, v in {**SPECIAL, **SEEDED}.items():
        found[k] = f"{found[k]}; or {v}" if k in found else v
    return found


DESCRIPTIONS = _descriptions()
#: In case of equal rounds the rule listed first explains a triple.
PRIORITY = {r: i for i, r in enumerate(dict.fromkeys([*(c.id for c in DELTA), "dt-type2", "dt-not-type", *(c.id for c in JOIN), "prp-spo2", "prp-key", "cls-int1", "dt-eq", "dt-diff"]))}
