"""The fixpoint, provenance and reports, with toy rules and the standard ones."""

from pyspark.sql import functions as F

from lodestar.functions.terms import FALSE, SAME, TYPE, literal, name
from lodestar.operators import match
from lodestar.plans import engine, rules
from lodestar.plans.engine import OwlRlReasoner, Reasoner, Rule

QUADS = "s string, p string, o string, g string"
A, B, C, P, D = "<a>", "<b>", "<c>", "<p>", "<derived>"


def quads(spark, *rows, g="<g>"):
    return spark.createDataFrame([(*r, g) if len(r) == 3 else r for r in rows], QUADS)


def copied(triples, new):
    found = triples.where(F.col("p") == P)
    why = F.array(F.struct("s", "p", "o"), F.struct(F.lit("<u>").alias("s"), F.lit("<v>").alias("p"), F.lit("<w>").alias("o")))
    return found.select("s", F.lit(D).alias("p"), "o", why.alias("premises"))


def toy(spark, **more):
    return Reasoner(spark, rules=[Rule("copy", copied, "p becomes derived")], **more)


def rows(df):
    return {(r.s, r.p, r.o) for r in df.collect()}


def test_infers_without_sources_and_merges_graphs(spark):
    q = quads(spark, (A, P, B, "<g>"), (A, P, B, "<h>"), (B, P, C, "<h>"), (C, P, C, "<other>"))
    assert rows(toy(spark).infer(q, ["<g>", "<h>"])) == {(A, D, B), (B, D, C)}
    assert rows(Reasoner(spark).infer(q, ["<g>"])) == set()


def test_provenance_origins_and_unknown_premises(spark):
    q = quads(spark, (A, P, B), (A, P, B))
    r = toy(spark, axioms=[(C, P, C), (C, P, C), (A, P, B)])
    found = {(x.s, x.p, x.o): x for x in r.provenance_all(q, ["<g>"]).collect()}
    assert set(found) == {(A, D, B), (C, D, C)}
    assert [p.origin for p in found[(A, D, B)].premises] == ["source", "source"]
    assert [p.origin for p in found[(C, D, C)].premises] == ["axiom", "source"]
    assert found[(A, D, B)].rule == "copy" and found[(A, D, B)].description == "p becomes derived"
    assert r.provenance_for(q, ["<g>"], (A, P, B)).collect()[0].origin == "source"
    assert r.provenance_for(q, ["<g>"], (C, P, C)).collect()[0].origin == "axiom"
    assert r.provenance_for(q, ["<g>"], (A, P, C)) is None
    assert r.report_for(q, ["<g>"], (A, P, C)) is None
    one = r.report_for(q, ["<g>"], (A, D, B)).collect()[0]
    assert (one.severity, one.target_graph, one.source_graphs) == ("Info", "<g>", ["<g>"])
    assert r.report_for(q, ["<g>"], (A, D, B), "<t>").collect()[0].target_graph == "<t>"


def clauses(*ids):
    return [c for c in rules.CLAUSES if c.id in ids]


def test_stop_when_keeps_the_match(spark):
    chain = [(f"<n{i}>", SAME, f"<n{i + 1}>") for i in range(8)]
    r = Reasoner(spark, clauses("eq-trans"))
    out = rows(r.infer(quads(spark, *chain), ["<g>"], stop_when=F.col("o") == "<n2>"))
    assert ("<n0>", SAME, "<n2>") in out and ("<n0>", SAME, "<n8>") not in out
    assert len(rows(r.infer(quads(spark, *chain), ["<g>"]))) == 9 * 8 // 2 - 8


def test_two_hops_rest_on_both_sources(spark):
    r = Reasoner(spark, clauses("eq-sym", "eq-trans"), descriptions=rules.DESCRIPTIONS)
    q = quads(spark, (A, SAME, B), (B, SAME, C))
    found = r.provenance_for(q, ["<g>"], (A, SAME, C)).collect()
    assert {(x.s, x.o) for x in found if x.origin == "source"} == {(A, B), (B, C)}
    sym = [x for x in r.provenance_all(q, ["<g>"]).collect() if (x.s, x.o) == (B, A)][0]
    assert sym.rule == "eq-sym" and [(p.s, p.origin) for p in sym.premises] == [(A, "source")]


def test_late_facts_reach_rules_already_run(spark):
    # The type of x arrives after its equality, and the intersection after both.
    q = quads(spark, ("<x>", SAME, "<y>"), ("<x>", P, B), (P, name("rdfs:domain"), "<c>"), ("<c>", name("rdfs:subClassOf"), "<d>"), ("<c>", name("owl:disjointWith"), "<d>"))
    r = Reasoner(spark, clauses("eq-rep-s", "prp-dom", "cax-sco", "cax-dw"))
    out = rows(r.infer(q, ["<g>"]))
    assert {("<y>", TYPE, "<d>"), ("<y>", P, B), FALSE} <= out


def test_equals_naive_closure(spark):
    import random

    rnd = random.Random(6)
    sub = name("rdfs:subClassOf")
    edges = {(f"<c{rnd.randrange(12)}>", sub, f"<c{rnd.randrange(12)}>") for _ in range(16)} | {(f"<i{k}>", TYPE, f"<c{rnd.randrange(12)}>") for k in range(6)}
    every = set(edges)
    while True:
        more = {(a, sub, d) for a, p, b in every if p == sub for c, q, d in every if q == sub and b == c and a != d}
        more |= {(x, TYPE, d) for x, p, c in every if p == TYPE for e, q, d in every if q == sub and c == e}
        if more <= every:
            break
        every |= more
    assert rows(Reasoner(spark, clauses("scm-sco", "cax-sco")).infer(quads(spark, *edges), ["<g>"])) == every - edges


def test_standard_reasoner(spark):
    r = OwlRlReasoner(spark, datatype_joins=False)
    fun = name("owl:FunctionalProperty")
    one, two = literal("v1"), literal("v2")
    q = quads(spark, (P, TYPE, fun), (A, P, one), (A, P, two), (A, TYPE, name("owl:NamedIndividual")))
    report = r.report_all(q, ["<g>"])
    assert not report.consistent and not report.marker_consistent
    found = {(x.detail.s, x.detail.p, x.detail.o): x for x in report.results.collect()}
    clash = found[FALSE]
    assert clash.detail.rule == "dt-diff" and clash.severity == "Violation"
    assert {p.origin for p in clash.detail.premises} == {"source"} and len(clash.detail.premises) == 3
    assert (A, SAME, A) in found and (A, P, one) not in found
    thing = found[(A, TYPE, name("owl:Thing"))].detail
    assert thing.rule == "cax-sco" and {p.origin for p in thing.premises} == {"axiom", "source"}
    assert (name("owl:Thing"), name("rdfs:subClassOf"), name("owl:Thing")) in found
    assert "eq-ref" not in {c.id for c in OwlRlReasoner(spark, equality_ref=False).clauses}
    assert OwlRlReasoner(spark).axioms().count() == 75


def test_facts_meet_the_schema_before_each_other(spark, monkeypatch):
    # Spokes of a hub by a symmetric property: only the transitive one may pair facts, else pairs grow with the square.
    near, within = "<near>", "<within>"
    spokes = [(f"<n{i}>", near, "<hub>") for i in range(5)]
    q = quads(spark, *spokes, (near, TYPE, name("owl:SymmetricProperty")), (A, within, B), (B, within, C), (within, TYPE, name("owl:TransitiveProperty")))
    met, bindings = [], match.bindings
    monkeypatch.setattr(match, "bindings", lambda atom, relation: met.append(atom.terms) or bindings(atom, relation))
    out = rows(Reasoner(spark, clauses("prp-symp", "prp-trp")).infer(q, ["<g>"]))
    assert out == {(o, p, s) for s, p, o in spokes} | {(A, within, C)}
    fact, second = ("?x", "?p", "?y"), ("?y", "?p", "?z")
    pairs = [i for i in range(len(met) - 1) if met[i : i + 2] == [fact, second]]
    assert second in met and all(met[i - 1][-1] == name("owl:TransitiveProperty") for i in pairs)


def test_jobs_do_not_grow_with_the_rules(spark, monkeypatch):
    monkeypatch.setattr(engine, "BATCH", 2)
    sizes, written = [], engine.written
    monkeypatch.setattr(engine, "written", lambda df, label, rows=None: sizes.append(df._jdf.queryExecution().analyzed().toString().count("Join ")) or written(df, label, rows))
    sub = name("rdfs:subClassOf")
    q = quads(spark, (A, sub, B), (B, sub, C), (C, sub, D), (P, name("rdfs:domain"), A), ("<x>", P, "<y>"))
    out = rows(Reasoner(spark, clauses("scm-sco", "cax-sco", "prp-dom", "scm-dom1", "scm-eqc2")).infer(q, ["<g>"]))
    assert {(A, sub, D), ("<x>", TYPE, D), (P, name("rdfs:domain"), D)} <= out
    assert max(sizes) <= 4


def test_equality_closes_by_components(spark, monkeypatch):
    # A chain takes log rounds and k * k * k meetings by joins; by components its clique comes in one round.
    chain = [(f"<n{i:02}>", SAME, f"<n{i + 1:02}>") for i in range(12)]
    r = Reasoner(spark, clauses("eq-sym", "eq-trans"), most_rounds=1)
    every = {(f"<n{i:02}>", SAME, f"<n{j:02}>") for i in range(13) for j in range(13) if i != j}
    assert rows(r.infer(quads(spark, *chain, (A, SAME, A)), ["<g>"])) == every - set(chain)
    # Pairs that other rules add later join what is closed.
    fun = name("owl:FunctionalProperty")
    more = Reasoner(spark, clauses("eq-sym", "eq-trans", "prp-fp", "eq-rep-s"))
    out = rows(more.infer(quads(spark, (A, SAME, B), (P, TYPE, fun), (A, P, C), (B, P, D), (D, SAME, "<e>")), ["<g>"]))
    assert {(C, SAME, D), (C, SAME, "<e>"), ("<e>", SAME, C), (B, P, C), (B, SAME, A)} <= out
