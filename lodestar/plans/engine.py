"""The fixpoint: rules over a growing set of triples, with provenance and reports.

A round evaluates every clause against the triples of earlier rounds and, for each body atom in turn, the new
ones (semi-naive). Only clauses whose constants occur take part. What a round adds is written to the
shared folder, so plans stay short and survive lost executors; the driver sees counts, and which schema constants
occur. The least fixpoint is unique, so the order of rules and rounds shows only in the provenance, where
the derivation of the least (round, rule, premises) is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.terms import FALSE, SAME, TYPE, is_literal
from lodestar.operators import lists as collections
from lodestar.operators import graphs, match, special
from lodestar.plans import rules as owl
from lodestar.plans.axioms import axioms as owl_axioms
from lodestar.sources.shared import written

TRIPLES = "s string, p string, o string"
DERIVED = f"{TRIPLES}, rule string, round int, premises {match.PREMISES}"
KEY = ["s", "p", "o"]
#: Rules for which x owl:sameAs x adds nothing, and the key of what does: pairs of different terms.
PROPER, PAIRS = frozenset({"eq-sym", "eq-trans", "eq-rep-s", "eq-rep-o"}), f"different {SAME}"
#: The rules that close equality; without provenance components do it, since joins meet k * k * k times in a clique of k terms.
EQUALITY = frozenset({"eq-sym", "eq-trans"})
#: Keys of literal objects and of typed literals, and the special rules that need them.
OBJECTS, TYPED = "literal objects", "typed literals"
LITERAL_RULES = {"dt-type2": OBJECTS, "dt-not-type": TYPED, "dt-eq": TYPED, "dt-diff": TYPED}
#: So many triples of a constant are small: joined first and broadcast.
SMALL = 10_000
#: So many derivations make one job: the driver holds a job's plan again for each stage that ends, so it must not grow with the rules.
BATCH = 12


@dataclass(frozen=True)
class Rule:
    """A user's rule: apply(triples, new) gives s, p, o and may give premises; new is what the last round added."""

    id: str
    apply: Callable[[DataFrame, DataFrame], DataFrame]
    description: str | None = None


@dataclass
class Report:
    """consistent: no violation by rule; marker_consistent: the mark of inconsistency was not derived."""

    results: DataFrame
    consistent: bool
    marker_consistent: bool


class Reasoner:
    """Any set of clauses, special rules and user rules; see OwlRlReasoner for the standard one."""

    def __init__(self, spark: SparkSession, clauses: Iterable[owl.Clause] = (), specials: Iterable[tuple] = (), rules: Iterable[Rule] = (), axioms: Iterable[tuple] = (), descriptions: dict | None = None, violations: Iterable[str] = (), most_rounds: int = 1000):
        self.spark = spark
        self.clauses, self.specials, self.rules = list(clauses), list(specials), list(rules)
        self._axioms = sorted(set(axioms))
        self.descriptions = {**(descriptions or {}), **{r.id: r.description for r in self.rules if r.description}}
        self.violations = frozenset(violations)
        self.most_rounds = most_rounds
        self.constants = sorted({a.needs for c in self.clauses for a in c.body if a.needs} | {k for _, _, ks in self.specials for k in ks})

    # -- seeds

    def axioms(self) -> DataFrame:
        return self.spark.createDataFrame(self._axioms, TRIPLES)

    def _seeds(self, quads: DataFrame, graphs: Iterable[str] | None) -> DataFrame:
        """s, p, o, origin; a triple that is both source and axiom is a source."""
        chosen = quads.where(F.col("g").isin(list(graphs))) if graphs is not None else quads
        source = chosen.select(*KEY).dropna().withColumn("origin", F.lit("source"))
        every = source.unionByName(self.axioms().withColumn("origin", F.lit("axiom"))) if self._axioms else source
        return every.groupBy(*KEY).agg(F.max("origin").alias("origin"))

    # -- one round

    def _present(self, triples: DataFrame) -> dict[str, int]:
        """How many triples each of the rules' constants has: at most as many rows as the vocabulary has."""
        classes = [k[2:] for k in self.constants if k.startswith("a ")]
        predicates = [k for k in self.constants if not k.startswith("a ")]
        is_type, none = F.col("p") == TYPE, F.lit(None).cast("string")
        keys = F.array(
            F.when(is_type & F.col("o").isin(classes), F.concat(F.lit("a "), "o")).otherwise(none),
            F.when(F.col("p").isin(predicates), F.col("p")).otherwise(none),
            F.when((F.col("p") == SAME) & (F.col("s") != F.col("o")), F.lit(PAIRS)).otherwise(none),
            F.when(is_literal(F.col("o")), F.lit(OBJECTS)).otherwise(none),
            F.when(is_literal(F.col("s")) & is_type, F.lit(TYPED)).otherwise(none),
        )
        return {r.k: r.n for r in triples.select(F.explode(keys).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}

    def _small(self, triples: DataFrame, present: dict[str, int]) -> DataFrame:
        """The triples of constants that are small so far; a constant that was small once has all of its earlier triples here."""
        few = [k for k in self.constants if present.get(k, 0) <= SMALL]
        classes = [k[2:] for k in few if k.startswith("a ")]
        found = triples.where(F.col("p").isin([k for k in few if not k.startswith("a ")]) | (F.col("p") == TYPE) & F.col("o").isin(classes))
        return written(found, "schema", min(SMALL * len(few), sum(present.get(k, 0) for k in few)))

    def _candidates(self, old: DataFrame | None, new: DataFrame, every: DataFrame, lists: DataFrame, present: dict[str, int], fresh: dict[str, int], premises: bool, schema: tuple, by_components: bool = False) -> list[DataFrame]:
        """schema: of old, new and every, the triples of small constants. by_components: how equality is closed."""
        out = []

        def add(rule: str, df: DataFrame) -> None:
            columns = [*KEY]
            if premises:
                why = F.col("premises") if "premises" in df.columns else F.array()
                columns += [F.lit(owl.PRIORITY.get(rule, 1000)).alias("priority"), F.lit(rule).alias("rule"), why.cast(match.PREMISES).alias("premises")]
            out.append(df.select(*columns))

        if by_components and PAIRS in fresh:
            add("eq-trans", graphs.same_as_pairs(every.where(F.col("p") == SAME)).select("s", F.lit(SAME).alias("p"), "o"))
        for c in self.clauses:
            if by_components and c.id in EQUALITY:
                continue
            needs = [PAIRS if a.needs == SAME and c.id in PROPER else a.needs for a in c.body]
            if any(k and k not in present for k in needs):
                continue
            small = [bool(a.needs) and present.get(a.needs, 0) <= SMALL for a in c.body]

            def source(i: int, age: int, c=c, needs=needs, small=small) -> DataFrame:
                found = (schema if small[i] else (old, new, every))[age]
                return found.where("s <> o") if needs[i] == PAIRS else found

            triples = [i for i, a in enumerate(c.body) if not a.is_list]
            turns = triples if old is not None else triples[:1]
            for turn in turns:
                if needs[turn] and needs[turn] not in fresh:
                    continue
                sources = [lists if a.is_list else source(i, 2 if old is None else 0 if i < turn else 1 if i == turn else 2) for i, a in enumerate(c.body)]
                # Small schema patterns start; the rest joins to them. In later rounds what is new starts.
                order = [turn, *(i for i in range(len(c.body)) if i != turn)] if old is not None else list(range(len(c.body)))
                add(c.id, match.derivations(c, sources, order, premises, small))
        for rule, function, needs in self.specials:
            if rule in LITERAL_RULES and LITERAL_RULES[rule] not in present:
                continue
            if all(k in present for k in needs):  # over everything at first and where its own axioms are new, else over what is new
                add(rule, function(every, lists, None if old is None or fresh.keys() & set(needs) else new))
        for r in self.rules:
            add(r.id, r.apply(every, new))
        return out

    def derive(self, quads: DataFrame, source_graphs: Iterable[str] | None = None, stop_when: Column | Callable[[DataFrame], bool] | None = None, premises: bool = True) -> tuple[DataFrame, DataFrame]:
        """(seeds with origin, derived triples with rule, round and premises).

        stop_when: a condition on s, p, o, or a function of what a round adds; the fixpoint ends after the round that derives
        a match, or for which the function is true.
        """
        seeds = written(self._seeds(quads, source_graphs), "seeds")
        new = seeds.select(*KEY)
        lists = collections.list_table(new) if any(a.is_list for c in self.clauses for a in c.body) or self.specials else self.spark.createDataFrame([], collections.SCHEMA)
        old, parts, derived = None, [(new, seeds.count())], []
        present: dict[str, int] = {}
        schema = None
        ids = {c.id for c in self.clauses}
        by_components = not premises and stop_when is None and ids >= EQUALITY
        only_equality = by_components and ids == EQUALITY and not self.specials and not self.rules
        for number in range(1, self.most_rounds + 1):
            every = reduce(DataFrame.unionByName, (d for d, _ in parts))
            fresh = self._present(new)
            present = {k: present.get(k, 0) + fresh.get(k, 0) for k in present | fresh}
            added_schema = self._small(new, present)
            schema = (schema and schema[2], added_schema, self._small(schema[2].unionByName(added_schema), present) if schema else added_schema)
            found = self._candidates(old, new, every, lists, present, fresh, premises, schema, by_components)
            if not found:
                break
            batches = [reduce(DataFrame.unionByName, found[i : i + BATCH]) for i in range(0, len(found), BATCH)]
            union = batches[0] if len(batches) == 1 else reduce(DataFrame.unionByName, (written(b, "candidates") for b in batches))
            if premises:
                best = union.groupBy(*KEY).agg(F.min(F.struct("priority", "premises", "rule")).alias("b")).select(*KEY, "b.rule", F.lit(number).alias("round"), "b.premises")
            else:
                best = union.distinct()
            added = written(best.join(every, KEY, "left_anti"), "round")
            size = added.count()
            if not size:
                break
            derived.append(added)
            if only_equality:  # closed in one round
                break
            new, old = added.select(*KEY), every
            parts.append((new, size))
            while len(parts) > 1 and 2 * parts[-1][1] >= parts[-2][1]:  # parts shrink by half, so there are few
                (a, m), (b, n) = parts[-2:]
                parts[-2:] = [(written(a.unionByName(b), "triples"), m + n)]
            if stop_when is not None and (not new.where(stop_when).isEmpty() if isinstance(stop_when, Column) else stop_when(new)):
                break
        else:
            raise RuntimeError(f"no fixpoint after {self.most_rounds} rounds")
        empty = self.spark.createDataFrame([], DERIVED if premises else TRIPLES)
        return seeds, reduce(DataFrame.unionByName, derived) if derived else empty

    # -- entry points

    def infer(self, quads: DataFrame, source_graphs: Iterable[str] | None = None, stop_when: Column | Callable[[DataFrame], bool] | None = None) -> DataFrame:
        """s, p, o of all inferred triples, without source triples and axioms."""
        return self.derive(quads, source_graphs, stop_when, premises=False)[1].select(*KEY)

    def provenance_all(self, quads: DataFrame, source_graphs: Iterable[str] | None = None) -> DataFrame:
        """One row for each inferred triple: its first derivation, premises with their origins, and a description."""
        seeds, derived = self.derive(quads, source_graphs)
        return self._described(seeds, derived)

    def _described(self, seeds: DataFrame, derived: DataFrame) -> DataFrame:
        """Premises that are neither seeds nor derived count as sources."""
        each = derived.select(*KEY, F.posexplode_outer("premises").alias("at", "q"))
        origins = seeds.select(F.struct(*KEY).alias("q"), "origin").unionByName(derived.select(F.struct(*KEY).alias("q"), F.lit("inference").alias("origin")))
        known = each.join(origins, "q", "left").withColumn("origin", F.coalesce("origin", F.lit("source")))
        lists = known.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "q.s", "q.p", "q.o", "origin")))).alias("sorted"))
        rules = self.spark.createDataFrame([(k, v) for k, v in self.descriptions.items()], "rule string, description string")
        whole = derived.join(lists, KEY).join(F.broadcast(rules), "rule", "left")
        premise = lambda x: F.struct(x["s"].alias("s"), x["p"].alias("p"), x["o"].alias("o"), x["origin"].alias("origin"))
        return whole.select(*KEY, F.lit("inference").alias("origin"), "rule", "description", "round", F.transform("sorted", premise).alias("premises"))

    def provenance_for(self, quads: DataFrame, source_graphs: Iterable[str] | None, triple: tuple[str, str, str]) -> DataFrame | None:
        """The derivations that triple rests on, as rows of one graph with their depth; None if it can't be derived.

        A seed explains itself. The way back goes from rounds to earlier rounds, so it ends.
        """
        is_it = reduce(Column.__and__, (F.col(k) == v for k, v in zip(KEY, triple, strict=True)))
        nothing = F.lit(None)
        leaf = lambda df, depth: df.select(*KEY, "origin", nothing.cast("string").alias("rule"), nothing.cast("string").alias("description"), nothing.cast("int").alias("round"), F.array().cast("array<struct<s:string,p:string,o:string,origin:string>>").alias("premises"), F.lit(depth).alias("depth"))
        seed = self._seeds(quads, source_graphs).where(is_it)
        if not seed.isEmpty():
            return leaf(seed, 0)
        seeds, derived = self.derive(quads, source_graphs, stop_when=is_it)
        table = written(self._described(seeds, derived), "derivations")
        frontier = table.where(is_it)
        if frontier.isEmpty():
            return None
        out, depth = [frontier.withColumn("depth", F.lit(0))], 0
        while True:
            depth += 1
            below = frontier.select(F.explode("premises").alias("q")).select("q.*").distinct()
            leaves = below.where("origin <> 'inference'")
            out.append(leaf(leaves, depth))
            frontier = written(table.join(below.where("origin = 'inference'").select(*KEY), KEY, "left_semi"), "frontier")
            if frontier.isEmpty():
                break
            out.append(frontier.withColumn("depth", F.lit(depth)))
        every = reduce(DataFrame.unionByName, out)
        first = every.groupBy(*KEY).agg(F.min_by(F.struct("origin", "rule", "description", "round", "premises", "depth"), "depth").alias("x"))
        return first.select(*KEY, "x.*")

    def severity(self, rule: Column) -> Column:
        return F.when(rule.isin(sorted(self.violations)), "Violation").otherwise("Info")

    def report_all(self, quads: DataFrame, source_graphs: Iterable[str] | None = None, target_graph: str | None = None) -> Report:
        """A result for each inferred triple. The target graph defaults to the first source graph."""
        found = written(self.provenance_all(quads, source_graphs), "report")
        results = self._results(found, source_graphs, target_graph)
        counts = found.agg(F.max((self.severity(F.col("rule")) == "Violation").cast("int")), F.max(reduce(Column.__and__, (F.col(k) == v for k, v in zip(KEY, FALSE, strict=True))).cast("int"))).first()
        return Report(results, not counts[0], not counts[1])

    def _results(self, found: DataFrame, graphs: Iterable[str] | None, target: str | None) -> DataFrame:
        graphs = list(graphs or [])
        target = target if target is not None else graphs[0] if graphs else ""
        return found.select(F.array(*map(F.lit, graphs)).cast("array<string>").alias("source_graphs"), F.lit(target).alias("target_graph"), self.severity(F.col("rule")).alias("severity"), F.struct(*found.columns).alias("detail"))

    def report_for(self, quads: DataFrame, source_graphs: Iterable[str] | None, triple: tuple[str, str, str], target_graph: str | None = None) -> DataFrame | None:
        """The result for one triple, or None."""
        found = self.provenance_for(quads, source_graphs, triple)
        return None if found is None else self._results(found.where("depth = 0"), source_graphs, target_graph)


class OwlRlReasoner(Reasoner):
    """The OWL 2 RL rules.

    equality_ref: reflexive owl:sameAs. datatype_value_space: the rules of literals; datatype_joins: their pairs, which are
    quadratic in the literals of a kind. strict_all_different: the list of eq-diff2/3 must belong to an
    owl:AllDifferent.
    """

    def __init__(self, spark: SparkSession, equality_ref: bool = True, datatype_value_space: bool = True, datatype_joins: bool = True, strict_all_different: bool = False, rules: Iterable[Rule] = ()):
        clauses = [c for c in owl.CLAUSES if equality_ref or c.id != "eq-ref"]
        if strict_all_different:
            member = owl.Atom(("?n", TYPE, owl.name("owl:AllDifferent")))
            clauses = [owl.Clause(c.id, (member, *c.body), c.guards, c.heads, c.text) if c.id in ("eq-diff2", "eq-diff3") else c for c in clauses]
        specials = [*special.RULES, *(special.DATATYPE_RULES if datatype_value_space else []), *(special.DATATYPE_JOINS if datatype_value_space and datatype_joins else [])]
        super().__init__(spark, clauses, specials, rules, owl_axioms(), owl.DESCRIPTIONS, owl.VIOLATIONS)


def apply_once(triples: DataFrame, rule_id: str, lists: DataFrame | None = None, premises: bool = False) -> DataFrame:
    """What one application of a rule derives from triples, those already there included; distinct."""
    lists = lists if lists is not None else triples.sparkSession.createDataFrame([], collections.SCHEMA)
    found = [match.derivations(c, [lists if a.is_list else triples for a in c.body], list(range(len(c.body))), premises) for c in owl.CLAUSES if c.id == rule_id]
    found += [f(triples, lists).select(*KEY, *(["premises"] if premises else [])) for r, f, _ in [*special.RULES, *special.DATATYPE_RULES, *special.DATATYPE_JOINS] if r == rule_id]
    return reduce(DataFrame.unionByName, found).distinct()
