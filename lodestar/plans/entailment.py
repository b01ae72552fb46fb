"""Whether what a reasoner derives entails a conclusion, and test cases of four kinds.

A conclusion is a graph whose blank nodes stand for any term, so it is a conjunctive query: each part of it that hangs
together by blank nodes is one join, and all parts must have a solution.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.terms import FALSE
from lodestar.operators import match
from lodestar.plans.engine import KEY, Reasoner
from lodestar.plans.rules import Atom, Clause
from lodestar.sources.shared import written

Triple = tuple[str, str, str]


def pattern(triple: Triple) -> Atom:
    """A triple with its blank nodes as variables; a variable's name is that of a column."""
    return Atom(tuple("?b" + "".join(c if c.isalnum() else f"_{ord(c)}_" for c in t[2:]) if t.startswith("_:") else t for t in triple))


def parts(conclusion: Iterable[Triple]) -> list[list[Atom]]:
    """The patterns in groups that share no variables."""
    found: list[list[Atom]] = []
    for atom in map(pattern, dict.fromkeys(conclusion)):
        near = [g for g in found if any(a.variables & atom.variables for a in g)]
        found = [g for g in found if g not in near] + [[*(a for g in near for a in g), atom]]
    return found


def solutions(triples: DataFrame, group: list[Atom]) -> DataFrame:
    """What the blank nodes of one part can stand for. Patterns with more constants start."""
    order = sorted(group, key=lambda a: len(a.variables))
    return match.solutions(Clause("", tuple(order), (), (), ""), [triples] * len(order))


def entails(triples: DataFrame, conclusion: Iterable[Triple]) -> bool:
    """Whether triples (s, p, o) hold the conclusion; the empty one always holds."""
    return all(not solutions(triples, group).isEmpty() for group in parts(conclusion))


def everything(reasoner: Reasoner, quads: DataFrame, graphs: Iterable[str] | None = None) -> DataFrame:
    """s, p, o of the sources, the axioms and all that is inferred."""
    seeds, derived = reasoner.derive(quads, graphs, premises=False)
    return written(seeds.select(*KEY).unionByName(derived.select(*KEY)), "everything")


def marked(triples: DataFrame) -> bool:
    """Whether the mark of inconsistency is among triples."""
    return not triples.where(reduce(Column.__and__, (F.col(k) == v for k, v in zip(KEY, FALSE, strict=True)))).isEmpty()


@dataclass(frozen=True)
class Case:
    """kind: entails, entails_not, consistent or inconsistent; the last two have no conclusion."""

    id: str
    kind: str
    premise: tuple[Triple, ...]
    conclusion: tuple[Triple, ...] = ()


def passes(reasoner: Reasoner, case: Case) -> bool:
    quads = reasoner.spark.createDataFrame([(*t, "urn:case") for t in case.premise], "s string, p string, o string, g string")
    every = everything(reasoner, quads, ["urn:case"])
    if case.kind in ("entails", "entails_not"):
        return entails(every, case.conclusion) == (case.kind == "entails")
    if case.kind in ("consistent", "inconsistent"):
        return marked(every) == (case.kind == "inconsistent")
    raise ValueError(f"no kind of case: {case.kind}")
