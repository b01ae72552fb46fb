"""Clauses as DataFrame joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.terms import is_literal, is_resource, lexical
from lodestar.plans.rules import Atom, Clause

TRIPLE = ("s", "p", "o")
LIST = ("head", "pos", "member", "size")
PREMISES = "array<struct<s:string,p:string,o:string>>"

GUARDS = {
    "res": is_resource,
    "both_lit": lambda a, b: is_literal(a) & is_literal(b),
    "not_lits": lambda a, b: ~(is_literal(a) & is_literal(b)),
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "same": lambda a, b: lexical(a) == lexical(b),
    "other": lambda a, b: lexical(a) != lexical(b),
    "zero": lambda k: lexical(k) == "0",
    "one": lambda k: lexical(k) == "1",
    "two": lambda n: n == 2,
}


def value(term: str) -> Column:
    return F.col(term[1:]) if term.startswith("?") else F.lit(term)


def bindings(atom: Atom, relation: DataFrame) -> DataFrame:
    """The rows of relation that match, a column for each variable; constants become pushed-down filters."""
    columns, seen = LIST if atom.is_list else TRIPLE, {}
    tests = []
    for term, column in zip(atom.terms, columns, strict=True):
        if not term.startswith("?"):
            tests.append(F.col(column) == term)
        elif term in seen:
            tests.append(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    found = relation.where(reduce(Column.__and__, tests)) if tests else relation
    return found.select(*(F.col(c).alias(v[1:]) for v, c in seen.items()))


def solutions(clause: Clause, relations: list[DataFrame], small: list[bool] | None = None) -> DataFrame:
    """All bindings of the body, relations giving one source for each atom; the first atom starts the join.

    Guards are applied as soon as their variables are bound, so that pairs meet their inequality in
    the join itself. small: which relations have a bounded number of matches. These join before others, else facts would meet facts of all
    predicates before the schema says which count, and are broadcast, else facts would be dealt out by their predicate.
    """
    todo = list(zip(clause.body, relations, small or [False] * len(relations), strict=True))
    guards = list(clause.guards)
    atom, relation, light = todo.pop(0)
    found, known = bindings(atom, relation), set(atom.variables)

    def guarded(df: DataFrame) -> DataFrame:
        for g in [g for g in guards if {a for a in g[1] if a.startswith("?")} <= known]:
            guards.remove(g)
            df = df.where(GUARDS[g[0]](*map(value, g[1])))
        return df

    found = guarded(found)
    while todo:
        common_of = lambda i: len(todo[i][0].variables & known)
        at = max(range(len(todo)), key=lambda i: (todo[i][2] and common_of(i) > 0, common_of(i), -i))
        atom, relation, few = todo.pop(at)
        common = sorted(v[1:] for v in atom.variables & known)
        more = bindings(atom, relation)
        if few:
            more = F.broadcast(more)
        elif light:
            found = F.broadcast(found)
        light = False
        found = found.join(more, common) if common else found.crossJoin(more)  # only prp-rflx: its result is the product
        known |= atom.variables
        found = guarded(found)
    return found


def derivations(clause: Clause, relations: list[DataFrame], order: list[int], premises: bool, small: list[bool] | None = None) -> DataFrame:
    """s, p, o of every head, and the matched triples if asked for; order puts body atoms in the order of relations."""
    body = tuple(clause.body[i] for i in order)
    found = solutions(Clause(clause.id, body, clause.guards, clause.heads, clause.text), [relations[i] for i in order], small and [small[i] for i in order])
    why = F.array(*(F.struct(*(value(t).alias(c) for t, c in zip(a.terms, TRIPLE, strict=True))) for a in clause.body if not a.is_list)).cast(PREMISES).alias("premises")
    head = lambda h: F.struct(*(value(t).alias(c) for t, c in zip(h, TRIPLE, strict=True)))
    if len(clause.heads) == 1:
        return found.select(*(value(t).alias(c) for t, c in zip(clause.heads[0], TRIPLE, strict=True)), *([why] if premises else []))
    many = found.select(F.explode(F.array(*map(head, clause.heads))).alias("h"), *([why] if premises else []))
    return many.select("h.s", "h.p", "h.o", *(["premises"] if premises else []))
