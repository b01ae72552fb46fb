"""RDF terms as strings, their constants, and column functions over them.

A term is one string with its full identity: <iri>, _:label, "lexical"^^<datatype> or "lexical"@language.
A plain literal has the datatype xsd:string. Quotes, backslashes and line ends in a lexical form are escaped
as in N-Triples.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "ex": "ex:",
}


def iri(value: str) -> str:
    return f"<{value}>"


def name(short: str) -> str:
    """prefix:local as a term."""
    prefix, _, local = short.partition(":")
    return iri(PREFIXES[prefix] + local)


def escape(lexical: str) -> str:
    return lexical.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")


def literal(lexical: str, datatype: str = "xsd:string", language: str | None = None) -> str:
    return f'"{escape(lexical)}"@{language}' if language else f'"{escape(lexical)}"^^{name(datatype)}'


TYPE, SAME, DIFFERENT, SUBCLASS = (name(x) for x in ("rdf:type", "owl:sameAs", "owl:differentFrom", "rdfs:subClassOf"))
FIRST, REST, NIL = (name(x) for x in ("rdf:first", "rdf:rest", "rdf:nil"))
THING, NOTHING = name("owl:Thing"), name("owl:Nothing")
#: The triple that marks an inconsistent graph.
FALSE = (THING, SUBCLASS, NOTHING)

LITERAL = r'(?s)^"(.*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))$'


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_resource(term: Column) -> Column:
    return ~is_literal(term)


def lexical(term: Column) -> Column:
    """What a term says regardless of datatype and language; an IRI or label stands for itself."""
    return F.when(is_literal(term), F.regexp_extract(term, LITERAL, 1)).otherwise(term)


def datatype(term: Column) -> Column:
    """The datatype of a literal as a term; null of anything else, and of literals with a language."""
    found = F.regexp_extract(term, LITERAL, 2)
    return F.when(is_literal(term) & (found != ""), F.concat(F.lit("<"), found, F.lit(">")))
