"""The 75 seed triples."""

from __future__ import annotations

from lodestar.functions.terms import SUBCLASS, TYPE, name

# The built-in annotation properties.
ANNOTATIONS = "rdfs:label rdfs:comment rdfs:seeAlso rdfs:isDefinedBy owl:deprecated owl:versionInfo owl:priorVersion owl:backwardCompatibleWith owl:incompatibleWith".split()
# The datatypes of the profile.
DATATYPES = (
    "xsd:string xsd:boolean xsd:decimal xsd:integer xsd:double xsd:float xsd:date xsd:time xsd:dateTime xsd:dateTimeStamp "
    "xsd:gYear xsd:gMonth xsd:gDay xsd:gYearMonth xsd:gMonthDay xsd:duration xsd:yearMonthDuration xsd:dayTimeDuration "
    "xsd:anyURI xsd:hexBinary xsd:base64Binary xsd:normalizedString xsd:token xsd:language xsd:Name xsd:NCName xsd:NMTOKEN "
    "xsd:nonNegativeInteger xsd:positiveInteger xsd:nonPositiveInteger xsd:negativeInteger xsd:long xsd:int xsd:short xsd:byte "
    "xsd:unsignedLong xsd:unsignedInt xsd:unsignedShort xsd:unsignedByte rdf:PlainLiteral rdf:XMLLiteral rdfs:Literal xsd:anyAtomicType"
).split()
# Each datatype and the one it is derived from.
DERIVED = {
    "byte": "short", "short": "int", "int": "long", "long": "integer", "integer": "decimal",
    "positiveInteger": "nonNegativeInteger", "nonNegativeInteger": "integer",
    "negativeInteger": "nonPositiveInteger", "nonPositiveInteger": "integer",
    "unsignedByte": "unsignedShort", "unsignedShort": "unsignedInt", "unsignedInt": "unsignedLong", "unsignedLong": "nonNegativeInteger",
    "normalizedString": "string", "token": "normalizedString", "language": "token", "Name": "token", "NCName": "Name", "NMTOKEN": "token",
}


def axioms() -> list[tuple[str, str, str]]:
    found = [(name(p), TYPE, name("owl:AnnotationProperty")) for p in ANNOTATIONS]
    found.append((name("owl:differentFrom"), TYPE, name("owl:SymmetricProperty")))
    found += [(name(c), TYPE, name("owl:Class")) for c in ("owl:Thing", "owl:Nothing")]
    found.append((name("owl:NamedIndividual"), SUBCLASS, name("owl:Thing")))
    found += [(name(d), TYPE, name("rdfs:Datatype")) for d in DATATYPES]
    found += [(name(f"xsd:{a}"), SUBCLASS, name(f"xsd:{b}")) for a, b in DERIVED.items()]
    return found
