"""XSD values as column expressions: a literal becomes (kind, canonical string), or null if ill-typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.terms import datatype, lexical, name

# Fixed values of the standard: datatypes by value space family.
FAMILIES = {
    "integer": "integer long int short byte nonNegativeInteger nonPositiveInteger positiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte",
    "decimal": "decimal",
    "float": "float",
    "double": "double",
    "boolean": "boolean",
    "string": "string normalizedString token language Name NCName NMTOKEN",
    "anyURI": "anyURI",
    "hexBinary": "hexBinary",
    "base64Binary": "base64Binary",
    "date": "date",
    "time": "time",
    "dateTime": "dateTime dateTimeStamp",
    "duration": "duration yearMonthDuration dayTimeDuration",
    "gYear": "gYear",
    "gMonth": "gMonth",
    "gDay": "gDay",
    "gYearMonth": "gYearMonth",
    "gMonthDay": "gMonthDay",
}
FAMILY = {name(f"xsd:{d}"): f for f, every in FAMILIES.items() for d in every.split()}
FAMILY |= {name("rdf:PlainLiteral"): "plainLiteral", name("rdf:XMLLiteral"): "xmlLiteral"}
NUMERIC = ("integer", "decimal", "float", "double")
#: Families whose values are compared with each other.
KINDS = {"hexBinary": "binary", "base64Binary": "binary"} | dict.fromkeys(("date", "time", "dateTime", "duration", "gYear", "gMonth", "gDay", "gYearMonth", "gMonthDay"), "temporal")
UNPARSED = ("plainLiteral", "xmlLiteral")

# Fixed values of the standard: least and greatest integers.
BOUNDS = {
    "long": (-(2**63), 2**63 - 1),
    "int": (-(2**31), 2**31 - 1),
    "short": (-(2**15), 2**15 - 1),
    "byte": (-(2**7), 2**7 - 1),
    "nonNegativeInteger": (0, None),
    "nonPositiveInteger": (None, 0),
    "positiveInteger": (1, None),
    "negativeInteger": (None, -1),
    "unsignedLong": (0, 2**64 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 2**16 - 1),
    "unsignedByte": (0, 2**8 - 1),
}

# Integer types without a common value.
_UNSIGNED = "unsignedLong unsignedInt unsignedShort unsignedByte positiveInteger".split()
DISJOINT_INTEGERS = {("negativeInteger", d) for d in [*_UNSIGNED, "nonNegativeInteger"]} | {("nonPositiveInteger", d) for d in _UNSIGNED}


def disjoint_types() -> list[tuple[str, str]]:
    """All ordered pairs of datatypes without a common value; numeric families always share some."""
    apart = {(name(f"xsd:{a}"), name(f"xsd:{b}")) for a, b in DISJOINT_INTEGERS}
    apart |= {(b, a) for a, b in apart}
    apart |= {(a, b) for a, f in FAMILY.items() for b, g in FAMILY.items() if f != g and not (f in NUMERIC and g in NUMERIC)}
    return sorted(apart)


def lookup(table: dict, key: Column, of: str = "string") -> Column:
    """table as a literal map; null for other keys."""
    pairs = [F.lit(x).cast(t) for k, v in table.items() for x, t in ((k, "string"), (v, of))]
    return F.try_element_at(F.create_map(*pairs), key)


def family(term_datatype: Column) -> Column:
    return lookup(FAMILY, term_datatype)


LEAST = {name(f"xsd:{d}"): str(lo) for d, (lo, _) in BOUNDS.items() if lo is not None}
GREATEST = {name(f"xsd:{d}"): str(hi) for d, (_, hi) in BOUNDS.items() if hi is not None}
WIDE = "decimal(38,0)"


def _digits(lex: Column) -> Column:
    return F.regexp_replace(F.trim(lex), r"^[+-]?0*(?=[0-9])", "")


def _integer(lex: Column, digits: Column, dt: Column) -> Column:
    """Canonical digits if the form is valid and within the type's bounds; beyond 38 digits the sign decides."""
    negative = F.trim(lex).startswith("-") & (digits != "0")
    size = F.when(F.length(digits) <= 38, digits.try_cast(WIDE)).otherwise(F.lit("9" * 38).cast(WIDE))
    value = F.when(negative, -size).otherwise(size)
    fits = F.coalesce(value >= lookup(LEAST, dt, WIDE), F.lit(True)) & F.coalesce(value <= lookup(GREATEST, dt, WIDE), F.lit(True))
    return F.when(F.trim(lex).rlike(r"^[+-]?[0-9]+$") & fits, F.concat(F.when(negative, "-").otherwise(""), digits))


def _float(lex: Column) -> Column:
    s = F.trim(lex)
    number = F.when(s.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))
    finite = F.when(F.abs(number) < float("inf"), number.cast("string"))
    return F.when(s.isin("INF", "+INF"), "INF").when(s == "-INF", "-INF").when(s == "NaN", "NaN").otherwise(finite)


KIND = {d: KINDS.get(f, f) for d, f in FAMILY.items() if f not in UNPARSED}


def kind_of(term: Column) -> Column:
    """The name under which a literal's values are compared, whether or not the form is valid."""
    return lookup(KIND, datatype(term))


def _canonical(lex: Column, dt: Column, f: Column, digits: Column) -> Column:
    decimal = F.regexp_replace(F.trim(lex), r"^\+", "")
    return (
        F.when(f == "integer", _integer(lex, digits, dt))
        .when(f == "decimal", F.when(decimal.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), decimal))
        .when(f.isin("float", "double"), _float(lex))
        .when(f == "boolean", F.when(lex.isin("true", "1"), "true").when(lex.isin("false", "0"), "false"))
        .when(f == "hexBinary", F.upper(lex))
        .when(f == "base64Binary", F.regexp_replace(lex, r"\s", ""))
        .when(~f.isin(*UNPARSED), lex)
    )


def canonical(term: Column) -> Column:
    """A string that is equal for equal values of one kind; null if the form is invalid or the type unknown."""
    lex, dt = lexical(term), datatype(term)
    return _canonical(lex, dt, family(dt), _digits(lex))


def with_values(df: DataFrame, term: str) -> DataFrame:
    """The rows of df whose term is a well-typed literal, with its dt, lex, kind and canon.

    Each step is a column of its own, so that no expression is repeated in the generated code; the last
    step generates rows rather than filtering them, which keeps the filter from being pushed through the steps.
    """
    d = df.where(F.col(term).startswith('"')).withColumns({"dt": datatype(F.col(term)), "lex": lexical(F.col(term))})
    d = d.withColumns({"__f": family(F.col("dt")), "kind": lookup(KIND, F.col("dt")), "__digits": _digits(F.col("lex"))})
    d = d.withColumn("__canon", _canonical(*map(F.col, ("lex", "dt", "__f", "__digits"))))
    return d.select(*df.columns, "dt", "lex", "kind", F.explode(F.when(F.col("__canon").isNotNull(), F.array("__canon"))).alias("canon"))


def values_equal(a: Column, b: Column) -> Column:
    """True or false for values of one kind; null where they can't be compared."""
    return F.when(kind_of(a) == kind_of(b), canonical(a) == canonical(b))
