"""Relational tables as triples: each lift is one SELECT of s, p, o that Spark and any SQL engine read alike."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.terms import FIRST, NIL, REST, TYPE, name

LIFTS = {
    "placed_by": "SELECT concat('<ex:order/', o_orderkey, '>') AS s, '<ex:placedBy>' AS p, concat('<ex:cust/', o_custkey, '>') AS o FROM {orders}",
    "cust_nation": "SELECT concat('<ex:cust/', c_custkey, '>') AS s, '<ex:locatedIn>' AS p, concat('<ex:nation/', c_nationkey, '>') AS o FROM {customer}",
    "supp_nation": "SELECT concat('<ex:supp/', s_suppkey, '>') AS s, '<ex:locatedIn>' AS p, concat('<ex:nation/', s_nationkey, '>') AS o FROM {supplier}",
    "nation_region": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '<ex:locatedIn>' AS p, concat('<ex:region/', n_regionkey, '>') AS o FROM {nation}",
    "region_member": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '<ex:inRegion>' AS p, concat('<ex:region/', n_regionkey, '>') AS o FROM {nation}",
    "borders": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '<ex:borders>' AS p, concat('<ex:nation/', (n_nationkey + 1) % 25, '>') AS o FROM {nation}",
    "self_border": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '<ex:borders>' AS p, concat('<ex:nation/', n_nationkey, '>') AS o FROM {nation} WHERE n_nationkey % 7 = 0",
    "back_border": "SELECT concat('<ex:nation/', (n_nationkey + 1) % 25, '>') AS s, '<ex:borders>' AS p, concat('<ex:nation/', n_nationkey, '>') AS o FROM {nation} WHERE n_nationkey % 5 = 0",
    "not_border": "SELECT concat('<ex:npa/', n_nationkey, '>') AS s, '@rdf:type' AS p, '@owl:NegativePropertyAssertion' AS o FROM {nation}",
    "npa_source": "SELECT concat('<ex:npa/', n_nationkey, '>') AS s, '@owl:sourceIndividual' AS p, concat('<ex:nation/', n_nationkey, '>') AS o FROM {nation}",
    "npa_border": "SELECT concat('<ex:npa/', n_nationkey, '>') AS s, '@owl:targetIndividual' AS p, concat('<ex:nation/', (n_nationkey * n_nationkey + 1) % 25, '>') AS o FROM {nation}",
    "npa_name": "SELECT concat('<ex:npa/', n_nationkey, '>') AS s, '@owl:targetValue' AS p, concat('\"', CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'none' END, '\"^^@xsd:token') AS o FROM {nation}",
    "npa_p_border": "SELECT concat('<ex:npa/', n_nationkey, '>') AS s, '@owl:assertionProperty' AS p, '<ex:borders>' AS o FROM {nation}",
    "npa_p_name": "SELECT concat('<ex:npa/', n_nationkey, '>') AS s, '@owl:assertionProperty' AS p, '<ex:called>' AS o FROM {nation}",
    "called": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '<ex:called>' AS p, concat('\"', n_name, '\"^^@xsd:string') AS o FROM {nation}",
    "regions_differ": "SELECT concat('<ex:region/', r_regionkey, '>') AS s, '@owl:differentFrom' AS p, concat('<ex:region/', (r_regionkey + 1) % 5, '>') AS o FROM {region}",
    "nations_differ": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '@owl:differentFrom' AS p, concat('<ex:nation/', (n_nationkey + 3) % 25, '>') AS o FROM {nation}",
    "has_part": "SELECT DISTINCT concat('<ex:order/', l_orderkey, '>') AS s, '<ex:hasPart>' AS p, concat('<ex:part/', l_partkey, '>') AS o FROM {lineitem}",
    "has_supp": "SELECT DISTINCT concat('<ex:order/', l_orderkey, '>') AS s, '<ex:suppliedBy>' AS p, concat('<ex:supp/', l_suppkey, '>') AS o FROM {lineitem}",
    "next_turn": "SELECT concat('<ex:turn/', conv_id, '/', turn - 1, '>') AS s, '<ex:nextTurn>' AS p, concat('<ex:turn/', conv_id, '/', turn, '>') AS o FROM {conversations} WHERE turn > 0",
    "digest": "SELECT concat('<ex:doc/', doc_id, '>') AS s, '<ex:digest>' AS p, concat('\"', md5(text), '\"^^@xsd:string') AS o FROM {documents}",
    "doc_lang": "SELECT concat('<ex:doc/', doc_id, '>') AS s, '<ex:lang>' AS p, concat('\"', lang, '\"^^@xsd:string') AS o FROM {documents}",
    "doc_type": "SELECT concat('<ex:doc/', doc_id, '>') AS s, '@rdf:type' AS p, '<ex:Document>' AS o FROM {documents}",
    "digest_source": "SELECT DISTINCT concat('<ex:text/', md5(text), '>') AS s, '<ex:source>' AS p, concat('<ex:src/', source, '>') AS o FROM {documents}",
    "digest_source_name": "SELECT DISTINCT concat('<ex:text/', md5(text), '>') AS s, '<ex:sourceName>' AS p, concat('\"', source, '\"^^@xsd:string') AS o FROM {documents}",
    "good": "SELECT concat('<ex:doc/', doc_id, '>') AS s, '@rdf:type' AS p, '<ex:HighQuality>' AS o FROM {labels} WHERE quality = 1",
    "toxic": "SELECT concat('<ex:doc/', doc_id, '>') AS s, '@rdf:type' AS p, '<ex:Toxic>' AS o FROM {labels} WHERE toxic = 1",
    "likes": "SELECT concat('<ex:doc/', doc_id, '>') AS s, '<ex:likes>' AS p, concat('<ex:mark/', quality, '>') AS o FROM {labels}",
    "dislikes": "SELECT concat('<ex:doc/', doc_id, '>') AS s, '<ex:dislikes>' AS p, concat('<ex:mark/', toxic, '>') AS o FROM {labels}",
    "status": "SELECT concat('<ex:order/', o_orderkey, '>') AS s, '<ex:status>' AS p, concat('\"', o_orderstatus, '\"^^@xsd:string') AS o FROM {orders}",
    "order_type": "SELECT concat('<ex:order/', o_orderkey, '>') AS s, '@rdf:type' AS p, concat('<ex:Status/', o_orderstatus, '>') AS o FROM {orders}",
    "nation_type": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '@rdf:type' AS p, concat('<ex:NationOf/', n_regionkey, '>') AS o FROM {nation}",
    "nation_thing": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '@rdf:type' AS p, '@owl:Thing' AS o FROM {nation}",
    "nation_nothing": "SELECT concat('<ex:nation/', n_nationkey, '>') AS s, '@rdf:type' AS p, '@owl:Nothing' AS o FROM {nation} WHERE n_nationkey % 6 = 0",
    "brand": "SELECT concat('<ex:part/', p_partkey, '>') AS s, '@rdf:type' AS p, concat('<ex:', p_brand, '>') AS o FROM {part}",
    "brand_class": "SELECT DISTINCT concat('<ex:', p_brand, '>') AS s, '@rdfs:subClassOf' AS p, concat('<ex:Maker/', substr(p_brand, 7, 1), '>') AS o FROM {part}",
    "maker_class": "SELECT DISTINCT concat('<ex:Maker/', substr(p_brand, 7, 1), '>') AS s, '@rdfs:subClassOf' AS p, '<ex:Product>' AS o FROM {part}",
    "brand_decl": "SELECT DISTINCT concat('<ex:', p_brand, '>') AS s, '@rdf:type' AS p, '@owl:Class' AS o FROM {part}",
    "brand_equal": "SELECT DISTINCT concat('<ex:', p_brand, '>') AS s, '@owl:equivalentClass' AS p, concat('<ex:Label/', p_brand, '>') AS o FROM {part}",
    "size": "SELECT concat('<ex:part/', p_partkey, '>') AS s, '<ex:size>' AS p, concat('\"', p_size, '\"^^@xsd:integer') AS o FROM {part}",
    "padded": "SELECT concat('<ex:part/', p_partkey, '>') AS s, '<ex:padded>' AS p, concat('\"', lpad(CAST(p_size AS STRING), 3, '0'), '\"^^@xsd:short') AS o FROM {part}",
    "bad_size": "SELECT concat('<ex:part/', p_partkey, '>') AS s, '<ex:size>' AS p, concat('\"', p_size * 10, '\"^^@xsd:byte') AS o FROM {part}",
    "copies": "SELECT concat('<ex:doc/', a.doc_id, '>') AS s, '@owl:sameAs' AS p, concat('<ex:doc/', b.first_id, '>') AS o FROM {documents} a JOIN (SELECT md5(text) AS h, min(doc_id) AS first_id FROM {documents} GROUP BY md5(text)) b ON md5(a.text) = b.h WHERE a.doc_id > b.first_id",
    "first_differs": "SELECT concat('<ex:doc/', doc_id, '>') AS s, '@owl:differentFrom' AS p, concat('<ex:doc/', doc_id - doc_id % 2, '>') AS o FROM {documents} WHERE doc_id % 2 = 1",
}
TOKEN = re.compile(r"@((?:rdf|rdfs|owl|xsd):\w+)")


def terms_in(sql: str) -> str:
    """@prefix:name as the term it stands for."""
    return TOKEN.sub(lambda m: name(m[1]), sql)


def lift(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    sql = terms_in(LIFTS[key])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def list_triples(lists: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    """Cells of RDF lists; a head names its first cell."""
    out = []
    for head, members in lists.items():
        cells = [head, *(f"_:{head.strip('<>')}#{i}" for i in range(1, len(members)))]
        for i, m in enumerate(members):
            out += [(cells[i], FIRST, m), (cells[i], REST, cells[i + 1] if i + 1 < len(members) else NIL)]
    return out


def graph(spark: SparkSession, sf_dir: str, lifts: list[str], schema: list[tuple[str, str, str]], lists: dict[str, list[str]] | None = None) -> DataFrame:
    """s, p, o of some lifts, schema triples and lists, with set semantics."""
    parts = [lift(spark, sf_dir, k) for k in lifts]
    fixed = [*schema, *list_triples(lists or {})]
    if fixed:
        parts.append(spark.createDataFrame(fixed, "s string, p string, o string"))
    return reduce(DataFrame.unionByName, parts).distinct()


def graph_sql(lifts: list[str], schema: list[tuple[str, str, str]], lists: dict[str, list[str]] | None = None) -> str:
    """The same graph as a common table expression t(s, p, o), and the lists as lst(head, pos, member, size)."""
    parts = [re.sub(r"\{(\w+)\}", r"\1", terms_in(LIFTS[k])) for k in lifts]
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    if schema:
        parts.append("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(quote, r))})" for r in schema) + ") v(s, p, o)")
    out = "WITH RECURSIVE t AS (" + " UNION ".join(f"({p})" for p in parts) + ")"
    rows = [(h, i, m, len(ms)) for h, ms in (lists or {}).items() for i, m in enumerate(ms)]
    if rows:
        out += ", lst(head, pos, member, size) AS (VALUES " + ", ".join(f"({quote(h)}, {i}, {quote(m)}, {n})" for h, i, m, n in rows) + ")"
    return out


__all__ = ["LIFTS", "TYPE", "graph", "graph_sql", "lift", "list_triples", "terms_in"]
