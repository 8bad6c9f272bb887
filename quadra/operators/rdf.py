"""Triples as DataFrames: terms, access, paths, updates, and result formats.

A term is a struct (kind, value, datatype, lang); two terms are the same if all four parts are. A graph holds a
triple once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadra.operators.graph import grow

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TERM = "struct<kind:string,value:string,datatype:string,lang:string>"
_NUMERIC = [XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]
_INTEGERS = [XSD + t for t in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")]


def term(kind: str, value: Column | str, datatype: str | None = None, lang: str | None = None) -> Column:
    v = F.lit(value) if isinstance(value, str) else value.cast("string")
    # named outright: names by alias get lost inside generators
    return F.named_struct(F.lit("kind"), F.lit(kind), F.lit("value"), v, F.lit("datatype"), F.lit(datatype).cast("string"), F.lit("lang"), F.lit(lang).cast("string"))


def iri(value: Column | str) -> Column:
    return term("iri", value)


def literal(value: Column | str, datatype: str = XSD + "string") -> Column:
    return term("literal", value, datatype)


def graph_of(triples: DataFrame) -> DataFrame:
    """(graph, s, p, o) with every triple once per graph; missing graph means the default one."""
    g = F.coalesce(F.col("graph"), F.lit("")) if "graph" in triples.columns else F.lit("")
    return triples.select(g.alias("graph"), "s", "p", "o").distinct()


def number(t: Column) -> Column:
    """The number of a numeric literal, else null."""
    return F.when((t["kind"] == "literal") & t["datatype"].isin(_NUMERIC), t["value"].try_cast("double"))


def is_integer(t: Column) -> Column:
    return (t["kind"] == "literal") & t["datatype"].isin(_INTEGERS)


def closure(edges: DataFrame, starts: DataFrame | None, zero: bool, many: bool) -> DataFrame:
    """(s, o): pairs joined by one edge (``many``: by one or more), and each start with itself if ``zero``; a set of pairs."""
    first = edges.select("s", "o").distinct()
    if starts is not None:
        first = first.join(starts.select(F.col("s").alias("_s")).distinct(), F.col("s") == F.col("_s"), "left_semi")
    after = edges.select(F.col("s").alias("_f"), "o")
    step = lambda front, _: front.select("s", F.col("o").alias("_m")).join(after, F.col("_m") == F.col("_f")).select("s", "o").distinct()
    seen = grow(first, step, ["s", "o"], None if many else 0)
    if zero:
        own = starts if starts is not None else edges.select("s").unionByName(edges.select(F.col("o").alias("s")))
        seen = seen.unionByName(own.select("s", F.col("s").alias("o"))).distinct()
    return seen


def insert(graph: DataFrame, triples: DataFrame) -> DataFrame:
    return graph_of(graph.unionByName(graph_of(triples)))


def delete(graph: DataFrame, triples: DataFrame) -> DataFrame:
    gone = graph_of(triples)
    on = [graph[c].eqNullSafe(gone[c]) if c == "graph" else _same(graph[c], gone[c]) for c in ("graph", "s", "p", "o")]
    return graph.join(gone, on, "left_anti")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def clear(graph: DataFrame, name: str | None = None) -> DataFrame:
    """Drop one named graph, or all."""
    return graph.where(F.lit(False)) if name is None else graph.where(F.col("graph") != name)


def _text(t: Column) -> Column:
    body = F.concat(F.lit('"'), F.replace(F.replace(t["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.replace(body, F.lit("\n"), F.lit("\\n"))
    tagged = F.when(t["lang"].isNotNull(), F.concat(body, F.lit("@"), t["lang"])).when(t["datatype"].isNotNull() & (t["datatype"] != XSD + "string"), F.concat(body, F.lit("^^<"), t["datatype"], F.lit(">"))).otherwise(body)
    return F.when(t["kind"] == "iri", F.concat(F.lit("<"), t["value"], F.lit(">"))).when(t["kind"] == "blank", F.concat(F.lit("_:"), t["value"])).otherwise(tagged)


def n_triples(triples: DataFrame) -> DataFrame:
    """(line) of N-Triples."""
    return triples.select(F.concat_ws(" ", _text(F.col("s")), _text(F.col("p")), _text(F.col("o")), F.lit(".")).alias("line"))


def json_bindings(solutions: DataFrame) -> DataFrame:
    """(binding): one JSON object per solution, unbound variables left out."""
    cells = []
    for v in solutions.columns:
        t = F.col(f"`{v}`")
        kind = F.when(t["kind"] == "iri", "uri").when(t["kind"] == "blank", "bnode").otherwise("literal")
        cells.append(F.when(t.isNotNull(), F.struct(kind.alias("type"), t["value"].alias("value"), t["datatype"].alias("datatype"), t["lang"].alias("xml:lang"))).alias(v))
    return solutions.select(F.to_json(F.struct(*cells)).alias("binding"))


def _escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def xml_results(solutions: DataFrame) -> DataFrame:
    """(result): one XML result element per solution, unbound variables left out."""
    cells = []
    for v in solutions.columns:
        t = F.col(f"`{v}`")
        text = _escaped(t["value"])
        tag = F.when(t["lang"].isNotNull(), F.concat(F.lit('<literal xml:lang="'), t["lang"], F.lit('">'))).when(t["datatype"].isNotNull(), F.concat(F.lit('<literal datatype="'), t["datatype"], F.lit('">'))).otherwise("<literal>")
        body = F.when(t["kind"] == "iri", F.concat(F.lit("<uri>"), text, F.lit("</uri>"))).when(t["kind"] == "blank", F.concat(F.lit("<bnode>"), text, F.lit("</bnode>"))).otherwise(F.concat(tag, text, F.lit("</literal>")))
        cells.append(F.when(t.isNotNull(), F.concat(F.lit(f'<binding name="{v}">'), body, F.lit("</binding>"))).otherwise(""))
    return solutions.select(F.concat(F.lit("<result>"), *cells, F.lit("</result>")).alias("result"))


def turtle(triples: DataFrame) -> DataFrame:
    """(block): Turtle, one block per subject and predicate with its objects in order."""
    by = triples.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list(_text(F.col("o")))), ", ").alias("os"))
    return by.select(F.concat(_text(F.col("s")), F.lit(" "), _text(F.col("p")), F.lit(" "), F.col("os"), F.lit(" .")).alias("block"))
