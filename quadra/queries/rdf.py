"""RDF queries: nations, regions and suppliers as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.operators import rdf
from quadra.plans import sparql
from quadra.sources.tables import table

REGISTERED: dict = {}
E = "urn:x:"


def graph(spark: SparkSession, d: str) -> DataFrame:
    """Triples of three tables, rings of suppliers (forty to a ring at most), and one named graph."""
    n, r, s = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier")
    node = lambda kind, c: rdf.iri(F.concat(F.lit(f"{E}{kind}"), F.col(c)))
    whole = lambda c: rdf.literal(F.col(c).cast("long"), rdf.XSD + "integer")

    def some(df: DataFrame, subject, pairs: list, name: str = "") -> DataFrame:
        spots = F.array(*[F.named_struct(F.lit("p"), rdf.iri(E + p), F.lit("o"), o) for p, o in pairs])
        return df.select(F.lit(name).alias("graph"), subject.alias("s"), F.explode(spots).alias("x")).select("graph", "s", "x.p", "x.o")

    t = some(n, node("nation", "n_nationkey"), [("name", rdf.literal(F.col("n_name"))), ("in", node("region", "n_regionkey")), ("key", whole("n_nationkey"))])
    t = t.unionByName(some(r, node("region", "r_regionkey"), [("name", rdf.literal(F.col("r_name"))), ("key", whole("r_regionkey"))]))
    t = t.unionByName(some(s, node("supplier", "s_suppkey"), [("of", node("nation", "s_nationkey")), ("balance", rdf.literal(F.col("s_acctbal"), rdf.XSD + "double")), ("key", whole("s_suppkey"))]))
    k = F.col("s_suppkey")
    ring = s.withColumn("nxt", k - k % 40 + (k * 3 + 2) % 40)
    t = t.unionByName(some(ring, node("supplier", "s_suppkey"), [("next", node("supplier", "nxt"))]))
    return rdf.graph_of(t.unionByName(some(r, node("region", "r_regionkey"), [("name", rdf.literal(F.lower("r_name")))], E + "g")))


_P = f"PREFIX x: <{E}> "


def _rdf(name: str, text: str, oracle: str | None, after=sparql.lexical) -> None:
    REGISTERED[name] = (lambda spark, d: after(sparql.query(_default(graph(spark, d)) if "GRAPH" not in text else graph(spark, d), _P + text)), oracle)


def _default(g: DataFrame) -> DataFrame:
    return g.where("graph = ''")


_N = "'urn:x:nation' || n_nationkey"
_NEXT = "s_suppkey - s_suppkey % 40 + (s_suppkey * 3 + 2) % 40"
_CH = f"ch AS (SELECT s_suppkey AS a, {_NEXT} AS b FROM supplier)"
_rdf("rdf_bgp", "SELECT ?n ?rn WHERE { ?n x:in ?r . ?r x:name ?rn . ?s x:of ?n }", f"SELECT {_N} AS n, r_name AS rn FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
_rdf("rdf_filter", "SELECT ?s ?b WHERE { ?s x:balance ?b ; x:key ?k FILTER(?b > 5000 && (?k < 50 || STRLEN(STR(?k)) > 5) && !(?k = 3)) }", "SELECT 'urn:x:supplier' || s_suppkey AS s, CAST(s_acctbal AS VARCHAR) AS b FROM supplier WHERE s_acctbal > 5000 AND s_suppkey < 50 AND s_suppkey <> 3")
_rdf("rdf_bind", "SELECT ?n ?twice ?third ?u WHERE { ?n x:in ?r ; x:key ?k ; x:name ?m BIND(?k * 2 + 1 AS ?twice) BIND(?k / 4 AS ?third) BIND(LCASE(?m) AS ?u) }", f"SELECT {_N} AS n, CAST(n_nationkey * 2 + 1 AS VARCHAR) AS twice, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey // 4 AS VARCHAR) ELSE CAST(n_nationkey / 4 AS VARCHAR) END AS third, lower(n_name) AS u FROM nation")
_rdf("rdf_union", "SELECT ?x ?n WHERE { { ?x x:in x:region1 } UNION { ?x x:name ?n FILTER(?n = 'ASIA') } }", f"SELECT {_N} AS x, NULL::VARCHAR AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'urn:x:region' || r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
_rdf("rdf_optional", "SELECT ?r ?n WHERE { ?r x:name ?m ; x:key ?k OPTIONAL { ?n x:in ?r . ?n x:key ?j FILTER(?j > 20) } FILTER(?k < 5) }", f"SELECT 'urn:x:region' || r_regionkey AS r, CASE WHEN n_nationkey IS NOT NULL THEN {_N} END AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 20 UNION ALL SELECT {_N}, NULL FROM nation WHERE n_nationkey < 5")
_rdf("rdf_path_plus", "SELECT ?a ?b WHERE { ?a x:next+ ?b }", f"WITH RECURSIVE {_CH}, r AS (SELECT a, b FROM ch UNION SELECT r.a, ch.b FROM r JOIN ch ON ch.a = r.b) SELECT 'urn:x:supplier' || a AS a, 'urn:x:supplier' || b AS b FROM r")
_rdf("rdf_path_star", "SELECT ?b WHERE { x:supplier5 x:next* ?b }", f"WITH RECURSIVE {_CH}, r AS (SELECT 5::BIGINT AS b UNION SELECT ch.b FROM r JOIN ch ON ch.a = r.b) SELECT 'urn:x:supplier' || b AS b FROM r")
_rdf("rdf_path_bound", "SELECT ?n ?b WHERE { ?a x:next+ ?b . ?a x:of ?n . ?n x:in x:region1 }", f"WITH RECURSIVE {_CH}, r AS (SELECT a, b FROM ch UNION SELECT r.a, ch.b FROM r JOIN ch ON ch.a = r.b) SELECT {_N} AS n, 'urn:x:supplier' || b AS b FROM r JOIN supplier ON s_suppkey = a JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1")
_rdf("rdf_after_optional", "SELECT ?r ?n ?m WHERE { ?r x:key ?k . ?r x:name ?rn OPTIONAL { ?n x:in ?r . ?n x:key ?j FILTER(?j > 12) } ?n x:name ?m FILTER(?rn = 'ASIA') }", f"SELECT 'urn:x:region' || r_regionkey AS r, {_N} AS n, n_name AS m FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey > 12 AND r_name = 'ASIA' UNION ALL SELECT 'urn:x:region' || r_regionkey, x.s, x.m FROM region, (SELECT {_N} AS s, n_name AS m FROM nation UNION ALL SELECT 'urn:x:region' || r_regionkey, r_name FROM region) x WHERE r_name = 'ASIA' AND NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 12)")
_rdf("rdf_after_union", "SELECT ?x ?n ?r WHERE { { ?x x:in x:region1 } UNION { ?x x:of ?n . ?x x:key ?k FILTER(?k < 9) } ?n x:in ?r }", f"SELECT {_N.replace('n_', 'a.n_')} AS x, 'urn:x:nation' || b.n_nationkey AS n, 'urn:x:region' || b.n_regionkey AS r FROM nation a, nation b WHERE a.n_regionkey = 1 UNION ALL SELECT 'urn:x:supplier' || s_suppkey, {_N}, 'urn:x:region' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey < 9")
_rdf("rdf_path_inverse", "SELECT ?n WHERE { x:region2 ^x:in ?n }", f"SELECT {_N} AS n FROM nation WHERE n_regionkey = 2")
_rdf("rdf_path_optional", "SELECT ?b WHERE { x:nation4 x:in? ?b }", "SELECT 'urn:x:nation4' AS b UNION SELECT 'urn:x:region' || n_regionkey FROM nation WHERE n_nationkey = 4")
_rdf("rdf_count_group", "SELECT ?r (COUNT(*) AS ?n) (COUNT(DISTINCT ?k) AS ?d) WHERE { ?n x:in ?r . ?s x:of ?n . ?n x:key ?k } GROUP BY ?r", "SELECT 'urn:x:region' || n_regionkey AS r, CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT n_nationkey) AS VARCHAR) AS d FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey")
_rdf("rdf_count_empty", "SELECT (COUNT(*) AS ?n) WHERE { ?s x:nothing ?o }", "SELECT '0' AS n")
_rdf("rdf_order_limit", "SELECT DISTINCT ?k WHERE { ?s x:key ?k } ORDER BY DESC(?k) LIMIT 10 OFFSET 5", "SELECT CAST(k AS VARCHAR) AS k FROM (SELECT DISTINCT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region UNION ALL SELECT s_suppkey FROM supplier)) ORDER BY k.k DESC LIMIT 10 OFFSET 5".replace("k.k", "k"))
REGISTERED["rdf_order_limit"] = (REGISTERED["rdf_order_limit"][0], "SELECT CAST(v AS VARCHAR) AS k FROM (SELECT DISTINCT v FROM (SELECT n_nationkey AS v FROM nation UNION ALL SELECT r_regionkey FROM region UNION ALL SELECT s_suppkey FROM supplier) ORDER BY v DESC LIMIT 10 OFFSET 5)")
_rdf("rdf_named_graph", "SELECT ?r ?n WHERE { GRAPH x:g { ?r x:name ?n } }", "SELECT 'urn:x:region' || r_regionkey AS r, lower(r_name) AS n FROM region")
_rdf("rdf_repeated_var", "SELECT ?a WHERE { ?a x:next ?a }", f"SELECT 'urn:x:supplier' || s_suppkey AS a FROM supplier WHERE {_NEXT} = s_suppkey")
_rdf("rdf_ask", "ASK { ?s x:name 'ASIA' }", "SELECT count(*) > 0 AS ask FROM region WHERE r_name = 'ASIA'", lambda df: df)
_rdf("rdf_construct", "CONSTRUCT { ?r x:holds ?n } WHERE { ?n x:in ?r }", "SELECT DISTINCT 'urn:x:region' || n_regionkey AS s, 'urn:x:holds' AS p, 'urn:x:nation' || n_nationkey AS o FROM nation")
_rdf("rdf_describe", "DESCRIBE x:nation7", "SELECT 'urn:x:nation7' AS s, p, o FROM (SELECT unnest(['urn:x:name', 'urn:x:in', 'urn:x:key']) AS p, unnest([n_name, 'urn:x:region' || n_regionkey, '7']) AS o FROM nation WHERE n_nationkey = 7)")
_rdf("rdf_describe_var", "DESCRIBE ?n WHERE { ?n x:in x:region3 }", "SELECT 'urn:x:nation' || n_nationkey AS s, unnest(['urn:x:name', 'urn:x:in', 'urn:x:key']) AS p, unnest([n_name, 'urn:x:region3', CAST(n_nationkey AS VARCHAR)]) AS o FROM nation WHERE n_regionkey = 3")
REGISTERED["rdf_n_triples"] = (lambda spark, d: rdf.n_triples(sparql.query(_default(graph(spark, d)), _P + "CONSTRUCT { ?r x:key ?k } WHERE { ?n x:in ?r . ?r x:key ?k }")), """SELECT DISTINCT '<urn:x:region' || n_regionkey || '> <urn:x:key> "' || n_regionkey || '"^^<http://www.w3.org/2001/XMLSchema#integer> .' AS line FROM nation""")
REGISTERED["rdf_json"] = (lambda spark, d: rdf.json_bindings(sparql.query(_default(graph(spark, d)), _P + "SELECT ?n WHERE { x:region2 x:name ?n }")), """SELECT '{"n":{"type":"literal","value":"' || r_name || '","datatype":"http://www.w3.org/2001/XMLSchema#string"}}' AS binding FROM region WHERE r_regionkey = 2""")


def rdf_update(spark: SparkSession, d: str) -> DataFrame:
    g = sparql.update(_default(graph(spark, d)), _P + """INSERT DATA { x:nation99 x:in x:region1 ; x:key 99 } ;
      DELETE { ?n x:in x:region2 } INSERT { ?n x:in x:region9 } WHERE { ?n x:in x:region2 } ; DELETE DATA { x:nation0 x:in x:region0 } ; DELETE WHERE { ?r x:in x:region4 }""")
    return sparql.lexical(sparql.query(g, _P + "SELECT ?n ?r WHERE { ?n x:in ?r }"))


REGISTERED["rdf_update"] = (rdf_update, f"SELECT {_N} AS n, 'urn:x:region' || CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS r FROM nation WHERE n_regionkey <> 4 AND NOT (n_nationkey = 0 AND n_regionkey = 0) UNION ALL SELECT 'urn:x:nation99', 'urn:x:region1'")
REGISTERED["rdf_turtle"] = (lambda spark, d: rdf.turtle(sparql.query(_default(graph(spark, d)), _P + "CONSTRUCT { ?r x:holds ?n } WHERE { ?n x:in ?r }")), """SELECT '<urn:x:region' || n_regionkey || '> <urn:x:holds> ' || string_agg('<urn:x:nation' || n_nationkey || '>', ', ' ORDER BY '<urn:x:nation' || n_nationkey || '>') || ' .' AS block FROM nation GROUP BY n_regionkey""")
REGISTERED["rdf_xml"] = (lambda spark, d: rdf.xml_results(sparql.query(_default(graph(spark, d)), _P + "SELECT ?n WHERE { ?n x:in x:region2 }")), "SELECT '<result><binding name=\"n\"><uri>urn:x:nation' || n_nationkey || '</uri></binding></result>' AS result FROM nation WHERE n_regionkey = 2")

_rdf("rdf_triple_term", "SELECT ?n ?t WHERE { ?n x:in ?r BIND(TRIPLE(?n, x:in, ?r) AS ?t) FILTER(BOUND(?t)) }", f"""SELECT {_N} AS n, '{{"s":{{"kind":"iri","value":"' || {_N} || '"}},"p":{{"kind":"iri","value":"urn:x:in"}},"o":{{"kind":"iri","value":"urn:x:region' || n_regionkey || '"}}}}' AS t FROM nation""")
