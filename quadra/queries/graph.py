"""Graph queries: customers, orders, parts, suppliers, nations and regions as a property graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.operators.graph import Edges, Graph, adjacency
from quadra.plans import cypher
from quadra.sources.tables import table

REGISTERED: dict = {}


_VERTICES = {"Customer": ("customer", "c_custkey"), "Order": ("orders", "o_orderkey"), "Part": ("part", "p_partkey"), "Supplier": ("supplier", "s_suppkey"), "Nation": ("nation", "n_nationkey"), "Region": ("region", "r_regionkey")}
# type: (table, source column, target column, source label, target label, further columns)
_EDGES = {
    "PLACED": [("orders", "o_custkey", "o_orderkey", "Customer", "Order", ["o_orderdate"])],
    "CONTAINS_PART": [("lineitem", "l_orderkey", "l_partkey", "Order", "Part", ["l_quantity"])],
    "SUPPLIES": [("lineitem", "l_suppkey", "l_partkey", "Supplier", "Part", None)],
    "IN_NATION": [("customer", "c_custkey", "c_nationkey", "Customer", "Nation", []), ("supplier", "s_suppkey", "s_nationkey", "Supplier", "Nation", [])],
    "PART_OF": [("nation", "n_nationkey", "n_regionkey", "Nation", "Region", [])],
    "KNOWS": [("customer", "src", "dst", "Customer", "Customer", ["weight"])],
}


def graph(spark: SparkSession, d: str, text: str = "") -> Graph:
    """The labels and types that ``text`` names, with the labels at their ends (all for an empty text)."""
    types = {t for t in _EDGES if not text or re.search(rf":{t}\b", text)}
    labels = {x for x in _VERTICES if not text or re.search(rf":{x}\b", text)} | {x for t in types for e in _EDGES[t] for x in e[3:5]}
    read: dict[str, DataFrame] = {}

    def load(name: str) -> DataFrame:
        if name not in read:
            read[name] = table(spark, d, name)
        return read[name]

    def edges(kind: str, name: str, src: str, dst: str, source: str, target: str, more: list[str] | None) -> Edges:
        df = load(name)
        if kind == "KNOWS":
            size = df.agg((F.max("c_custkey") + 1).alias("n"))
            ring = df.select("c_custkey").crossJoin(F.broadcast(size))  # one row on the right
            df = ring.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + 3) % F.col("n")).alias("dst"), (F.col("c_custkey") % 5).alias("weight"))
        elif more is None:
            df = df.select(src, dst).distinct()
        else:
            df = df.select(src, dst, *more)
        return Edges(df, src, dst, source, target)

    return Graph({x: (load(_VERTICES[x][0]), _VERTICES[x][1]) for x in _VERTICES if x in labels}, {t: [edges(t, *e) for e in _EDGES[t]] for t in _EDGES if t in types})


def _cy(name: str, text: str, oracle: str | None, after=None, params: dict | None = None) -> None:
    def go(spark: SparkSession, d: str) -> DataFrame:
        out = cypher.query(graph(spark, d, text), spark, text, params)
        return after(out) if after else out

    REGISTERED[name] = (go, oracle)


_K = "k AS (SELECT c_custkey AS src, (c_custkey * 7 + 3) % (SELECT max(c_custkey) + 1 FROM customer) AS dst, c_custkey % 5 AS weight FROM customer)"
_cy("cy_hop1", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_totalprice > 300000")
_cy("cy_hop2", "MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:IN_NATION]->(n:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
_cy("cy_both", "MATCH (a:Customer)-[k:KNOWS]-(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b, k.weight AS w", f"WITH {_K} SELECT src AS a, dst AS b, weight AS w FROM k UNION ALL SELECT dst, src, weight FROM k")
_cy("cy_rel_props", "MATCH (a:Customer)-[:KNOWS {weight: 3}]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", f"WITH {_K} SELECT src AS a, dst AS b FROM k WHERE weight = 3")
_cy("cy_optional", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 5000 RETURN n.n_name AS nation, count(s) AS n", "SELECT n_name AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
_cy("cy_not_pattern", "MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS_PART]-(:Order {o_orderkey: 7}) AND p.p_size > 10 RETURN p.p_partkey AS p", "SELECT p_partkey AS p FROM part WHERE p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 7)")
_cy("cy_pattern_pred", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {o_orderpriority: '1-URGENT'}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
_cy("cy_collect", "MATCH (n:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS region, collect(n.n_name) AS names, sum(n.n_nationkey) AS total, min(n.n_nationkey) AS low, avg(n.n_nationkey) AS mean", "SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(sum(n_nationkey) AS DOUBLE) AS total, CAST(min(n_nationkey) AS DOUBLE) AS low, avg(n_nationkey) AS mean FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", lambda df: df.withColumn("names", F.array_join(F.array_sort("names"), ",")))
_VAR = """WITH RECURSIVE {k}, r AS (SELECT c_custkey AS a, c_custkey AS b, 0 AS depth FROM customer UNION ALL SELECT a, dst, depth + 1 FROM r JOIN k ON src = b WHERE depth < {m})
SELECT a, b FROM (SELECT a, b, min(depth) AS depth FROM r GROUP BY a, b) WHERE depth >= {n}"""
_cy("cy_varlen", "MATCH (a:Customer)-[:KNOWS*1..3]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", _VAR.format(k=_K, m=3, n=1))
_cy("cy_varlen_min", "MATCH (a:Customer)-[:KNOWS*2..4]->(b:Customer) RETURN a.c_custkey AS a, b.c_custkey AS b", _VAR.format(k=_K, m=4, n=2))
_cy("cy_triangle", "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(c:Customer), (c)-[:PLACED]->(o:Order)-[:CONTAINS_PART]->(p:Part)<-[:SUPPLIES]-(s) RETURN s.s_suppkey AS s, c.c_custkey AS c, p.p_partkey AS p", "SELECT s_suppkey AS s, c_custkey AS c, p_partkey AS p FROM supplier JOIN customer ON s_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN part ON p_partkey = l.l_partkey JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x ON x.l_suppkey = s_suppkey AND x.l_partkey = p_partkey")
_cy("cy_union", "MATCH (n:Nation) RETURN n.n_regionkey AS k UNION MATCH (r:Region) RETURN r.r_regionkey AS k", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
_cy("cy_union_all", "MATCH (n:Nation) RETURN n.n_regionkey AS k UNION ALL MATCH (r:Region) RETURN r.r_regionkey AS k", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_cy("cy_unwind", "UNWIND [1, 3, 3, $x] AS k MATCH (n:Nation {n_regionkey: k}) RETURN k, n.n_name AS name", "SELECT k, n_name AS name FROM (VALUES (1), (3), (3), (0)) t(k) JOIN nation ON n_regionkey = k", None, {"x": 0})
_cy("cy_with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.c_custkey AS c, count(*) AS n WHERE n > 15 RETURN c, n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
_cy("cy_list_comp", "MATCH (n:Nation) WITH n.n_nationkey AS k, [x IN [1, 2, 3, 4] WHERE x > n.n_regionkey | x * 10] AS xs WHERE any(x IN xs WHERE x = 40) AND all(x IN xs WHERE x < 50) RETURN k, size(xs) AS n, xs[0] AS first, size(xs[0..2]) AS two", "SELECT n_nationkey AS k, CAST(4 - n_regionkey AS INT) AS n, CAST((n_regionkey + 1) * 10 AS INT) AS first, CAST(least(2, 4 - n_regionkey) AS INT) AS two FROM nation WHERE n_regionkey < 4")
_cy("cy_pattern_comp", "MATCH (r:Region) RETURN r.r_name AS region, [(r)<-[:PART_OF]-(n:Nation) WHERE n.n_nationkey > 20 | n.n_name] AS names", "SELECT r_name AS region, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 20 GROUP BY 1", lambda df: df.withColumn("names", F.array_join(F.array_sort("names"), ",")))
_cy("cy_map_projection", "MATCH (n:Nation) RETURN n {.n_name, twice: n.n_nationkey * 2} AS m", """SELECT '{"n_name":"' || n_name || '","twice":' || n_nationkey * 2 || '}' AS m FROM nation""", lambda df: df.select(F.to_json("m").alias("m")))
_cy("cy_call_subquery", "MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN max(c.c_acctbal) AS top } RETURN n.n_name AS nation, top", "SELECT n_name AS nation, max(c_acctbal) AS top FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
_cy("cy_order_limit", "MATCH (o:Order) RETURN DISTINCT o.o_custkey AS c ORDER BY c DESC LIMIT 12", "SELECT DISTINCT o_custkey AS c FROM orders ORDER BY c DESC LIMIT 12")
_cy("cy_any_label", "MATCH (x)-[:IN_NATION]->(n:Nation {n_nationkey: 3}) RETURN labels(x) AS l, count(*) AS n", "SELECT * FROM (SELECT 'Customer' AS l, count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_nationkey = 3) WHERE n > 0", lambda df: df.withColumn("l", F.array_join("l", ",")))
_cy("cy_return_only", "RETURN abs(-3) AS a, toInteger('12') AS b, coalesce(null, 'x') AS c, size('héllo') AS d", "SELECT 3 AS a, 12::BIGINT AS b, 'x' AS c, 5 AS d")
REGISTERED["cy_adjacency"] = (lambda spark, d: adjacency(table(spark, d, "orders"), "o_custkey", "o_orderkey").groupBy("direction").agg(F.count("*").alias("n"), F.count_distinct("vertex").alias("v")),
                              "SELECT 'OUT' AS direction, count(*) AS n, count(DISTINCT o_custkey) AS v FROM orders UNION ALL SELECT 'IN', count(*), count(DISTINCT o_orderkey) FROM orders")


def cy_detach_delete(spark: SparkSession, d: str) -> DataFrame:
    _, after = cypher.run(graph(spark, d), spark, "MATCH (n:Nation {n_regionkey: 2}) DETACH DELETE n")
    return cypher.query(after, spark, "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) RETURN n.n_nationkey AS n, count(*) AS customers")


REGISTERED["cy_detach_delete"] = (cy_detach_delete, "SELECT n_nationkey AS n, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1")


def cy_write(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    for text in ("CREATE (:Region {r_regionkey: 9, r_name: 'MOON'})", "MERGE (:Region {r_regionkey: 9, r_name: 'MOON'})", "MATCH (r:Region) WHERE r.r_regionkey > 3 SET r.size = r.r_regionkey * 2", "MATCH (r:Region {r_regionkey: 0}) REMOVE r.r_name"):
        _, g = cypher.run(g, spark, text)
    return cypher.query(g, spark, "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name, r.size AS size")


REGISTERED["cy_write"] = (cy_write, "SELECT r_regionkey AS k, CASE WHEN r_regionkey <> 0 THEN r_name END AS name, CASE WHEN r_regionkey > 3 THEN r_regionkey * 2 END AS size FROM region UNION ALL SELECT 9, 'MOON', 18")


def cy_foreach(spark: SparkSession, d: str) -> DataFrame:
    _, g = cypher.run(graph(spark, d), spark, "FOREACH (x IN [10, 11] | CREATE (:Region {r_regionkey: x, r_name: 'NEW'}))")
    return cypher.query(g, spark, "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name")


REGISTERED["cy_foreach"] = (cy_foreach, "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 10, 'NEW' UNION ALL SELECT 11, 'NEW'")


def _after(name: str, changes: list[str], text: str, oracle: str, params: dict | None = None) -> None:
    """The rows of ``text`` on the graph after ``changes``."""

    def go(spark: SparkSession, d: str) -> DataFrame:
        g = graph(spark, d, " ".join([*changes, text]))
        for c in changes:
            _, g = cypher.run(g, spark, c, params)
        return cypher.query(g, spark, text)

    REGISTERED[name] = (go, oracle)


_after("cy_create_edges", ["MATCH (n:Nation), (r:Region) WHERE n.n_regionkey = r.r_regionkey AND r.r_regionkey < 2 CREATE (r)-[:HOLDS {since: n.n_nationkey}]->(n)"], "MATCH (r:Region)-[h:HOLDS]->(n:Nation) RETURN r.r_name AS region, n.n_name AS nation, h.since AS since",
       "SELECT r_name AS region, n_name AS nation, n_nationkey AS since FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2")
_after("cy_merge_edges", 2 * ["MATCH (a:Customer {c_custkey: 1}), (b:Customer {c_custkey: 4}) MERGE (a)-[:KNOWS {weight: 77}]->(b)"], "MATCH (a:Customer {c_custkey: 1})-[k:KNOWS {weight: 77}]->(b:Customer) RETURN b.c_custkey AS b, k.weight AS w", "SELECT 4 AS b, 77 AS w")
_after("cy_create_path", ["CREATE (a:Region {r_regionkey: 20, r_name: 'NEW'})<-[:PART_OF]-(b:Nation {n_nationkey: 90, n_name: 'LAND'})"], "MATCH (n:Nation)-[:PART_OF]->(r:Region) WHERE r.r_regionkey > 3 RETURN n.n_name AS nation, r.r_name AS region",
       "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 3 UNION ALL SELECT 'LAND', 'NEW'")
_after("cy_delete_edges", ["MATCH (a:Customer)-[k:KNOWS {weight: 2}]->(b:Customer) DELETE k"], "MATCH (a:Customer)-[k:KNOWS]->(b:Customer) RETURN k.weight AS w, count(*) AS n", "SELECT c_custkey % 5 AS w, count(*) AS n FROM customer WHERE c_custkey % 5 <> 2 GROUP BY 1")
_after("cy_unwind_create", ["UNWIND $rows AS row CREATE (:Region {r_regionkey: row.k, r_name: row.name})"], "MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name",
       "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 30, 'X' UNION ALL SELECT 31, NULL", {"rows": [{"k": 30, "name": "X"}, {"k": 31}]})
_cy("cy_set_return", "MATCH (n:Nation {n_regionkey: 1}) SET n.n_name = 'HERE', n.twice = n.n_nationkey * 2 RETURN n.n_nationkey AS k, n.n_name AS name, n.twice AS twice", "SELECT n_nationkey AS k, 'HERE' AS name, n_nationkey * 2 AS twice FROM nation WHERE n_regionkey = 1")
_cy("cy_create_return", "MATCH (r:Region) CREATE (n:Town {id: r.r_regionkey + 100, of: r.r_name}) RETURN n.id AS id, n.of AS region", "SELECT r_regionkey + 100 AS id, r_name AS region FROM region")
_cy("cy_slices", "MATCH (n:Nation) WITH n.n_nationkey AS k, [n.n_nationkey, n.n_regionkey, 7, 8] AS xs RETURN k, xs[0] AS first, xs[-1] AS last, xs[9] AS none, size(xs[1..3]) AS two, xs[-3..-1][0] AS region, size(xs[2..]) AS rest", "SELECT n_nationkey AS k, n_nationkey AS first, 8 AS last, NULL AS none, 2 AS two, n_regionkey AS region, 2 AS rest FROM nation")
