"""Wide-column changes, subscriptions, user functions and graph changes by statement."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from quadra.operators.graph import COMPACT, Edges, Graph, reach
from quadra.plans import cql, cypher, sql, writes
from quadra.plans.ddl import Registry
from quadra.plans.lex import SyntaxFault, tokens
from quadra.functions import geo
from quadra.operators import constraints
from quadra.sources.tables import page_after, page_token
from quadra.streaming.subscribe import Subscriptions, parse


def run(catalog: dict, *statements: str) -> tuple[dict, object]:
    answer = None
    for s in statements:
        catalog, answer = writes.execute(catalog, s)
    return catalog, answer


@pytest.fixture
def catalog(spark: SparkSession) -> dict:
    rows = [(1, 1, ["b"], {"k": 1}, [1, 2, 1], 5), (1, 2, None, None, None, None), (2, 1, ["a", "b"], {}, [], 0)]
    return {"t": cql.Table(spark.createDataFrame(rows, "p int, c int, tags array<string>, m map<string,int>, xs array<int>, n long"), ["p"], ["c"])}


def test_cells(catalog: dict) -> None:
    after, _ = run(catalog, "UPDATE k.t SET tags = tags + {'a', 'b'}, m['z'] = 9, xs = xs + [7], n = n + 3 WHERE p = 1 AND c IN (1, 2)", "UPDATE t SET tags = tags - {'b'}, xs = xs - [1], m = m - {'k'}, n = n - 1 WHERE p = 1 AND c = 1",
                   "DELETE FROM t WHERE p = 2", "INSERT INTO t (p, c, n) VALUES (3, 3, null)", "DELETE m['z'] FROM t WHERE p = 1 AND c = 2", "UPDATE t SET xs[1] = 4 WHERE p = 1 AND c = 1")
    got = {(r.p, r.c): (r.tags, r.m, r.xs, r.n) for r in after["t"].df.collect()}
    assert got == {(1, 1): (["a"], {"z": 9}, [2, 4], 7), (1, 2): (["a", "b"], {}, [7], 3 + 0), (3, 3): (None, None, None, None)}


def test_conditions(catalog: dict) -> None:
    for text, applied in (("INSERT INTO t (p, c) VALUES (1, 1) IF NOT EXISTS", False), ("INSERT INTO t (p, c) VALUES (9, 1) IF NOT EXISTS", True), ("UPDATE t SET n = 1 WHERE p = 1 AND c = 1 IF n > 4", True), ("UPDATE t SET n = 1 WHERE p = 1 AND c = 2 IF n > 4", False), ("UPDATE t SET n = 1 WHERE p = 1 AND c = 2 IF n = null", True), ("DELETE FROM t WHERE p = 8 AND c = 8 IF EXISTS", False)):
        after, answer = writes.execute(catalog, text)
        row = answer.first().asDict()
        assert row["[applied]"] is applied
        assert (after["t"] is catalog["t"]) is not applied
    _, answer = writes.execute(catalog, "UPDATE t SET n = 1 WHERE p = 1 AND c = 1 IF n = 6")
    assert answer.first()["n"] == 5  # the current values come along


@pytest.mark.parametrize("bad", ["UPDATE t SET n = 1 WHERE p = 1", "DELETE FROM t WHERE c = 1", "UPDATE t SET n = 1 WHERE p = 1 AND c = 1 AND n = 5", "DELETE p FROM t WHERE p = 1", "INSERT INTO t (p) VALUES (1)", "INSERT INTO t (p, c) VALUES (1, 1) USING TTL 5",
                                 "BEGIN BATCH INSERT INTO t (p, c) VALUES (1, 1) IF NOT EXISTS APPLY BATCH", "UPDATE t SET n = 1 WHERE p = 1 AND c IN (1, 2) IF EXISTS"])
def test_refused(catalog: dict, bad: str) -> None:
    with pytest.raises(SyntaxFault):
        writes.execute(catalog, bad)


def test_literals() -> None:
    assert [t.kind for t in tokens("36h 12 1e5 0x0aff 1mo2d 7")] == ["dur", "num", "num", "dur", "dur", "num", "end"]
    c = cql.parse("INSERT INTO t (a, b, c) VALUES (0x0aff, '2024-01-31' - 12h30m, totimestamp(now()))")
    assert c.cells["a"] == b"\x0a\xff" and c.cells["b"].sign == -1 and c.cells["b"].by.nanos == 45_000 * 10**9 and c.cells["c"].year > 2020


def test_subscriptions(spark: SparkSession) -> None:
    state = {"df": spark.range(3)}
    s = Subscriptions(lambda text: state["df"])
    assert s.execute("SUBSCRIBE SELECT * FROM t EVERY 5s DELTA") == 1 and s.open[1].interval == 5
    assert s.open[1].poll().count() == 3 and s.open[1].poll().count() == 0
    state["df"] = spark.range(4)
    assert [r[0] for r in s.open[1].poll().collect()] == [3]
    assert s.execute("SUBSCRIBE MATCH (n) RETURN n") == 2 and s.open[2].poll().count() == 4
    s.execute("UNSUBSCRIBE 1")
    assert list(s.open) == [2] and s.execute("UNSUBSCRIBE") is None and not s.open
    with pytest.raises(LookupError):
        s.execute("UNSUBSCRIBE 7")
    events = spark.createDataFrame([(1, "local"), (1, "local"), (1, "committed"), (2, "committed")], "mutation_id long, stream string")
    c = parse("SUBSCRIBE SELECT * FROM t ON LOCAL, COMMITTED", s.run)
    assert c.changes(events).count() == 3
    for bad in ("SUBSCRIBE INSERT INTO t", "SUBSCRIBE SELECT 1 ON LOCAL EVERY 5s", "SUBSCRIBE"):
        with pytest.raises(SyntaxFault):
            parse(bad, s.run)


def test_functions(spark: SparkSession) -> None:
    r = Registry(spark)
    r.run("CREATE FUNCTION IF NOT EXISTS k.half (x double) RETURNS NULL ON NULL INPUT RETURNS double LANGUAGE sql AS 'x / 2'")
    assert [x[0] for x in sql.select(spark, "SELECT half(8) AS h").collect()] == [4.0]
    t = {"t": cql.Table(spark.createDataFrame([(1, 3.0), (2, None)], "id int, x double"), ["id"])}
    assert sorted(map(str, (x[0] for x in cql.select(t, "SELECT k.half(x) AS h FROM t", functions=r.functions()).collect()))) == ["1.5", "None"]
    r.run("CREATE FUNCTION sign_of(x int) RETURNS text LANGUAGE plpgsql AS $$ BEGIN IF x < 0 THEN RETURN 'minus'; END IF; RETURN 'plus'; END $$")
    assert r.call("sign_of", -4) == "minus"
    with pytest.raises(SyntaxFault):
        r.run("CREATE FUNCTION half (x int) RETURNS int LANGUAGE sql AS 'x'")
    for bad in ("CREATE FUNCTION w (x int) RETURNS int LANGUAGE wasm AS '0x00'", "CREATE AGGREGATE a (int) SFUNC half STYPE int", "CREATE FUNCTION w (x int) RETURNS int LANGUAGE sql"):
        with pytest.raises(SyntaxFault):
            r.run(bad)
    r.run("DROP FUNCTION half (double)")
    with pytest.raises(sql.SqlError):
        sql.select(spark, "SELECT half(8) AS h")


def test_graph_changes(spark: SparkSession) -> None:
    p = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    e = spark.createDataFrame([(1, 2, 7), (2, 3, 8)], "src int, dst int, w int")
    g = Graph({"P": (p, "id"), "Q": (p.limit(1), "id")}, {"R": [Edges(e, "src", "dst", "P", "P")]})

    def after(*texts: str) -> Graph:
        out = g
        for t in texts:
            _, out = cypher.run(out, spark, t)
        return out

    edges = lambda x: sorted(tuple(r) for r in cypher.query(x, spark, "MATCH (a:P)-[r:R]->(b:P) RETURN a.id, r.w, b.id").collect())
    assert edges(after("MATCH (a:P {id: 3}), (b:P {id: 1}) CREATE (a)-[:R {w: 9}]->(b)")) == [(1, 7, 2), (2, 8, 3), (3, 9, 1)]
    assert edges(after(*2 * ["MATCH (a:P {id: 1}), (b:P {id: 2}) MERGE (a)-[:R {w: 7}]->(b)"])) == [(1, 7, 2), (2, 8, 3)]
    assert edges(after("MATCH (a:P)-[r:R]->(b:P) WHERE r.w < 8 DELETE r")) == [(2, 8, 3)]
    # a variable without a label is set in every table that it matches
    both = after("MATCH (n) WHERE n.id = 1 SET n.name = 'z'")
    assert [both.vertices[x][0].where("name = 'z'").count() for x in ("P", "Q")] == [1, 1]
    out, changed = cypher.run(g, spark, "MATCH (n:P) WHERE n.id > 1 SET n.id2 = n.id + 1, n.name = 'y' RETURN n.id2 AS x, n.name AS name")
    assert sorted(tuple(r) for r in out.collect()) == [(3, "y"), (4, "y")]
    assert changed.vertices["P"][0].where("id2 is null").count() == 1
    assert cypher.run(g, spark, "MATCH (n:P {name: 'none'}) SET n.name = 'q' RETURN n")[0].isEmpty()
    assert not after("MATCH (a:P {id: 1}), (b:P {id: 2}) DETACH DELETE a, b").vertices["P"][0].where("id < 3").count()
    for bad in ("CREATE (:P {id: 9})-[:R]-(:P {id: 8})", "MATCH (a:P)-[r:R]->(b:P) SET r.w = 1", "CREATE (n {id: 1})"):
        with pytest.raises(SyntaxFault):
            cypher.run(g, spark, bad)


def test_system_tables(spark: SparkSession) -> None:
    r = Registry(spark)
    for text in ("CREATE TABLE t (a int, b text, c int, PRIMARY KEY (a, b))", "CREATE INDEX by_c ON t (c)", "CREATE TYPE mood AS ENUM ('sad', 'ok')"):
        r.run(text)
    got = cql.select(r.system(), "SELECT column_name, kind FROM system_schema.columns WHERE table_name = 't'").collect()
    assert sorted(map(tuple, got)) == [("a", "partition_key"), ("b", "clustering"), ("c", "regular")]
    assert cql.select(r.system(), "SELECT index_name FROM system_schema.indexes WHERE table_name = 't'").first()[0] == "by_c"
    assert cql.select(r.system(), "SELECT definition FROM system_schema.types WHERE type_name = 'mood'").first()[0] == "enum(sad,ok)"


def test_page_tokens() -> None:
    t = page_token((17, "x"), b"k")
    assert page_after(t, b"k") == (17, "x")
    with pytest.raises(ValueError, match="changed"):
        page_after(t, b"other")


def test_constraints(spark: SparkSession) -> None:
    df = spark.createDataFrame([(1, None), (1, 2), (None, 3), (None, 3)], "a int, b int")
    assert [tuple(r) for r in constraints.unique(df, ["a"]).collect()] == [(1, 2)]
    assert {tuple(r) for r in constraints.primary_key(df, ["a"]).collect()} == {(1, 2), (None, 2)}
    assert constraints.foreign_key(df, ["b"], df, ["a"]).count() == 3
    assert constraints.check(df, df["b"] > 2).count() == 1
    with pytest.raises(constraints.ConstraintError):
        constraints.require(constraints.not_null(df, ["b"]), "b_is_set")


def test_cover(spark: SparkSession) -> None:
    grid = spark.range(37 * 73).selectExpr("cast(id div 73 as double) * 5 - 90 as lat", "cast(id % 73 as double) * 5 - 180 as lon")
    for box in ((-20, 170, 30, -160), (0, 0, 0, 0), (-90, -180, 90, 180), (10.5, -30.25, 41, 12)):
        ranges = geo.cover(*box, 5)
        hit = geo.in_ranges(geo.cell(grid["lat"], grid["lon"], 5), ranges)
        inside = geo.within_bbox(grid["lat"], grid["lon"], *box)
        assert grid.where(inside & ~hit).isEmpty() and ranges == sorted(ranges)
    assert geo.cover(-90, -180, 90, 180, 5) == [(0, 4**5 - 1)]


def test_long_path(spark: SparkSession) -> None:
    """More levels than are kept apart, over a cycle."""
    n = COMPACT + 4
    edges = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst").coalesce(1)
    found = reach(spark.range(1).selectExpr("id as start"), edges, 1)
    assert sorted((r.end, r.depth) for r in found.collect()) == [(i, i) for i in range(1, n)]
