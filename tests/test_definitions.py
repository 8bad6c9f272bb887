"""Definitions, procedural blocks and exchange."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from quadra.operators import udf
from quadra.plans import cql
from quadra.plans.ddl import Registry
from quadra.plans.lex import SyntaxFault
from quadra.plans.procedures import Procedure
from quadra.sources import exchange


def test_definitions(spark: SparkSession) -> None:
    r = Registry(spark)
    for text in (
        "CREATE KEYSPACE IF NOT EXISTS k WITH replication = {'class': 'x'}", "CREATE TYPE mood AS ENUM ('sad', 'ok', 'glad')", "CREATE TYPE address (street text, zip int)",
        "CREATE TABLE k.t (id uuid, at timestamp, tags set<text>, m map<text, int>, home frozen<address>, v vector<float, 3>, feel mood, PRIMARY KEY ((id), at)) WITH CLUSTERING ORDER BY (at DESC) AND extensions = {'graph.type': 'vertex'}",
        "CREATE INDEX by_feel ON t (feel)", "CREATE CUSTOM INDEX ON t (tags) USING 'hash'", "ALTER TABLE t ADD n int", "ALTER TABLE t RENAME n TO many", "ALTER TABLE t ALTER many TYPE bigint", "COMMENT ON TABLE t IS 'people'", "VACUUM t", "TRUNCATE t"):
        r.run(text)
    t = r.tables["t"]
    assert (t.partition, t.clustering, t.extensions) == (["id"], ["at"], {"graph.type": "vertex"}) and t.indexes == {"by_feel": (["feel"], "btree"), "t_tags_idx": (["tags"], "hash")}
    assert dict(t.df.dtypes) | {} == {"id": "string", "at": "timestamp_ntz", "tags": "array<string>", "m": "map<string,int>", "home": "struct<street:string,zip:int>", "v": "array<float>", "feel": "string", "many": "bigint"}
    assert r.comments == {"t": "people"}
    moods = spark.createDataFrame([("glad",), ("sad",), ("ok",)], "feel string")
    assert [x[0] for x in moods.orderBy(r.ordinal("mood", "feel")).collect()] == ["sad", "ok", "glad"]
    for bad in ("CREATE TABLE t (a int)", "CREATE TABLE z (a money)", "ALTER TABLE t DROP id", "CREATE INDEX ON t (nothing)", "CREATE TABLE z (a int, PRIMARY KEY (b))", "CREATE VIEW v AS SELECT 1"):
        with pytest.raises(SyntaxFault):
            r.run(bad)
    with pytest.raises(LookupError):
        r.run("DROP TABLE nothing")
    r.run("DROP TABLE IF EXISTS nothing")
    r.run("DROP INDEX by_feel")
    r.run("DROP TABLE t")
    assert not r.tables


def test_procedures(spark: SparkSession) -> None:
    sign = Procedure(spark, "DO $$ BEGIN IF x > 0 THEN RETURN 'plus'; ELSIF x < 0 THEN RETURN 'minus'; ELSE NULL; END IF; RETURN 'zero'; END $$", ["x"])
    assert [sign.call(v) for v in (3, -3, 0)] == ["plus", "minus", "zero"]
    assert Procedure(spark, "DECLARE a int := 2; b int; BEGIN b := a * 3 + 1; a := b; RETURN a; END").call() == 7
    for bad in ("BEGIN x := 1; END", "BEGIN LOOP END", "BEGIN SELECT 1; END"):
        with pytest.raises(SyntaxFault):
            Procedure(spark, bad).call()


def test_exchange(spark: SparkSession) -> None:
    t = cql.Table(spark.range(2500).selectExpr("id", "id * 2 AS twice"), ["id"])
    assert [p.num_rows for p in exchange.get({"t": t}, "SELECT * FROM t")] == [1024, 1024, 452]
    new = exchange.put(t, spark.createDataFrame([(3, 0), (9999, 1)], "id long, twice long"))
    assert new.df.count() == 2501 and new.df.where("id = 3").first()["twice"] == 0
    assert exchange.listing({"t": t}) == {"t": "struct<id:bigint,twice:bigint>"}


def test_user_functions(spark: SparkSession) -> None:
    udf.register_python(spark, "add_up", lambda a, b: a + b, "long")
    udf.register_python(spark, "or_zero", lambda a: 0 if a is None else a, "long", null_on_null=False)
    got = spark.sql("SELECT add_up(x, 1) AS a, or_zero(x) AS b FROM VALUES (1), (NULL) t(x)").collect()
    assert sorted((tuple(r) for r in got), key=str) == [(2, 1), (None, 0)]
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, x double").repartition(3)
    out = udf.fold_aggregate(df, ["k"], "x", lambda: [], lambda s, x: [*s, x], lambda a, b: a + b, lambda s: max(s, default=None), "double", "top")
    assert {tuple(r) for r in out.collect()} == {("a", 3.0), ("b", None)}
