"""Wide-column queries: the statement front end, versions of cells, collections, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.functions import semantics as S
from quadra.functions import temporal
from quadra.operators import dml, versions
from quadra.plans import cql
from quadra.queries.search import _HAVERSINE, _PLACES
from quadra.sources.tables import pages, table

REGISTERED: dict = {}


class _Tables(dict):
    """Tables by name, each opened when a statement first names it."""

    def __init__(self, spark: SparkSession, d: str) -> None:
        super().__init__()
        self.open = lambda name: table(spark, d, name)

    def __contains__(self, name: object) -> bool:
        return name in _KEYS

    def __missing__(self, name: str) -> cql.Table:
        source, shown, *keys = _KEYS[name]
        self[name] = cql.Table(shown(self.open(source)), *keys)
        return self[name]


# name: table, what is shown of it, partition key, clustering key, indexes
_KEYS = {
    "orders": ("orders", lambda o: o, ["o_orderkey"], [], {"by_status": (["o_orderstatus"], "btree"), "by_cust": (["o_custkey"], "hash")}),
    "events": ("events", lambda e: e, ["user_id"], ["event_id"]),
    "items": ("lineitem", lambda x: x.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey"], ["l_linenumber"], {"by_part": (["l_partkey"], "btree")}),
    "tagged": ("orders", lambda o: o.select("o_orderkey", F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("tags"), F.create_map(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("props")), ["o_orderkey"]),
    "nation": ("nation", lambda n: n, ["n_nationkey"], [], {"by_sound": (["n_name"], "phonetic")}),
    "places": ("customer", lambda c: c.select(F.col("c_custkey").alias("id"), F.struct(((F.col("c_custkey") * 37) % 180 - 90 + 0.25).alias("lat"), ((F.col("c_custkey") * 91) % 360 - 180 + 0.5).alias("lon")).alias("location")), ["id"]),
    "embeddings": ("embeddings", lambda e: e, ["vec_id"]),
    "documents": ("documents", lambda x: x, ["doc_id"]),
}


def _catalog(spark: SparkSession, d: str) -> dict[str, cql.Table]:
    return _Tables(spark, d)


def _cql(name: str, text: str, oracle: str | None, binds: tuple = ()) -> None:
    REGISTERED[name] = (lambda spark, d: cql.select(_catalog(spark, d), text, binds), oracle)


_cql("cql_pk_lookup", "SELECT * FROM items WHERE l_orderkey = 7 AND l_linenumber > 1", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber > 1")
# -1: a key that no table holds, however large
_cql("cql_in_pk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (3, 5, ?, -1)", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (3, 5, 8)", (8,))
_cql("cql_index_intersection", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 11", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 11")
_cql("cql_index_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000 ALLOW FILTERING", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000")
_cql("cql_explain", "EXPLAIN SELECT * FROM items WHERE l_orderkey = 7 AND l_partkey = 3", "SELECT 'PartitionIndexLookup' AS plan, '(''by_part'', ''l_partkey'')' AS detail")
_cql("cql_contains", "SELECT o_orderkey FROM tagged WHERE tags CONTAINS '1' AND props CONTAINS '1-URGENT' AND props CONTAINS KEY 'F' ALLOW FILTERING", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
_cql("cql_like", "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE '%N_1%' ALLOW FILTERING", "SELECT n_nationkey, n_name FROM nation WHERE contains(n_name, 'N_1')")
_cql("cql_tuple_slice", "SELECT l_orderkey, l_linenumber FROM items WHERE (l_orderkey, l_linenumber) > (40, 2) AND (l_orderkey, l_linenumber) <= (60, 3) ALLOW FILTERING", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey > 40 OR l_orderkey = 40 AND l_linenumber > 2) AND (l_orderkey < 60 OR l_orderkey = 60 AND l_linenumber <= 3)")
_cql("cql_distinct_pk", "SELECT DISTINCT user_id FROM events", "SELECT DISTINCT user_id FROM events")
_cql("cql_order_limit", "SELECT event_id, value FROM events WHERE user_id = 5 ORDER BY event_id DESC LIMIT 7", "SELECT event_id, value FROM events WHERE user_id = 5 ORDER BY event_id DESC LIMIT 7")
_cql("cql_aggregates", "SELECT COUNT(*) AS n, MIN(value) AS low, MAX(value) AS high, COUNT(DISTINCT event_type) AS kinds FROM events WHERE user_id = 5", "SELECT count(*) AS n, min(value) AS low, max(value) AS high, count(DISTINCT event_type) AS kinds FROM events WHERE user_id = 5")
# the tables' names are all NATION and a number, which sound alike
_cql("cql_sounds_like", "SELECT n_nationkey FROM nation WHERE n_name SOUNDS LIKE 'nashun'", "SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION%'")
_cql("cql_geo_radius", "SELECT id FROM places WHERE GEO_WITHIN_RADIUS(location, (10.0, 20.0), 2000000)", f"SELECT id FROM ({_PLACES}) WHERE {_HAVERSINE.format(y='10', x='20')} <= 2000000")
_cql("cql_geo_nearest", "SELECT id FROM places ORDER BY location GEO_NEAREST OF (5.0, 5.0) LIMIT 4", f"SELECT id FROM ({_PLACES}) ORDER BY {_HAVERSINE.format(y='5', x='5')}, id LIMIT 4")
_cql("cql_fts_match", "SELECT doc_id FROM documents WHERE FTS_MATCH(text, 'erst AND sting')", """SELECT doc_id FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'erst') AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'sting')""")
_cql("cql_to_json", "SELECT o_orderkey, toJson(tags) AS j FROM tagged WHERE o_orderkey = 3", """SELECT o_orderkey, '["' || o_orderstatus || '","' || o_orderpriority[1] || '"]' AS j FROM orders WHERE o_orderkey = 3""")


def cql_token_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows by token range: the ring in four ranges holds every row once."""
    from quadra.functions.murmur import bigint_token
    from quadra.sources.tables import token_ranges

    o = table(spark, d, "orders").select("o_orderkey", bigint_token(F.col("o_orderkey").cast("long")).alias("t"))
    case = F.lit(None).cast("int")
    for i, (low, high) in enumerate(token_ranges(4)):
        case = F.when((F.col("t") > low) & (F.col("t") <= high), i).otherwise(case)
    return o.groupBy(case.alias("r")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count(F.when(F.col("r").isNotNull(), 1)).alias("ranges"))


REGISTERED["cql_token_range"] = (cql_token_range, "SELECT CAST(count(*) AS BIGINT) AS n, 4::BIGINT AS ranges FROM orders")


def cql_estimate_distinct(spark: SparkSession, d: str) -> DataFrame:
    out = cql.select(_catalog(spark, d), "SELECT COUNT(ESTIMATE_DISTINCT event_id) AS e, COUNT(DISTINCT event_id) AS n FROM events")
    return out.select((F.abs(F.col("e") - F.col("n")) / F.col("n") < 0.1).alias("close"))


REGISTERED["agg_estimate_distinct"] = (cql_estimate_distinct, "SELECT true AS close")


def hll_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sketches per type merged: the same estimate as one sketch of all."""
    e = table(spark, d, "events")
    parts = e.groupBy("event_type").agg(F.hll_sketch_agg("user_id").alias("s"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("merged")).crossJoin(e.agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("whole"))).select((F.col("merged") == F.col("whole")).alias("equal"))


REGISTERED["hll_merge"] = (hll_merge, "SELECT true AS equal")

_CELLS = """SELECT user_id, event_type AS col, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS value,
  event_id // 3 AS write_ts, event_id % 7 = 0 AS tombstone, CASE WHEN event_id % 2 = 0 THEN 500 END AS ttl_s FROM events"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select("user_id", F.col("event_type").alias("col"), F.when(i % 11 != 0, i.cast("string")).alias("value"), F.expr("event_id div 3").alias("write_ts"), (i % 7 == 0).alias("tombstone"), F.when(i % 2 == 0, F.lit(500)).alias("ttl_s"))


_LATEST = f"""SELECT user_id, col, value, write_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, col ORDER BY write_ts DESC, (NOT tombstone AND value IS NOT NULL) DESC, value DESC) AS r FROM ({_CELLS}))
  WHERE r = 1 AND NOT tombstone AND value IS NOT NULL"""
REGISTERED["cql_lww"] = (lambda spark, d: versions.latest(_cells(spark, d), ["user_id", "col"]), _LATEST)
REGISTERED["cql_lww_rows"] = (lambda spark, d: versions.latest_rows(_cells(spark, d), ["user_id"], ["click", "view"]),
                              f"SELECT user_id, max(value) FILTER (WHERE col = 'click') AS click, max(value) FILTER (WHERE col = 'view') AS view FROM ({_LATEST}) GROUP BY user_id")
REGISTERED["cql_ttl_live"] = (lambda spark, d: versions.latest(_cells(spark, d), ["user_id", "col"], ttl="ttl_s", now=F.lit(3300)),
                              f"""SELECT user_id, col, value, write_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, col ORDER BY write_ts DESC, (NOT tombstone AND value IS NOT NULL) DESC, value DESC) AS r FROM ({_CELLS}))
  WHERE r = 1 AND NOT tombstone AND value IS NOT NULL AND (ttl_s IS NULL OR write_ts + ttl_s > 3300)""")
REGISTERED["cql_counter"] = (lambda spark, d: versions.counters(table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("delta")), ["user_id"]),
                             "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) AS BIGINT) AS value FROM events GROUP BY user_id")


def cql_collections(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.array("o_orderstatus", F.lit("x")).alias("tags"), F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.lit("y")).alias("m"))
    added = S.set_remove(S.set_add(F.col("tags"), F.array(F.lit("new"), F.lit("x"))), F.array(F.lit("F")))
    m = S.map_remove(S.map_add(F.col("m"), F.create_map(F.lit("b"), F.lit("z"))), F.array(F.lit("a")))
    return o.select("o_orderkey", F.array_join(added, ",").alias("tags"), F.array_join(F.transform(S.map_key(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("m"))


REGISTERED["cql_collection_add_remove"] = (cql_collections, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new,x' ELSE o_orderstatus || ',new,x' END AS tags, 'b=z' AS m FROM orders")
REGISTERED["cql_duration_add"] = (lambda spark, d: table(spark, d, "orders").select("o_orderkey", temporal.parse_duration("1mo2d3h").added_to(F.col("o_orderdate")).cast("timestamp_ntz").alias("due"), temporal.parse_duration("P1Y").added_to(F.col("o_orderdate"), -1).cast("timestamp_ntz").alias("ago")),
                                  "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR AS due, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 1 YEAR AS ago FROM orders")


def cql_lwt(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_acctbal")
    changes = table(spark, d, "customer").where("c_custkey < 200").select("c_custkey", F.lit(0.0).alias("new"))
    done = dml.conditional_update(state, changes, ["c_custkey"], F.col("c_acctbal") > 1000)
    return done.select("c_custkey", F.col("[applied]").alias("applied"))


REGISTERED["cql_lwt_applied"] = (cql_lwt, "SELECT c_custkey, c_custkey % 2 = 0 AND c_acctbal > 1000 AS applied FROM customer WHERE c_custkey < 200")
REGISTERED["cql_lwt_not_exists"] = (lambda spark, d: dml.conditional_insert(table(spark, d, "nation"), spark.createDataFrame([(3,), (77,)], "n_nationkey int"), ["n_nationkey"]).select("n_nationkey", F.col("[applied]").alias("applied")),
                                    "SELECT * FROM (VALUES (3, false), (77, true)) t(n_nationkey, applied)")
REGISTERED["cql_paging"] = (lambda spark, d: pages(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 30, (17, 2)),
                            "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 17 OR l_orderkey = 17 AND l_linenumber > 2 ORDER BY 1, 2 LIMIT 30")
REGISTERED["window_cursor"] = (lambda spark, d: versions.window_rows(_cells(spark, d), ["user_id"], "write_ts", 100, 200).select("user_id", "write_ts", "value"),
                               f"""SELECT user_id, write_ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, write_ts ORDER BY (NOT tombstone AND value IS NOT NULL) DESC, value DESC) AS r FROM ({_CELLS}) WHERE write_ts >= 100 AND write_ts < 200)
  WHERE r = 1 AND NOT tombstone AND value IS NOT NULL""")


def exchange_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table read by token range, put together again."""
    from quadra.sources.exchange import endpoints

    parts = endpoints(_catalog(spark, d)["orders"], 3)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("o_orderkey", "o_custkey")


def exchange_pages(spark: SparkSession, d: str) -> DataFrame:
    """A table by ticket in pages of 1,024 rows at most, put back by an upsert over a table that has every third row.

    Pages are made and read in tasks, so no client holds the table.
    """
    from quadra.sources.exchange import paged, put, unpaged

    pages_ = paged(_catalog(spark, d), "SELECT o_orderkey, o_custkey FROM orders")
    old = table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(0).cast("long").alias("o_custkey"))
    return put(cql.Table(old, ["o_orderkey"]), unpaged(pages_, old.schema)).df


REGISTERED["exchange_pages"] = (exchange_pages, "SELECT o_orderkey, o_custkey FROM orders")


def cql_now(spark: SparkSession, d: str) -> DataFrame:
    """Time-based identifiers of now: of version 1, apart from each other, and as late as the statement."""
    rows = cql.select(_catalog(spark, d), "SELECT o_orderkey, now() AS id, toTimestamp(now()) AS at FROM orders")
    near = lambda c: F.abs(F.unix_micros(c) - F.unix_micros(F.current_timestamp())) < 600 * 10**6
    return rows.agg(F.count_distinct("id").alias("n"), F.bool_and((F.substring("id", 15, 1) == "1") & near(temporal.to_timestamp(F.col("id")))).alias("good"), F.bool_and(near(F.col("at"))).alias("late"))


REGISTERED["cql_now"] = (cql_now, "SELECT count(*) AS n, true AS good, true AS late FROM orders")
_cql("cql_ttl_writetime", "SELECT o_orderkey, TTL(o_custkey) AS ttl, WRITETIME(o_custkey) AS written FROM orders", "SELECT o_orderkey, NULL::BIGINT AS ttl, NULL::BIGINT AS written FROM orders")


def cql_partial_index(spark: SparkSession, d: str) -> DataFrame:
    """Plans and rows with an index of the orders above a price: it serves those searches that stay above it."""
    from quadra.plans.ddl import Registry

    reg = Registry(spark, {"orders": cql.Table(table(spark, d, "orders"), ["o_orderkey"])})
    reg.run("CREATE INDEX dear ON orders (o_custkey) USING 'filtered' WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
    out = None
    for name, where in (("inside", "o_custkey = 7 AND o_totalprice >= 250000 AND o_orderstatus = 'O'"), ("outside", "o_custkey = 7 AND o_totalprice > 100000 AND o_orderstatus = 'O'")):
        tail = f"FROM orders WHERE {where} ALLOW FILTERING"
        plan = reg_select(reg, f"EXPLAIN SELECT o_orderkey {tail}").select("plan")
        x = reg_select(reg, f"SELECT o_orderkey {tail}").agg(F.count("*").alias("n")).crossJoin(plan).select(F.lit(name).alias("search"), "plan", "n")
        out = x if out is None else out.unionByName(x)
    return out


def reg_select(reg, text: str) -> DataFrame:
    return cql.select(reg.tables, text)


REGISTERED["cql_partial_index"] = (cql_partial_index, """SELECT 'inside' AS search, 'IndexScanWithFilter' AS plan, count(*) AS n FROM orders WHERE o_custkey = 7 AND o_totalprice >= 250000 AND o_orderstatus = 'O'
  UNION ALL SELECT 'outside', 'FullScan', count(*) FROM orders WHERE o_custkey = 7 AND o_totalprice > 100000 AND o_orderstatus = 'O'""")
REGISTERED["exchange_endpoints"] = (exchange_endpoints, "SELECT o_orderkey, o_custkey FROM orders")


def _writes(name: str, statements: list[str], text: str, oracle: str) -> None:
    """The rows of ``text`` after ``statements``, or without it what the last of them answers."""

    def go(spark: SparkSession, d: str) -> DataFrame:
        from quadra.plans import writes

        catalog, answer = _catalog(spark, d), None
        for s in statements:
            catalog, answer = writes.execute(catalog, s)
        return cql.select(catalog, text) if text else answer.select(F.col("[applied]").alias("applied"))

    REGISTERED[name] = (go, oracle)


_writes("cql_write", ["INSERT INTO items (l_orderkey, l_linenumber, l_partkey) VALUES (900000, 1, 5)", "UPDATE items SET l_quantity = 7 WHERE l_orderkey = 3 AND l_linenumber IN (1, 2)", "DELETE FROM items WHERE l_orderkey = 5 AND l_linenumber > 1", "DELETE l_quantity FROM items WHERE l_orderkey = 6 AND l_linenumber = 1"],
        "SELECT * FROM items", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey = 3 AND l_linenumber IN (1, 2) THEN 7 WHEN l_orderkey = 6 AND l_linenumber = 1 THEN NULL ELSE l_quantity END AS l_quantity
  FROM lineitem WHERE NOT (l_orderkey = 5 AND l_linenumber > 1) UNION ALL SELECT 900000, 1, 5, NULL
  UNION ALL SELECT 3, n, NULL, 7 FROM (VALUES (1), (2)) v(n) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = 3 AND l_linenumber = n)""")
_writes("cql_batch_collections", ["BEGIN BATCH UPDATE tagged SET tags = tags + {'new'}, props['k'] = 'v' WHERE o_orderkey = 1; UPDATE tagged SET tags = tags - {'new'} WHERE o_orderkey = 1; UPDATE tagged SET props = props + {'a': 'b'} WHERE o_orderkey IN (1, 2) APPLY BATCH"],
        "SELECT o_orderkey, props['a'] AS a, props['k'] AS k FROM tagged", "SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 2) THEN 'b' END AS a, CASE WHEN o_orderkey = 1 THEN 'v' END AS k FROM orders")
_writes("cql_if_exists", ["UPDATE nation SET n_name = 'X' WHERE n_nationkey = 3 IF n_regionkey IN (0, 1, 2, 3, 4) AND n_name != 'X'", "INSERT INTO nation (n_nationkey, n_name) VALUES (3, 'Y') IF NOT EXISTS"], "", "SELECT false AS applied")
_cql("cql_fts_equals", "SELECT doc_id FROM documents WHERE text = fts_match('erst AND sting')", REGISTERED["cql_fts_match"][1])
_cql("cql_token_of", "SELECT COUNT(*) AS n FROM orders WHERE token(o_orderkey) >= token(3) AND token(o_orderkey) <= token(3)", "SELECT 1::BIGINT AS n")
_cql("cql_time_shift", "SELECT event_id FROM events WHERE ts >= '2024-01-31' - 1mo2d AND ts < '2024-01-02' + 36h ALLOW FILTERING", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 1 MONTH - INTERVAL 2 DAY AND ts < TIMESTAMP '2024-01-03 12:00:00'")


def cql_user_functions(spark: SparkSession, d: str) -> DataFrame:
    """A scalar function within a fold, both by statement."""
    from quadra.plans.ddl import Registry

    r = Registry(spark)
    for text in ("CREATE OR REPLACE FUNCTION add_square (state double, val double) CALLED ON NULL INPUT RETURNS double LANGUAGE sql AS 'state + val * val'",
                 "CREATE OR REPLACE FUNCTION root (state double) RETURNS NULL ON NULL INPUT RETURNS double LANGUAGE sql AS $$SELECT sqrt(state)$$",
                 "CREATE AGGREGATE norm (double) SFUNC add_square STYPE double FINALFUNC root INITCOND 0.0"):
        r.run(text)
    return cql.select(_catalog(spark, d), "SELECT norm(value) AS norm FROM events WHERE user_id = 5", functions=r.functions()).select(F.round("norm", 4).alias("norm"))


REGISTERED["cql_user_functions"] = (cql_user_functions, "SELECT round(sqrt(sum(value * value)), 4) AS norm FROM events WHERE user_id = 5")
