"""Streaming queries, run to the end of what their source holds; views and change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.operators import timeseries as ts
from quadra.operators import views
from quadra.sources.tables import table
from quadra.streaming import live

REGISTERED: dict = {}


def stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    config = ts.Rollup(3600, ["min", "max", "count"], "t", ["value"], 7200)
    return live.drain(live.live_rollup(live.table_stream(spark, d, "events"), ["event_type"], "ts", config), "update", ["event_type", "ts"])


REGISTERED["stream_rollup"] = (stream_rollup, "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts, min(value) AS value_min, max(value) AS value_max, CAST(count(value) AS DOUBLE) AS value_count FROM events GROUP BY 1, 2")


def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Late rows within each series' horizon: equal to the batch as long as none is older than it."""
    rolled = live.series_rollup(live.table_stream(spark, d, "events"), "user_id", "ts", "value", 3600, 40 * 86_400)
    out = live.drain(rolled, "update", ["user_id", "start_us"])
    return out.select("user_id", F.timestamp_micros("start_us").cast("timestamp_ntz").alias("ts"), "n", F.round("total", 4).alias("total"), "low", "high")


REGISTERED["stream_late"] = (stream_late, "SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")


def stream_dedup_cdc(spark: SparkSession, d: str) -> DataFrame:
    """Every event twice: each mutation comes out once."""
    s = live.table_stream(spark, d, "events").withColumn("mutation_id", F.explode(F.array("event_id", "event_id")))
    return live.drain(live.change_stream(s, "ts", "60 days")).groupBy("event_type").agg(F.count("*").alias("n"))


REGISTERED["stream_dedup_cdc"] = (stream_dedup_cdc, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
REGISTERED["cdc_committed"] = (lambda spark, d: views.committed(table(spark, d, "events").select(F.col("event_id").alias("mutation_id"), F.explode(F.array(F.lit("committed"), F.lit("committed"), F.lit("local"))).alias("stream"))).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM events")


def subscribe_delta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    poll = lambda upto: e.where(F.col("event_id") < upto).groupBy("event_type").agg(F.max("value").alias("top"))
    return views.subscription_delta(poll(500), poll(1000))


REGISTERED["subscribe_delta"] = (subscribe_delta, "SELECT event_type, max(value) AS top FROM events WHERE event_id < 1000 GROUP BY 1 EXCEPT SELECT event_type, max(value) FROM events WHERE event_id < 500 GROUP BY 1")


def _base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    old = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(k % 3 != 0, F.col("o_custkey")).alias("o_custkey"), "o_totalprice")
    new = o.where("o_orderkey % 7 <> 0").select("o_orderkey", F.when(k % 4 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(k % 2 == 0, F.col("o_totalprice")).otherwise(F.lit(0.0)).alias("o_totalprice"))
    return old, new


_VIEW = views.View(["o_orderkey"], ["o_custkey", "o_orderkey"], ["o_totalprice"], not_null=["o_custkey", "o_orderkey"])


def view_delta(spark: SparkSession, d: str) -> DataFrame:
    """The view kept by changes equals the view made anew."""
    old, new = _base(spark, d)
    shown = old.where("o_custkey is not null").select("o_custkey", "o_orderkey", "o_totalprice")
    return views.apply_delta(shown, views.view_delta(old, new, _VIEW), _VIEW)


_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0.0 END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0"
_OLD = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0"
REGISTERED["view_delta"] = (view_delta, f"SELECT o_custkey, o_orderkey, o_totalprice FROM ({_NEW}) WHERE o_custkey IS NOT NULL")
REGISTERED["view_ops"] = (lambda spark, d: views.view_delta(*_base(spark, d), _VIEW).groupBy("op").agg(F.count("*").alias("n")),
                          f"""SELECT op, count(*) AS n FROM (
  SELECT CASE WHEN o.o_custkey IS NOT NULL AND (n.o_custkey IS NULL) THEN 'delete' WHEN n.o_custkey IS NOT NULL AND (o.o_custkey IS NULL OR o.o_totalprice <> n.o_totalprice) THEN 'upsert' END AS op
  FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.o_orderkey = n.o_orderkey) WHERE op IS NOT NULL GROUP BY op""")


def subscribe_statement(spark: SparkSession, d: str) -> DataFrame:
    """Two polls of a subscribed query while its table grows: the second gives what is new or changed."""
    from quadra.plans import cql
    from quadra.streaming.subscribe import parse

    e = table(spark, d, "events")
    catalog = {"events": cql.Table(e.where("event_id < 500"), ["user_id"], ["event_id"])}
    s = parse("SUBSCRIBE SELECT event_id, value FROM events WHERE user_id = 5 EVERY 5s DELTA", lambda text: cql.select(catalog, text))
    s.poll()
    catalog["events"] = cql.Table(e, ["user_id"], ["event_id"])
    return s.poll()


REGISTERED["subscribe_statement"] = (subscribe_statement, "SELECT event_id, value FROM events WHERE user_id = 5 AND event_id >= 500")


def cdc_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Missing numbers of a change stream, per table."""
    e = table(spark, d, "events").where("event_id % 9 <> 4").select(F.col("event_type").alias("table"), F.col("event_id").alias("seq"))
    return views.gaps(e, "seq")


REGISTERED["cdc_gaps"] = (cdc_gaps, """SELECT "table", seq AS "from", nxt AS "to", nxt - seq - 1 AS missing FROM (
  SELECT event_type AS "table", event_id AS seq, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS nxt FROM events WHERE event_id % 9 <> 4) WHERE nxt > seq + 1""")


def subscribe_match(spark: SparkSession, d: str) -> DataFrame:
    """Two polls of a subscribed pattern while its graph grows: the second gives the nations that are new in a region."""
    from quadra.operators.graph import Edges, Graph
    from quadra.plans import cypher
    from quadra.streaming.subscribe import parse

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    graphs = [Graph({"Nation": (n, "n_nationkey"), "Region": (r, "r_regionkey")}, {"PART_OF": [Edges(e, "n_nationkey", "n_regionkey", "Nation", "Region")]}) for e in (n.where("n_nationkey % 2 = 0"), n)]
    s = parse("SUBSCRIBE MATCH (n:Nation)-[:PART_OF]->(r:Region) RETURN r.r_name AS region, n.n_name AS nation EVERY 1s DELTA", lambda text: cypher.query(graphs.pop(0), spark, text))
    s.poll()
    return s.poll()


REGISTERED["subscribe_match"] = (subscribe_match, "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1")
