"""Time-series queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadra.operators import timeseries as ts
from quadra.sources.tables import table

REGISTERED: dict = {}
EXT = {"consolidation.interval": "5m", "consolidation.functions": "min,max,avg,stddev,count,sum", "consolidation.target": "t5m", "consolidation.columns": "value", "consolidation.late_window": "15m", "consolidation.cascade": "t1h,t1d", "consolidation.cascade_multipliers": "12,24"}
_B = "time_bucket(INTERVAL '{w}', ts)"
_ALL = "min(value) AS value_min, max(value) AS value_max, round(avg(value), 6) AS value_avg, round(stddev_pop(value), 6) AS value_stddev, CAST(count(value) AS DOUBLE) AS value_count, round(sum(value), 4) AS value_sum"


def _rounded(df: DataFrame) -> DataFrame:
    for c, n in (("value_avg", 6), ("value_stddev", 6), ("value_sum", 4), ("value_median", 6)):
        if c in df.columns:
            df = df.withColumn(c, F.round(c, n))
    return df


REGISTERED["ts_rollup_5m"] = (lambda spark, d: _rounded(ts.rollup(table(spark, d, "events"), ["user_id"], "ts", ["value"], ["min", "max", "avg", "stddev", "count", "sum"], 300)),
                              f"SELECT user_id, {_B.format(w='5 minutes')} AS ts, {_ALL} FROM events GROUP BY 1, 2")
REGISTERED["ts_rollup_composite"] = (lambda spark, d: _rounded(ts.rollup(table(spark, d, "events").withColumn("twice", F.col("value") * 2), ["event_type"], "ts", ["value", "twice"], ["min", "avg"], 86_400)).withColumn("twice_avg", F.round("twice_avg", 6)),
                                     f"SELECT event_type, {_B.format(w='1 day')} AS ts, min(value) AS value_min, round(avg(value), 6) AS value_avg, min(value * 2) AS twice_min, round(avg(value * 2), 6) AS twice_avg FROM events GROUP BY 1, 2")
REGISTERED["ts_median_batch"] = (lambda spark, d: _rounded(ts.rollup(table(spark, d, "events"), ["event_type"], "ts", ["value"], ["median"], 3600)),
                                 f"SELECT event_type, {_B.format(w='1 hour')} AS ts, round(median(value), 6) AS value_median FROM events GROUP BY 1, 2")
for _t, _w in (("t1h", "1 hour"), ("t1d", "1 day")):
    REGISTERED[f"ts_cascade_{_t[1:]}"] = (lambda spark, d, t=_t: _rounded(ts.cascade(table(spark, d, "events"), ["user_id"], "ts", ts.Rollup.of_extensions(EXT))[t]),
                                          f"SELECT user_id, {_B.format(w=_w)} AS ts, {_ALL} FROM events GROUP BY 1, 2")


def ts_late_classify(spark: SparkSession, d: str) -> DataFrame:
    """Arrival shuffled by event_id % 7: how many rows of each type are fresh, stale or dropped."""
    e = table(spark, d, "events").withColumn("arrival", F.struct(F.col("event_id") % 7, "event_id"))
    return ts.classify_late(e, ["event_type"], "ts", "arrival", 300, 900).groupBy("event_type", "late").agg(F.count("*").alias("n"))


REGISTERED["ts_late_classify"] = (ts_late_classify, f"""SELECT event_type, CASE WHEN mark IS NULL OR s >= mark THEN 'fresh' WHEN mark - s <= INTERVAL 15 MINUTES THEN 'stale' ELSE 'drop' END AS late, count(*) AS n
FROM (SELECT event_type, {_B.format(w='5 minutes')} AS s, max({_B.format(w='5 minutes')}) OVER (PARTITION BY event_type ORDER BY event_id % 7, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM events) GROUP BY 1, 2""")
REGISTERED["ts_retention"] = (lambda spark, d: ts.retained(table(spark, d, "events"), "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 7 * 86_400).groupBy(ts.segment(F.col("ts"), 86_400).alias("segment")).agg(F.count("*").alias("n")),
                              "SELECT 'rrd-' || epoch_ms(time_bucket(INTERVAL '1 day', ts)) AS segment, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-23' GROUP BY 1")
REGISTERED["ts_user_function"] = (lambda spark, d: ts.rollup(table(spark, d, "events"), ["event_type"], "ts", ["value"], ["max", "spread"], 86_400, {"spread": lambda c: F.round(F.max(c) - F.min(c), 6)}),
                                  f"SELECT event_type, {_B.format(w='1 day')} AS ts, max(value) AS value_max, round(max(value) - min(value), 6) AS value_spread FROM events GROUP BY 1, 2")


def ts_debounced(spark: SparkSession, d: str) -> DataFrame:
    """Requests for the windows of each type of event, rows within a minute put together."""
    e = table(spark, d, "events").select("event_type", ts.window_start(F.col("ts"), 3600).alias("window"), "ts")
    return ts.debounced(e, ["event_type", "window"], "ts", 60)


REGISTERED["ts_debounced"] = (ts_debounced, f"""WITH RECURSIVE e AS (SELECT event_type, {_B.format(w='1 hour')} AS win, ts FROM events),
r AS (SELECT event_type, win, min(ts) AS first FROM e GROUP BY 1, 2 UNION ALL
  SELECT event_type, win, first FROM (SELECT r.event_type, r.win, (SELECT min(ts) FROM e WHERE e.event_type = r.event_type AND e.win = r.win AND e.ts >= r.first + INTERVAL 60 SECONDS) AS first FROM r) WHERE first IS NOT NULL)
SELECT r.event_type, r.win AS "window", first + INTERVAL 60 SECONDS AS ready, count(*) AS rows
FROM r JOIN e ON e.event_type = r.event_type AND e.win = r.win AND e.ts >= first AND e.ts < first + INTERVAL 60 SECONDS GROUP BY 1, 2, 3""")
