"""Time series: tumbling rollups, cascades, late data, retention. Times are timestamps without zone (UTC)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86_400, "": 1}
FUNCTIONS = ("min", "max", "avg", "median", "stddev", "count", "sum")


class ConfigError(ValueError):
    """A rollup configuration that cannot work."""


def seconds(text: str) -> float:
    """``100ms``, ``30s``, ``5m``, ``1h``, ``1d``; a bare number is seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|[smhd]|)\s*", text)
    if not m:
        raise ConfigError(f"invalid duration: {text!r}")
    return int(m[1]) * _SECONDS[m[2]]


@dataclass
class Rollup:
    """What a table's extensions ask for: width, functions, target, columns, cascade, horizon for late data."""

    interval: float
    functions: list[str]
    target: str
    columns: list[str]
    late_window: float = 0
    multipliers: list[int] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)

    @classmethod
    def of_extensions(cls, ext: dict[str, str], own: set[str] | None = None) -> Rollup:
        """From a table's extensions; ``own`` names the user's functions that it may ask for."""
        missing = [k for k in ("interval", "functions", "target", "columns") if not ext.get(f"consolidation.{k}")]
        if missing:
            raise ConfigError(f"missing consolidation.{missing[0]}")
        get = lambda k, default="": ext.get(f"consolidation.{k}", default)
        many = lambda text: [x.strip() for x in text.split(",") if x.strip()]
        width = seconds(get("interval"))
        if width <= 0:
            raise ConfigError("the interval must be positive")
        names = ["avg" if f == "mean" else f for f in many(re.sub(r"composite\((.*)\)", r"\1", get("functions").lower()))]
        unknown = [f for f in names if f not in FUNCTIONS and f not in (own or ())]
        if unknown:
            raise ConfigError(f"unknown consolidation function: {unknown[0]!r}")
        late = seconds(get("late_window")) if get("late_window") else 2 * width
        factors = [int(x) for x in many(get("cascade_multipliers"))]
        targets = many(get("cascade"))
        if len(set([get("target"), *targets])) != 1 + len(targets):
            raise ConfigError("a cascade must not come back to a table it has fed")
        if targets and len(factors) != len(targets):
            raise ConfigError("one multiplier per cascade tier")
        return cls(width, names, get("target"), many(get("columns")), late, factors, targets)

    def check_live(self) -> None:
        batch = [f for f in self.functions if f == "median" or f not in FUNCTIONS]
        if batch:
            raise ConfigError(f"{batch[0]} has no running form: batch only")


def window_start(ts: Column, width: float) -> Column:
    """Start of the tumbling window, counted from 1970 and rounded down before it too."""
    micros = F.unix_micros(ts.cast("timestamp"))
    step = F.lit(int(width * 1e6))
    return F.timestamp_micros(micros - F.pmod(micros, step)).cast("timestamp_ntz")


_MAKE = {"min": F.min, "max": F.max, "avg": F.avg, "median": F.median, "stddev": F.stddev_pop, "count": lambda c: F.count(c).cast("double"), "sum": F.sum}


def rollup(df: DataFrame, keys: list[str], ts: str, columns: list[str], functions: list[str], width: float, own: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per key and window: ``{column}_{function}``, and the window's start under the name of ``ts``.

    ``own``: the user's aggregates, by name.
    """
    make = _MAKE | (own or {})
    aggs = [make[f](F.col(c).cast("double")).alias(f"{c}_{f}") for c in columns for f in functions]
    return df.groupBy(*keys, window_start(F.col(ts), width).alias(ts)).agg(*aggs)


def states(df: DataFrame, keys: list[str], ts: str, columns: list[str], width: float) -> DataFrame:
    """Mergeable states per window: count, sum, mean and squared deviations, min, max."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.sum(x).alias(f"{c}__s"), (F.var_pop(x) * F.count(x)).alias(f"{c}__m2"), F.min(x).alias(f"{c}__lo"), F.max(x).alias(f"{c}__hi")]
    return df.groupBy(*keys, window_start(F.col(ts), width).alias(ts)).agg(*aggs)


def merge_states(tier: DataFrame, keys: list[str], ts: str, columns: list[str], width: float) -> DataFrame:
    """States of wider windows from those of narrower ones; deviations add up exactly around the joint mean."""
    aggs = []
    for c in columns:
        n, s, m2 = F.col(f"{c}__n"), F.col(f"{c}__s"), F.col(f"{c}__m2")
        around = F.sum(m2) + F.sum(F.when(n > 0, s * s / n)) - F.sum(s) * F.sum(s) / F.sum(n)
        aggs += [F.sum(n).alias(f"{c}__n"), F.sum(s).alias(f"{c}__s"), F.greatest(around, F.lit(0.0)).alias(f"{c}__m2"), F.min(f"{c}__lo").alias(f"{c}__lo"), F.max(f"{c}__hi").alias(f"{c}__hi")]
    return tier.groupBy(*keys, window_start(F.col(ts), width).alias(ts)).agg(*aggs)


def of_states(tier: DataFrame, keys: list[str], ts: str, columns: list[str], functions: list[str]) -> DataFrame:
    """Output columns from states; every tier has the same names."""
    out = []
    for c in columns:
        n, s = F.col(f"{c}__n"), F.col(f"{c}__s")
        have = {"count": n.cast("double"), "sum": s, "avg": s / n, "stddev": F.sqrt(F.col(f"{c}__m2") / n), "min": F.col(f"{c}__lo"), "max": F.col(f"{c}__hi")}
        out += [have[f].alias(f"{c}_{f}") for f in functions]
    return tier.select(*keys, ts, *out)


def cascade(df: DataFrame, keys: list[str], ts: str, config: Rollup) -> dict[str, DataFrame]:
    """Every tier of a rollup by target name, each made from the tier below it."""
    config.check_live()
    tier, width = states(df, keys, ts, config.columns, config.interval), config.interval
    out = {config.target: of_states(tier, keys, ts, config.columns, config.functions)}
    for target, factor in zip(config.targets, config.multipliers, strict=True):
        width *= factor
        tier = merge_states(tier, keys, ts, config.columns, width)
        out[target] = of_states(tier, keys, ts, config.columns, config.functions)
    return out


def classify_late(df: DataFrame, keys: list[str], ts: str, arrival: str, width: float, late_window: float) -> DataFrame:
    """Adds ``late``: fresh, stale or drop, against the greatest window its series had before the row arrived."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    start = F.unix_micros(window_start(F.col(ts), width).cast("timestamp"))
    df = df.withColumn("_start", start).withColumn("_mark", F.max("_start").over(before))
    by = F.col("_mark") - F.col("_start")
    late = F.when(F.col("_mark").isNull() | (by <= 0), "fresh").when(by <= int(late_window * 1e6), "stale").otherwise("drop")
    return df.withColumn("late", late).drop("_start", "_mark")


def debounced(late: DataFrame, keys: list[str], arrival: str, hold: float = 0.1) -> DataFrame:
    """Requests to aggregate a window again: (keys, ready, rows). Of late rows of one key (a series' window), those within
    ``hold`` seconds of the first are one request, which is ready ``hold`` after it; the next row begins another.

    A key's arrivals are sorted and folded; arrays hold one number a row, and a key is one window of one series.
    """
    span = int(hold * 1e6)
    times = late.groupBy(*keys).agg(F.array_sort(F.collect_list(F.unix_micros(F.col(arrival).cast("timestamp")))).alias("_t"))
    request = "struct<first:bigint,rows:bigint>"
    begun = F.struct(F.expr(f"cast(null as {request})").alias("open"), F.expr(f"cast(array() as array<{request}>)").alias("done"))
    one = lambda first, rows: F.struct(first.alias("first"), rows.cast("bigint").alias("rows"))

    def step(s: Column, t: Column) -> Column:
        o = s["open"]
        joins = F.coalesce(t < o["first"] + span, F.lit(False))
        done = F.when(joins | o.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(o)))
        return F.struct(F.when(joins, one(o["first"], o["rows"] + 1)).otherwise(one(t, F.lit(1))).alias("open"), done.alias("done"))

    requests = times.select(*keys, F.explode(F.aggregate("_t", begun, step, lambda s: F.concat(s["done"], F.array(s["open"])))).alias("r"))
    return requests.select(*keys, F.timestamp_micros(F.col("r.first") + span).cast("timestamp_ntz").alias("ready"), F.col("r.rows").alias("rows"))


def segment(ts: Column, width: float) -> Column:
    """Name of a retention segment: ``rrd-`` and its start in milliseconds."""
    return F.concat(F.lit("rrd-"), F.unix_millis(window_start(ts, width).cast("timestamp")))


def retained(df: DataFrame, ts: str, now: Column, keep: float) -> DataFrame:
    """Rows at or after the retention floor; with segments as partitions, older ones are not read."""
    return df.where(F.col(ts) >= F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - int(keep * 1e6)).cast("timestamp_ntz"))
