"""Streaming forms: rollups, late data by series, deduplicated change streams."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quadra.operators.timeseries import Rollup, rollup, window_start
from quadra.sources.shared import shared_dir


def work_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(df: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Run a stream over all it has now; gives its rows. In update mode the last row of each ``key`` stands.

    Batches are written with their number, so a batch that runs twice replaces itself.
    """
    spark = df.sparkSession
    where = work_dir(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/_batch={number}")

    query = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{where}/state").foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rows = spark.read.schema(df.schema.add("_batch", "long")).parquet(f"{where}/rows")
    if key:
        rows = rows.groupBy(*key).agg(F.max_by(F.struct("*"), "_batch").alias("_last")).select("_last.*")
    return rows.drop("_batch")


def live_rollup(stream: DataFrame, keys: list[str], ts: str, config: Rollup) -> DataFrame:
    """A rollup in update mode with a watermark at the late window (one for all series)."""
    config.check_live()
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{int(config.late_window * 1000)} milliseconds")
    w = F.window(ts, f"{int(config.interval * 1000)} milliseconds")
    from quadra.operators.timeseries import _MAKE

    aggs = [_MAKE[f](F.col(c).cast("double")).alias(f"{c}_{f}") for c in config.columns for f in config.functions]
    return marked.groupBy(*keys, w.alias("w")).agg(*aggs).withColumn(ts, F.col("w.start").cast("timestamp_ntz")).drop("w")


def series_rollup(stream: DataFrame, key: str, ts: str, column: str, width: float, late_window: float) -> DataFrame:
    """Exact rule for late data: each series has its own mark, the greatest window it has seen.

    Windows behind the mark by at most ``late_window`` are computed again, older rows are dropped. Emits
    (key, start, n, total, low, high) of every window that a batch changed; read with ``drain(..., 'update', key)``.
    Rows are folded by window, a frame at a time; a series is one task's, as its mark depends on the order of its rows.
    """
    key_type = stream.schema[key].dataType.simpleString()
    step, horizon = int(width * 1e6), int(late_window * 1e6)

    def fold(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, windows = (state.get[0], pickle.loads(state.get[1])) if state.exists else (None, {})
        changed: dict[int, Any] = {}
        for frame in frames:
            start = frame["_us"].to_numpy() // step * step
            if not len(start):
                continue
            # the mark before each row; a row that is dropped lies behind it and does not move it
            marks = np.maximum.accumulate(np.append(start[0] if mark is None else mark, start))
            kept = frame["_x"][marks[:-1] - start <= horizon]
            mark = int(marks[-1])
            for s, n, total, low, high in kept.groupby(start[kept.index]).agg(["size", "sum", "min", "max"]).itertuples():
                old = windows.get(s, (0, 0.0, float("inf"), float("-inf")))
                windows[s] = changed[s] = (old[0] + n, old[1] + total, min(old[2], low), max(old[3], high))
        # windows that no row can change any more leave the state
        windows = {s: w for s, w in windows.items() if mark - s <= horizon}
        state.update((mark, pickle.dumps(windows)))
        yield pd.DataFrame([(key_[0], s, *w) for s, w in changed.items()], columns=[key, "start_us", "n", "total", "low", "high"])

    rows = stream.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(column).cast("double").alias("_x"))
    out = f"{key} {key_type}, start_us long, n long, total double, low double, high double"
    return rows.groupBy(key).applyInPandasWithState(fold, out, "mark long, windows binary", "update", GroupStateTimeout.NoTimeout)


def change_stream(stream: DataFrame, ts: str, lateness: str = "1 hour") -> DataFrame:
    """At-least-once events, each mutation once within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["mutation_id"])


__all__ = ["change_stream", "drain", "live_rollup", "rollup", "series_rollup", "table_stream", "window_start", "work_dir"]
