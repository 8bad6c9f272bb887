"""SparkSession factory with the settings the engine's semantics rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that results depend on (UTC, ANSI errors) or that let Spark re-plan at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, **settings: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session to the operators."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName("quadra")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g"} | settings
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
