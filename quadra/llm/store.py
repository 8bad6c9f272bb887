"""Where operators put intermediate tables: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is set, a temporary one in local mode and else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quadra-")
        spark.sparkContext._jsc.sc().conf().set("spark.checkpoint.dir", base)
    return base.rstrip("/") if "://" in base or base.startswith("file:") else "file://" + base.rstrip("/")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's URI, for tasks that read and write files of their own."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


class Workspace:
    """A fresh folder for one run's tables. ``drop`` deletes a table that no later plan reads; the rest, which a
    result that is not yet written may read, goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        target, fs = self._hadoop(self.path)
        fs.mkdirs(target)
        fs.deleteOnExit(target)

    def _hadoop(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def new_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: later plans start from files, whatever executors are lost."""
        path = self.new_path(name)
        # zstd needs no pooled direct buffers, which many small writes would pile up beside the heap
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quadra_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        for table in tables:
            self.delete(table if isinstance(table, str) else table._quadra_path)

    def delete(self, path: str) -> None:
        target, fs = self._hadoop(path)
        fs.delete(target, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound Arrow batches by rows, as texts may be long; a smaller value that the user set stays.

    The setting stays with the session, because the result's plan reads it when the caller runs it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
