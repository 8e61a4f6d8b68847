"""Tables written once to the folder that all executors share, instead of being computed for every use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of scratch tables: what a writing task holds.
GROUP = 16 << 20
#: Rows of a table that is broadcast at most; a larger one is joined by a shuffle.
FEW = 1_000_000


def light(table: DataFrame) -> DataFrame:
    """``table``, which joins broadcast if it has few rows.  It is counted: give a written one."""
    return F.broadcast(table) if table.count() <= FEW else table


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it has run, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local master that has none."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = os.path.join(tempfile.gettempdir(), f"skeinflow-{sc.applicationId}")
    sc.setCheckpointDir(base)
    return base


class Scratch:
    """Tables written once in the shared folder; removed at the end of the session, or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/skeinflow/{name}-{uuid.uuid4().hex}"
        fs, path = self._fs(self.base)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def path(self, tag: str) -> str:
        return f"{self.base}/{tag}-{uuid.uuid4().hex[:8]}"

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        where = self.path(tag)
        with lean(self.spark):
            df.write.option("parquet.block.size", GROUP).option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def read(self, parts: list[DataFrame]) -> DataFrame:
        """Written tables of one schema as one."""
        return self.spark.read.schema(parts[0].schema).parquet(*(x._scratch_path for x in parts))

    def remove(self, where: str) -> None:
        fs, path = self._fs(where)
        fs.delete(path, True)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            where = getattr(df, "_scratch_path", None)
            if where:
                self.remove(where)

    def clear(self) -> None:
        """Remove all its tables at once."""
        self.remove(self.base)


def keep(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back: later plans start from there, and its size is known to them."""
    return Scratch(df.sparkSession, "log").put(df, tag)
