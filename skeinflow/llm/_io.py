"""Shared scratch tables.

Intermediate tables are written as Parquet below the folder named by
``spark.checkpoint.dir`` so that a lost executor costs only the tasks it was
running: whatever was written stays readable by all others.
"""

from __future__ import annotations

import ctypes
import gc
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skeinflow.sources.scratch import FEW, GROUP, light, shared_dir
from skeinflow.sources.scratch import Scratch as Tables

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch that goes to Python at most; Spark's own setting counts in tens of megabytes.
BATCH = 4 << 20


def pick(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` whose key is in ``keys`` (or is not: ``left_anti``), without a shuffle of ``rows`` if ``keys`` has few rows.

    ``keys`` is counted: give a written table.
    """
    return rows.join(light(keys), on, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed, and hand them at most ``BATCH`` bytes at once.

    Rows with long texts would otherwise fill executors' memory; a smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= BATCH:
        spark.conf.set(key, BATCH)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in paths if p]])


def give_back() -> None:
    """Hand freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run):
    """A function for ``mapInArrow`` that gives freed memory back when its task ends: workers live on beside later stages."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


class Scratch(Tables):
    """Tables of operators: compressed more, and Python workers can import this package."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        super().__init__(spark, name)

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        where = self.path(tag)
        df.write.option("parquet.block.size", GROUP).option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def size(self, df: DataFrame) -> int:
        """Bytes of a written table."""
        fs, path = self._fs(df._scratch_path)
        return fs.getContentSummary(path).getLength()

    def read(self, parts: list[DataFrame]) -> DataFrame:
        """Written tables of one schema as one."""
        return self.spark.read.schema(parts[0].schema).parquet(*(x._scratch_path for x in parts))

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of plans that are no longer held: it does so when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
