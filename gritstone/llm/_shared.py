"""Shared-folder tables, and small helpers that all operators of the subpackage use."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents with this remainder of crc32(doc_id as text) by 4 are never learned from.
HELD_OUT = 2


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="gritstone-"))
    return base.rstrip("/")


class Scratch:
    """Tables of one operator call in the shared folder.

    ``save`` writes a frame as Parquet and reads it back, which cuts lineage: a lost executor costs a reread,
    not a rerun. ``finish`` saves the result and deletes the tables that led to it. ``made`` lists the folders of all
    calls, so that who has written a result elsewhere can remove them.
    """

    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of the steps so far: it does so when its driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

    def finish(self, df: DataFrame) -> DataFrame:
        out = self.save(df, "result")
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            if status.getPath().getName() != "result":
                fs.delete(status.getPath(), True)
        return out


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits, whatever the number of rows, of the low bits of a column of longs."""
    bit = F.pmod(F.col(column), F.lit(1 << bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
    words = hashes.groupBy(F.floor(bit / 64).cast("int").alias("cell")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["cell"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(own: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bitmap; none that is in it is missed."""
    u = np.uint64
    at = hashes & u(64 * len(own) - 1)
    return (own[(at >> u(6)).astype(np.int64)] >> (at & u(63))) & u(1) != 0


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def small_batches(spark: SparkSession, rows: int = 2000):
    """Arrow batches of few rows, so that a run of very long texts stays small in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > 16 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def worker_state(key, make):
    """What a Python worker keeps from task to task; functions travel by value, so their globals don't last."""
    kept = sys.modules.setdefault("gritstone_worker_state", types.ModuleType("gritstone_worker_state")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def release_worker_state() -> None:
    """Frees what an earlier operator kept in this worker."""
    sys.modules.setdefault("gritstone_worker_state", types.ModuleType("gritstone_worker_state")).__dict__.setdefault("kept", {}).clear()
