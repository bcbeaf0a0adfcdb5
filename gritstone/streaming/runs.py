"""Resumable runs: content-addressed identity, exactly-once append by micro-batch, retries, and windowed event counts."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators.tables import ContractError

RETRY_NEVER = (400, 401, 403, 404, 422)


def run_identity(config: dict, n: int = 12) -> str:
    """First hex digits of sha256 of the configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:n]


def delays(attempts: int = 5, first: float = 5.0, most: float = 120.0) -> list[float]:
    """Seconds before each retry: doubling, bounded."""
    return [min(most, first * 2**k) for k in range(attempts - 1)]


def with_retries(call: Callable, attempts: int = 5, sleep: Callable = lambda s: None):
    """(result, error, attempts used). Errors with a status in RETRY_NEVER aren't retried; an exhausted row stays, invalid."""
    waits, error = delays(attempts), None
    for k in range(attempts):
        try:
            return call(), None, k + 1
        except Exception as e:  # noqa: BLE001
            error = e
            if getattr(e, "status", None) in RETRY_NEVER:
                return None, e, k + 1
            if k < len(waits):
                sleep(waits[k])
    return None, error, attempts


def pending(specs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Specs of a run that have no record yet."""
    return specs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def check_journal(records: DataFrame, events: DataFrame, identity: str) -> None:
    """Raises on duplicate records, records of another run, or attempts without a record."""
    if records.filter(F.col("run") != identity).limit(1).count():
        raise ContractError("records of another run")
    if records.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ContractError("a record appears twice")
    if events.select("key").distinct().join(records, "key", "left_anti").limit(1).count():
        raise ContractError("an attempt has no record")


def _hadoop(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@contextmanager
def run_lock(spark: SparkSession, folder: str):
    """Holds a run's folder: a second holder is refused until the first has left, on any store that Spark writes.

    The lock is a file that is created only if it isn't there; one left by a killed run is to be looked at, then removed.
    """
    fs, path = _hadoop(spark, f"{folder}/.execution.lock")
    fs.mkdirs(path.getParent())
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if fs.exists(path):
            raise ContractError("the run is locked") from e
        raise
    try:
        out.write(bytearray(str(spark.sparkContext.applicationId).encode()))
        out.close()
        yield
    finally:
        fs.delete(path, False)


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name and renames it, so that readers see the old or the new one, whole."""
    fs, target = _hadoop(spark, path)
    _, temporary = _hadoop(spark, f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(temporary, target):
        fs.delete(target, False)
        fs.rename(temporary, target)


def resumable_matrix(rows: DataFrame, path: str, identity: str, embed: Callable[[DataFrame], DataFrame], key: str = "id", parts: int = 16) -> DataFrame:
    """embed(rows) written part by part under path/identity=.../part=...; parts that are there aren't made again.

    A part is the rows of one remainder of the key's hash; Spark's commit makes it appear whole or not at all, and another
    identity (of inputs and encoder) has a folder of its own, so stale vectors are never mixed in.
    """
    spark = rows.sparkSession
    root = f"{path}/identity={identity}"
    for k in range(parts):
        fs, done = _hadoop(spark, f"{root}/part={k}/_SUCCESS")
        if not fs.exists(done):
            embed(rows.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k)).write.mode("overwrite").parquet(f"{root}/part={k}")
    out = spark.read.parquet(root)
    if out.count() != rows.count() or out.select(key).distinct().count() != out.count():
        raise ContractError("the matrix and its rows differ")
    return out.drop("part")


def run_stream(source: DataFrame, score: Callable[[DataFrame], DataFrame], records: str, checkpoint: str, identity: str, key: str = "id"):
    """Starts a stream that scores rows not yet recorded and appends them under records/run=<identity>.

    A micro-batch that runs again after a failure finds its rows recorded and adds nothing.
    """
    path = f"{records}/run={identity}"

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scored = score(batch).withColumn("batch", F.lit(batch_id))
        try:
            scored = pending(scored, spark.read.parquet(path), key)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        scored.write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint}/{identity}").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of event types by tumbling windows; late rows beyond the watermark are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path)
