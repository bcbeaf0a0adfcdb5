"""How the engine's concepts are bound to the driver's tables, in Spark and in DuckDB SQL, and the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that costs far more than moving its rows: files of few row groups give few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, so that a run of very long texts stays small in a Python worker."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def h8(key, arm: str) -> Column:
    """First 8 hex digits of sha256(key:arm) as a number."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(f":{arm}")), 256), 1, 8), 16, 10).cast("long")


def h8_sql(key: str, arm: str) -> str:
    return f"(('0x' || substr(sha256({key} || ':{arm}'), 1, 8))::BIGINT)"


def u(key, arm: str) -> Column:
    return h8(key, arm) / F.lit(4294967296.0)


def u_sql(key: str, arm: str) -> str:
    return f"({h8_sql(key, arm)} / 4294967296.0::DOUBLE)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as evaluation rows: id, dataset, grp, y, z, p_gate, s, valid, split and predictions of three arms."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("dataset"), F.col("source").alias("grp"), F.col("quality").cast("int").alias("y"), F.col("toxic").cast("int").alias("z")
    )
    flip = lambda arm, rate: F.when(u("id", arm) < rate, 1 - F.col("y")).otherwise(F.col("y"))
    return rows.withColumns(
        {
            "p_gate": u("id", "gate"),
            "s": F.lit(0.5) * u("id", "s") + F.lit(0.4) * F.col("y"),
            "valid": u("id", "valid") >= 0.04,
            "split": F.when(F.pmod(h8("id", "split"), F.lit(10)) < 8, "train").when(F.pmod(h8("id", "split"), F.lit(10)) == 8, "validation").otherwise("test"),
            "pred_a": F.when(u("id", "va") >= 0.05, flip("a", 0.2)),
            "pred_b": F.when(u("id", "vb") >= 0.05, flip("b", 0.3)),
            "pred_c": F.when(u("id", "vc") >= 0.05, flip("c", 0.25)),
        }
    )


def _flip(arm: str, rate: float) -> str:
    return f"CASE WHEN {u_sql('d.doc_id', 'v' + arm)} >= 0.05 THEN CASE WHEN {u_sql('d.doc_id', arm)} < {rate} THEN 1 - quality ELSE quality END END"


#: The CTE `rec` for oracles.
REC = f"""rec AS (
  SELECT d.doc_id AS id, lang AS dataset, source AS grp, quality::INT AS y, toxic::INT AS z, {u_sql("d.doc_id", "gate")} AS p_gate,
    0.5::DOUBLE * {u_sql("d.doc_id", "s")} + 0.4::DOUBLE * quality AS s, {u_sql("d.doc_id", "valid")} >= 0.04 AS valid,
    CASE WHEN {h8_sql("d.doc_id", "split")} % 10 < 8 THEN 'train' WHEN {h8_sql("d.doc_id", "split")} % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
    ({_flip("a", 0.2)})::INT AS pred_a, ({_flip("b", 0.3)})::INT AS pred_b, ({_flip("c", 0.25)})::INT AS pred_c
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as function samples: id, text, label, project, dataset, split."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), "text", F.coalesce(F.col("quality"), F.lit(0)).cast("int").alias("label"), F.col("source").alias("project"), F.col("lang").alias("dataset"))
    return rows.withColumn("split", F.when(F.pmod(h8("id", "split"), F.lit(10)) < 8, "train").otherwise("test"))


SAMPLES = f"""samples AS (
  SELECT d.doc_id AS id, text, COALESCE(quality, 0)::INT AS label, source AS project, lang AS dataset,
    CASE WHEN {h8_sql("d.doc_id", "split")} % 10 < 8 THEN 'train' ELSE 'test' END AS split
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

#: White-space words of a text, and their distinct list, in DuckDB.
WORDS = "COALESCE(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'), [])"
