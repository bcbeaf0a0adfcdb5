"""Readers. Paths may be any that Spark reads; schemas are given, not inferred, where the caller knows them."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.operators.tables import ContractError, last_of_each, resolve

NODE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "type", "code", "identifier")] + [T.StructField("is_cfg", T.BooleanType())])
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("start", "end", "type", "var")])
SAMPLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("func", T.StringType()), T.StructField("target", T.IntegerType()), T.StructField("project", T.StringType()), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])
#: Column aliases of gate predictions, in order (fixed values).
GATE_ALIASES = {
    "id": ["id", "record_id", "func_id", "function_uid", "example_id"],
    "y": ["y", "target", "label", "ground_truth", "vuln"],
    "p": ["p_gate", "p", "probability", "prob", "score_gate"],
    "group": ["group", "project", "commit_id"],
}


def json_array(spark: SparkSession, path: str, schema: T.StructType = SAMPLE, most: int | None = None) -> DataFrame:
    """A file that is one JSON array; malformed objects are dropped. One task reads a file: see json_array_lines for large ones."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df if most is None else df.limit(most)


def json_array_lines(spark: SparkSession, path: str, schema: T.StructType = SAMPLE, most: int | None = None) -> DataFrame:
    """A JSON array with an object in each line: Spark splits such a file, however large. Lines that hold no object, and
    objects that can't be read, are dropped. With ``most`` reading stops early."""
    body = F.regexp_replace(F.trim("value"), r"^\[?\s*,?\s*|\s*,?\s*\]?$", "")
    lines = spark.read.text(path).select(body.alias("w")).filter(F.col("w").startswith("{"))
    rows = lines.select(F.from_json("w", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    rows = rows.filter("r._bad is null").select(*[F.col("r").getField(c).alias(c) for c in schema.names])
    return rows if most is None else rows.limit(most)


def first_location(spark: SparkSession, paths: list[str], least_bytes: int = 3) -> str:
    """The first of several places that holds a file of more than trivial size."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if fs.exists(at) and fs.getContentSummary(at).getLength() >= least_bytes:
            return path
    raise ContractError(f"none of {len(paths)} locations has data")


def npy_matrix(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """file, row, embedding of .npy files, or of a member of .npz files; each file is read whole by one task."""

    def load(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = np.load(io.BytesIO(data.as_py()), allow_pickle=False)
                matrix = held if isinstance(held, np.ndarray) else held[member or held.files[0]]
                if matrix.ndim != 2:
                    raise ContractError(f"{name} holds no matrix")
                for at in range(0, len(matrix), 4096):
                    part = matrix[at : at + 4096].astype(np.float32)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), part.shape[1]).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), lists], ["file", "row", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(load, "file string, row long, embedding array<float>")


def yaml_config(text: str) -> dict:
    """A YAML configuration; the parser is optional."""
    import yaml

    return yaml.safe_load(text) or {}


def jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = False) -> DataFrame:
    """JSON lines, gzip by its ending; strict: a line that can't be read raises when the rows are used."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with target and prediction as integers where they parse, else NULL beside the text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumns({f"{c}_int": F.col(c).try_cast("int") for c in ("target", "prediction") if c in df.columns})


def gate_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, y, p and group by alias; the last row of an id counts; ids `reveal:split:hash#n` are grouped by hash."""
    df = spark.read.option("header", True).csv(path).withColumn("_pos", F.monotonically_increasing_id())
    rows = resolve(df, GATE_ALIASES | {"_pos": ["_pos"]}, ["id", "y", "p"])
    rows = last_of_each(rows, "id", "_pos").drop("_pos")
    by_hash = F.regexp_extract("id", r"^reveal:[^:]+:([^#]+)#", 1)
    group = F.col("group") if "group" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("group", F.when(by_hash != "", by_hash).otherwise(group)).withColumn("y", F.col("y").cast("int")).withColumn("p", F.col("p").cast("double"))


def graph_tsv(spark: SparkSession, nodes: str, edges: str) -> DataFrame:
    """key, nodes, edges from tab-separated files; File nodes and edges without both ends are left out."""
    tsv = lambda p: spark.read.option("header", True).option("sep", "\t").csv(p)
    n = tsv(nodes).filter("type <> 'File'").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("id"), "type", "code", "identifier", (F.col("isCFGNode") == "True").alias("is_cfg")))).alias("nodes"))
    e = tsv(edges).filter("start is not null and end is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "var"))).alias("edges"))
    return n.join(e, "key", "left").withColumn("edges", F.coalesce("edges", F.array().cast(T.ArrayType(EDGE))))


def source_files(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """A row for each file: name, func and target by metadata (name, target), else by `label_1` or `label_True` in its name."""
    rows = spark.read.option("wholetext", True).text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("func"))
    named = F.when(F.col("name").rlike("label_(1|True)"), 1).otherwise(0)
    if metadata is None:
        return rows.withColumn("target", named)
    return rows.join(metadata.select("name", F.col("target").alias("_t")), "name", "left").select("name", "func", F.coalesce("_t", named).alias("target"))


def run_records(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """records.jsonl of <dataset>/<split>/<arm>/<seed>; keys are those of the body, and the last row of a key counts."""
    rows = spark.read.schema(schema).json(f"{root}/*/*/*/*/records.jsonl").withColumn("_pos", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    keys = ["dataset", "split", "arm", "seed", "id"]
    names = [c for c in rows.columns if c != "_pos"]
    best = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*names), "_pos").alias("r"))
    return best.select("r.*")


def matrix(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """The frame if every vector has ``dim`` finite numbers; else raises."""
    bad = df.filter(F.col(column).isNull() | (F.size(column) != dim) | F.exists(column, lambda x: x.isNull() | F.isnan(x))).limit(1).count()
    if bad:
        raise ContractError(f"a vector isn't {dim} finite numbers")
    return df


def zip_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """path, member and line of every JSONL member of zip files."""
    import io
    import zipfile

    import pyarrow as pa

    def unzip(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith(".jsonl"):
                            lines = [x for x in z.read(member).decode("utf-8").splitlines() if x.strip()]
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([member] * len(lines)), pa.array(lines)], ["path", "member", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unzip, "path string, member string, line string")


def config_table(spark: SparkSession, settings: dict[str, dict]) -> DataFrame:
    """A small dimension table of a parsed configuration: key and canonical JSON of its value."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(settings.items())], "key string, value string")


def synthetic(spark: SparkSession, n: int, seed: int = 42, invalid: float = 0.04) -> DataFrame:
    """Gate and expert scores of test rows: gaussian logits and a rate of invalid experts."""
    rows = spark.range(n).withColumn("y", (F.rand(seed) < 0.4).cast("int"))
    score = lambda k, pull: F.lit(1.0) / (1 + F.exp(-(F.randn(seed + k) + F.lit(pull) * (F.col("y") - F.lit(0.5)))))
    return rows.withColumn("p_gate", score(1, 1.5)).withColumn("s", score(2, 2.0)).withColumn("valid", F.rand(seed + 3) >= invalid)
