"""From raw documents to token files: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet
and reread as the next one's docs. When a stage's result is written, the tables it was made from are deleted; the token
files of the last stage stay.

Cases: texts without a letter go in the first stage; texts without words never take part in near-dedup; empty tables
pass through every stage; nulls, repeated rows and extra columns of any name are kept as each stage's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritstone.llm import decontaminate, language_id, mixing, near_duplicates, token_files
from gritstone.llm._shared import Scratch, remove

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", near_duplicates.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_output", token_files.stage),
]

#: SQL can express neither the language model nor the near-duplicate stage; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = len(Scratch.made)
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
        if k < len(STAGES) - 1:
            for folder in Scratch.made[made:]:
                remove(spark, folder)
    return docs
