"""Composed plans: the two-split diagnostic and the contrast table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions import metrics as M
from gritstone.operators import ml, resample
from gritstone.operators import scores as S

PRE, POST = ["lg"], ["s_or_half", "ok", "sp", "diff"]


def features(df: DataFrame) -> DataFrame:
    """Gate logit and the four expert columns; an invalid expert is 0.5 with flag 0."""
    s = F.when(F.col("valid"), F.col("s")).otherwise(F.lit(0.5))
    return df.withColumns({"lg": M.logit("p_gate"), "s_or_half": s, "ok": F.col("valid").cast("double"), "sp": s * F.col("p_gate"), "diff": s - F.col("p_gate")})


def two_split(validation: DataFrame, test: DataFrame, replicates: int = 5000, margin: float = 0.02) -> DataFrame:
    """Locked models of validation applied to test: metrics before and after, bootstrap interval and verdict."""
    scored = ml.matched_pair(features(validation), features(test), PRE, POST)
    ci = resample.paired_bootstrap(scored, "y", "pred_pre", "pred_post", "grp", "mcc", replicates)
    pre = M.thresholded(scored, "y", "pred_pre").select(F.col("mcc").alias("mcc_pre"), F.col("f1").alias("f1_pre"))
    post = M.thresholded(scored, "y", "pred_post").select(F.col("mcc").alias("mcc_post"), F.col("f1").alias("f1_post"))
    return pre.crossJoin(post).crossJoin(ci.withColumn("verdict", M.verdict("delta", "lo", "hi", F.lit(margin))))


def single_split(df: DataFrame, replicates: int = 5000, margin: float = 0.02, k: int = 3) -> DataFrame:
    """One split for both: out-of-fold scores of the gate alone and with the expert, their metrics at the split's own
    thresholds, bootstrap interval and verdict. Folds are by hash, so no row is scored by a model that saw it."""
    rows = features(df)
    pre = ml.out_of_fold(rows, PRE, k=k).select("id", F.col("oof").alias("s_pre"))
    both = ml.out_of_fold(rows, PRE + POST, k=k).select("id", "y", "grp", F.col("oof").alias("s_post")).join(pre, "id")
    for arm in ("pre", "post"):
        tau = S.threshold_search(both, "y", f"s_{arm}").select(F.col("tau").alias(f"tau_{arm}"))
        both = both.crossJoin(F.broadcast(tau)).withColumn(f"pred_{arm}", (F.col(f"s_{arm}") >= F.col(f"tau_{arm}") - 1e-12).cast("int"))
    ci = resample.paired_bootstrap(both, "y", "pred_pre", "pred_post", "grp", "mcc", replicates)
    side = lambda arm: M.thresholded(both, "y", f"pred_{arm}", f"tau_{arm}").select(f"tau_{arm}", F.col("mcc").alias(f"mcc_{arm}"), F.col("f1").alias(f"f1_{arm}"), F.col("balanced_accuracy").alias(f"ba_{arm}"))
    return side("pre").crossJoin(side("post")).crossJoin(ci.withColumn("verdict", M.verdict("delta", "lo", "hi", F.lit(margin))))


def contrast_table(df: DataFrame, contrasts: dict[str, tuple[str, str]], y: str = "y", unit: str = "id", by: str = "dataset", replicates: int = 5000, margin: float = 0.02) -> DataFrame:
    """Per contrast and dataset: delta, interval, verdict, McNemar and Holm over all. contrasts: name to (a, b) columns."""
    out = None
    for name, (a, b) in contrasts.items():
        ci = resample.paired_bootstrap(df, y, a, b, unit, "mcc", replicates, [by])
        counts = df.groupBy(by).agg(*[c.alias(k) for k, c in S.mcnemar_counts(y, a, b).items()])
        rows = ci.join(counts, by, "left").select(F.lit(name).alias("contrast"), by, "delta", "lo", "hi", "n_boot", "n_degenerate", "b", "c")
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("verdict", M.verdict("delta", "lo", "hi", F.lit(margin))).withColumn("p", S.mcnemar_p("b", "c"))
    return S.holm(out.withColumn("_k", F.concat_ws("|", "contrast", by)), "p", key="_k").drop("_k")
