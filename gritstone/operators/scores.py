"""Score-based statistics: AUROC, AUPRC, threshold search, Holm, McNemar, routing and curves.

Ranks over raw rows are taken from counts of distinct scores: rows are grouped by score first, so the ordered pass sees
one row for each distinct score of a group.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gritstone.functions import metrics as M


def _by_score(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    return df.filter(F.col(s).isNotNull() & ~F.isnan(s)).groupBy(*by, F.col(s).alias("_s")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count("*").alias("_n"))


def auroc(df: DataFrame, y: str, s: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUROC with mid-ranks; NULL if a class is missing."""
    by = by or []
    g = _by_score(df, y, s, by)
    order = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("_mid", F.coalesce(F.sum("_n").over(order), F.lit(0)) + (F.col("_n") + 1) / F.lit(2.0))
    pos, n = F.sum("_pos"), F.sum("_n")
    neg = n - pos
    area = F.try_divide(F.sum(F.col("_pos") * F.col("_mid")) - pos * (pos + 1) / F.lit(2.0), (pos * neg).cast("double"))
    return (g.groupBy(*by) if by else g).agg(area.alias("auroc"))


def auprc(df: DataFrame, y: str, s: str, by: list[str] | None = None) -> DataFrame:
    """Step-wise average precision, ties together; NULL if a class is missing."""
    by = by or []
    g = _by_score(df, y, s, by)
    down = W.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumn("_tp", F.sum("_pos").over(down)).withColumn("_all", F.sum("_n").over(down))
    pos, n = F.sum("_pos"), F.sum("_n")
    ap = F.try_divide(F.sum(F.col("_pos") * F.col("_tp") / F.col("_all")), pos.cast("double"))
    return (g.groupBy(*by) if by else g).agg(F.when((pos > 0) & (pos < n), ap).alias("auprc"))


def roc_points(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    """False- and true-positive rates after each distinct score, from the top."""
    g = _by_score(df, y, s, by)
    down = W.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*by)
    tp, n = F.sum("_pos").over(down), F.sum("_n").over(down)
    pos, total = F.sum("_pos").over(every), F.sum("_n").over(every)
    return g.select(*by, F.col("_s").alias("threshold"), F.try_divide(tp.cast("double"), pos).alias("tpr"), F.try_divide((n - tp).cast("double"), total - pos).alias("fpr"))


def grid(spark) -> DataFrame:
    """Thresholds 0.01 to 0.99 by 0.01."""
    return spark.range(1, 100).select((F.col("id") / F.lit(100.0)).alias("t"))


def threshold_counts(df: DataFrame, y: str, s: str, by: list[str]) -> DataFrame:
    """Confusion counts of s >= t for the whole grid, in one pass: rows are summed by the last grid step they reach."""
    step = F.least(F.greatest(F.floor(F.round(F.col(s) * 100, 9)), F.lit(0)), F.lit(99)).cast("int")
    g = df.groupBy(*by, step.alias("_k")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count("*").alias("_n"))
    keys = g.select(*by).distinct() if by else df.sparkSession.range(1).select()
    full = keys.crossJoin(df.sparkSession.range(0, 100).select(F.col("id").cast("int").alias("_k")))
    full = full.join(g, [*by, "_k"], "left").fillna(0, ["_pos", "_n"])
    up = W.partitionBy(*by).orderBy(F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*by)
    out = full.select(*by, "_k", F.sum("_pos").over(up).alias("tp"), F.sum("_n").over(up).alias("_up"), F.sum("_pos").over(every).alias("_p"), F.sum("_n").over(every).alias("_all"))
    out = out.filter("_k > 0")
    return out.select(*by, (F.col("_k") / F.lit(100.0)).alias("t"), "tp", (F.col("_up") - F.col("tp")).alias("fp"), (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_all") - F.col("_p") - F.col("_up") + F.col("tp")).alias("tn"))


def threshold_search(df: DataFrame, y: str, s: str, by: list[str] | None = None) -> DataFrame:
    """The grid threshold of the largest MCC; within 1e-9 the one nearest 0.5, then the smaller. (0.5, NULL) if undefined."""
    by = by or []
    scored = threshold_counts(df, y, s, by).withColumn("mcc", M.mcc("tp", "fp", "fn", "tn"))
    every = W.partitionBy(*by)
    scored = scored.withColumn("_best", F.max("mcc").over(every))
    near = F.when(F.col("mcc") >= F.col("_best") - 1e-9, F.struct(F.round(F.abs(F.col("t") - 0.5), 9), F.col("t"), F.col("mcc")))
    picked = (scored.groupBy(*by) if by else scored).agg(F.min(near).alias("_x"))
    return picked.select(*by, F.coalesce(F.col("_x")["t"], F.lit(0.5)).alias("tau"), F.col("_x")["mcc"].alias("mcc"))


def holm(df: DataFrame, p: str, by: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Holm step-down: adjusted p as the running maximum of (m - rank) p, at most 1."""
    by = by or []
    order = W.partitionBy(*by).orderBy(p, *([key] if key else []))
    df = df.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count("*").over(W.partitionBy(*by)))
    adjusted = F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("p_holm", F.least(F.lit(1.0), adjusted)).drop("_r", "_m")


def mcnemar_counts(y: str, a: str, b: str) -> dict:
    """b: a right and b wrong; c: a wrong and b right, over rows valid in both."""
    ok = M.valid(a) & M.valid(b)
    return {"b": M.count_where(ok & (F.col(a) == F.col(y)) & (F.col(b) != F.col(y))), "c": M.count_where(ok & (F.col(a) != F.col(y)) & (F.col(b) == F.col(y)))}


@F.pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided binomial under 25 discordant rows, else chi-squared with continuity; 1 without any."""

    def p(x: int, y: int) -> float:
        n = x + y
        if not n:
            return 1.0
        if n < 25:
            return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(x, y) + 1)) / 2**n)
        return math.erfc(math.sqrt((abs(x - y) - 1) ** 2 / n / 2))

    return pd.Series([p(int(x), int(y)) for x, y in zip(b, c)])


def mcnemar_chi2(b, c):
    """The variant that is always chi-squared with max(0, |b - c| - 1); its b and c are swapped. Returns chi2 as a Column."""
    return F.coalesce(F.try_divide(F.pow(F.greatest(F.abs(F.col(b) - F.col(c)) - 1, F.lit(0)).cast("double"), F.lit(2.0)), (F.col(b) + F.col(c)).cast("double")), F.lit(0.0))


def tie_key(key: str):
    """First 8 hex digits of sha256 of the id, as a number."""
    return F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long")


def ranked_calls(df: DataFrame, score: str, key: str) -> DataFrame:
    """_rank from 1 by score descending and the id's hash.

    The rank is exact and global without one task for all rows: rows go to up to 64 ranges of the rank order (by quantiles
    of the score), ranks are taken within each and the sizes of the ranges before are added.
    """
    cuts = df.stat.approxQuantile(score, [i / 64 for i in range(1, 64)], 0.002) if not df.isEmpty() else []
    cuts = sorted(set(cuts), reverse=True)
    where = F.lit(0)
    if cuts:
        where = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(score) < c))
    df = df.withColumn("_range", where)
    sizes = df.groupBy("_range").agg(F.count("*").alias("_size"))
    ahead = sizes.select("_range", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(F.desc(score), tie_key(key), key))
    return df.withColumn("_own", own).join(ahead, "_range").withColumn("_rank", F.col("_own") + F.col("_ahead")).drop("_range", "_own", "_ahead")


def budgeted_routing(df: DataFrame, score: str, key: str, q: float) -> DataFrame:
    """_call: whether the expert is called, for the ceil(qN) rows of largest score; ties by the id's hash."""
    n = df.count()
    return ranked_calls(df, score, key).withColumn("_call", F.col("_rank") <= math.ceil(q * n))


def routing_curves(df: DataFrame, y: str, gate: str, expert: str, ok: str, scores: dict[str, str], key: str, budgets: list[float]) -> DataFrame:
    """Metrics of each policy and budget: gate where it isn't routed or the expert is invalid. scores: policy to score column."""
    n = df.count()
    out = None
    for policy, score in scores.items():
        ranked = ranked_calls(df, score, key)
        for q in budgets:
            routed = ranked.withColumn("_pred", F.when((F.col("_rank") <= math.ceil(q * n)) & F.col(ok), F.col(expert)).otherwise(F.col(gate)))
            row = M.thresholded(routed, y, "_pred").select(F.lit(policy).alias("policy"), F.lit(q).alias("q"), "tp", "fp", "fn", "tn", "accuracy", "f1", "mcc", "balanced_accuracy")
            out = row if out is None else out.unionByName(row)
    return out
