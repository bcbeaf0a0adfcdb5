import math

import pytest
from pyspark.sql import functions as F

from gritstone.functions import metrics as M
from gritstone.operators import resample
from gritstone.operators import scores as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_constant_predictor_has_no_mcc(spark):
    row = M.thresholded(frame(spark, [(1, 1), (0, 1), (1, 1)], "y int, p int"), "y", "p").first()
    assert row.mcc is None and row.tp == 2 and row.fp == 1 and row.balanced_accuracy == 0.5


def test_invalid_predictions_leave_metrics_but_stay_in_the_report(spark):
    row = M.report(frame(spark, [(1, 1), (0, None), (1, -1), (0, 0)], "y int, p int"), "y", "p").first()
    assert row.total == 4 and row.invalid == 2 and row.invalid_rate == 0.5 and row.accuracy == 1.0


def test_kappa_of_a_4x4_matrix(spark):
    counts = [[12, 3, 2, 0], [2, 3, 3, 0], [1, 1, 4, 0], [4, 7, 3, 5]]
    rows = [(i, j, c) for i, r in enumerate(counts) for j, c in enumerate(r)]
    n = sum(c for *_, c in rows)
    po = sum(counts[i][i] for i in range(4)) / n
    pe = sum(sum(counts[i]) * sum(r[i] for r in counts) for i in range(4)) / n**2
    k = frame(spark, [(po, pe)], "po double, pe double").select(M.kappa("po", "pe").alias("k")).withColumn("b", M.kappa_band("k")).first()
    assert (round(po, 2), round(pe, 4), round(k.k, 4), k.b) == (0.48, 0.2408, 0.3151, "Fair")
    total = frame(spark, [(1.0, 1.0)], "po double, pe double")
    assert total.select(M.kappa("po", "pe")).first()[0] == 1.0 and total.select(M.kappa("po", "pe", None)).first()[0] is None


def test_mcnemar_exact_and_holm(spark):
    rows = [(1, 1, 0)] * 10 + [(1, 1, 1)] * 90
    c = frame(spark, rows, "y int, a int, b int").agg(*[x.alias(k) for k, x in S.mcnemar_counts("y", "a", "b").items()])
    p = c.select("b", "c", S.mcnemar_p("b", "c").alias("p")).first()
    assert (p.b, p.c) == (10, 0) and p.p == pytest.approx(2 / 1024)
    adjusted = {r.k: r.p_holm for r in S.holm(frame(spark, [("a", 0.01), ("b", 0.04), ("c", 0.2)], "k string, p double"), "p").collect()}
    assert adjusted["a"] == pytest.approx(0.03) and adjusted["b"] == pytest.approx(0.08) and adjusted["c"] == pytest.approx(0.2)
    none = frame(spark, [(0, 0), (40, 10)], "b long, c long").select(S.mcnemar_p("b", "c")).collect()
    assert none[0][0] == 1.0 and none[1][0] == pytest.approx(math.erfc(math.sqrt(29**2 / 50 / 2)))


def test_sensitivity_vectors(spark):
    rows = list(zip([1, 0, 1, 0, 1], [1, 0, 1, 0, 1], [0, 1, 1, 0, 1], [1, 0, 1, 0, 1]))
    r = frame(spark, rows, "y int, base int, flip int, repeat int").agg(*[c.alias(k) for k, c in M.label_sensitivity("base", "flip", "repeat", "y").items()]).first()
    assert (r.flip, r.natural, r.net) == (0.4, 0.0, 0.4)


def test_auroc_ties_and_single_class(spark):
    rows = [("x", 0, 0.1), ("x", 1, 0.1), ("x", 1, 0.9), ("x", 0, 0.0), ("one", 1, 0.3)]
    got = {r.g: r.auroc for r in S.auroc(frame(spark, rows, "g string, y int, s double"), "y", "s", ["g"]).collect()}
    assert got["x"] == pytest.approx(3.5 / 4) and got["one"] is None
    assert {r.g: r.auprc for r in S.auprc(frame(spark, rows, "g string, y int, s double"), "y", "s", ["g"]).collect()}["one"] is None


def test_threshold_prefers_the_middle_and_the_undefined_case(spark):
    r = S.threshold_search(frame(spark, [(0, 0.1), (1, 0.95)], "y int, s double"), "y", "s").first()
    assert r.tau == 0.5 and r.mcc == pytest.approx(1.0)
    r = S.threshold_search(frame(spark, [(1, 0.1), (1, 0.9)], "y int, s double"), "y", "s").first()
    assert r.tau == 0.5 and r.mcc is None


def test_verdict_order(spark):
    rows = [(0.05, 0.01, 0.1), (0.01, 0.001, 0.015), (-0.1, -0.2, -0.01), (0.05, -0.1, 0.2), (float("nan"), 0.0, 0.0)]
    got = [r[0] for r in frame(spark, rows, "d double, lo double, hi double").select(M.verdict("d", "lo", "hi", F.lit(0.02))).collect()]
    assert got == ["benefit", "no_meaningful_benefit", "harm", "inconclusive", "inconclusive"]


def test_repair_harm_partitions_all_rows(spark):
    rows = [(i % 2, (i // 2) % 2, (i // 4) % 2, i % 5 != 0) for i in range(100)]
    r = frame(spark, rows, "y int, g int, h int, ok boolean").agg(*[c.alias(k) for k, c in M.repair_harm("y", "g", "h", "ok").items()]).first()
    assert r.repair + r.harm + r.both_right + r.both_wrong + r.invalid == r.n == 100


def test_routing_rank_is_a_total_order(spark):
    rows = S.ranked_calls(spark.range(500).withColumn("s", F.floor(F.col("id") / 7) / 10.0), "s", "id").orderBy("_rank").collect()
    assert [r._rank for r in rows] == list(range(1, 501)) and all(a.s >= b.s for a, b in zip(rows, rows[1:]))


def test_bootstrap_of_equal_and_better_arms(spark):
    df = spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("good"), F.when(F.col("id") % 3 == 0, 1 - F.col("id") % 2).otherwise(F.col("id") % 2).cast("int").alias("bad"))
    same = resample.paired_bootstrap(df, "y", "good", "good", "id", "mcc", 200).first()
    assert (same.delta, same.lo, same.hi) == (0.0, 0.0, 0.0)
    better = resample.paired_bootstrap(df, "y", "bad", "good", "id", "mcc", 200).first()
    assert better.lo > 0 and better.lo < better.delta < better.hi and better.n_degenerate == 0
