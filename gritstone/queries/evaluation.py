"""Confusion metrics, score statistics, sensitivity, agreement, repair and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.functions import metrics as M
from gritstone.operators import scores as S

from ._bind import REC, query, read, records, u, u_sql

_COUNTS = "count(*) FILTER (p >= 0 AND y = 1 AND p = 1) AS tp, count(*) FILTER (p >= 0 AND y = 0 AND p = 1) AS fp, count(*) FILTER (p >= 0 AND y = 1 AND p = 0) AS fn, count(*) FILTER (p >= 0 AND y = 0 AND p = 0) AS tn"
_MCC = "(tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0)"
_BA = "(COALESCE(tp::DOUBLE / nullif(tp + fn, 0), 0) + COALESCE(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2"
_F1 = "COALESCE(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"
_METRICS = f"(tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, {_F1} AS f1, {_MCC} AS mcc, {_BA} AS balanced_accuracy, (tp + fp)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS positive_rate"
_LONG = "long AS (SELECT id, dataset, grp, y, arm, p FROM (SELECT *, pred_a AS a, pred_b AS b, pred_c AS c FROM rec) UNPIVOT INCLUDE NULLS (p FOR arm IN (a, b, c)))"


def _r(df, *skip):
    """Doubles rounded to 9 digits, so that sums in any order agree."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query("metrics_by_lang", f"WITH {REC}, c AS (SELECT dataset, {_COUNTS} FROM (SELECT *, pred_a AS p FROM rec) GROUP BY dataset) SELECT dataset, tp, fp, fn, tn, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(mcc, 9) AS mcc, round(balanced_accuracy, 9) AS balanced_accuracy, round(positive_rate, 9) AS positive_rate FROM (SELECT dataset, tp, fp, fn, tn, {_METRICS} FROM c)")
def metrics_by_lang(spark, d):
    return _r(M.thresholded(records(spark, d), "y", "pred_a", "dataset"))


@query("confusion_counts", f"WITH {REC} SELECT {_COUNTS} FROM (SELECT *, pred_b AS p FROM rec)")
def confusion_counts(spark, d):
    return records(spark, d).agg(*[c.alias(k) for k, c in M.confusion("y", "pred_b").items()])


@query(
    "classification_report",
    f"""WITH {REC}, c AS (SELECT dataset, {_COUNTS}, count(*) AS total, count(*) FILTER (p IS NULL OR p = -1) AS invalid, avg(y) AS prevalence FROM (SELECT *, pred_a AS p FROM rec) GROUP BY dataset),
m AS (SELECT *, {_METRICS} FROM c)
SELECT dataset, tp, fp, fn, tn, total, invalid, round(prevalence, 4) AS prevalence, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision, round(recall, 4) AS recall, round(mcc, 4) AS mcc,
round(COALESCE(2.0::DOUBLE * precision * recall / nullif(precision + recall, 0), 0), 4) AS f1, round(invalid::DOUBLE / total, 4) AS invalid_rate, round(2.0::DOUBLE * prevalence / (1 + prevalence), 4) AS all1_f1 FROM m""",
)
def classification_report(spark, d):
    return M.report(records(spark, d), "y", "pred_a", "dataset")


@query("constant_baselines", f"WITH {REC}, p AS (SELECT dataset, avg(y) AS p FROM rec GROUP BY dataset) SELECT dataset, round(2 * p / (1 + p), 9) AS all1_f1, round(p, 9) AS all1_accuracy, 0.0::DOUBLE AS all0_f1, round(1 - p, 9) AS all0_accuracy, round(p, 9) AS random_f1, round(p * p + (1 - p) * (1 - p), 9) AS random_accuracy FROM p")
def constant_baselines(spark, d):
    return _r(records(spark, d).groupBy("dataset").agg(*[c.alias(k) for k, c in M.constant_baselines("y").items()]))


_AUROC = "SELECT dataset, round((sum(y * (r + (ties - 1) / 2.0::DOUBLE)) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0), 9) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY s) AS r, count(*) OVER (PARTITION BY dataset, s) AS ties FROM x) GROUP BY dataset"


@query("auroc_by_lang", f"WITH {REC}, x AS (SELECT dataset, y, round(s, 2) AS s FROM rec) {_AUROC}")
def auroc_by_lang(spark, d):
    return _r(S.auroc(records(spark, d).withColumn("s", F.round("s", 2)), "y", "s", ["dataset"]))


@query(
    "auprc_by_lang",
    f"""WITH {REC}, g AS (SELECT dataset, round(s, 2) AS s, sum(y) AS pos, count(*) AS n FROM rec GROUP BY 1, 2),
w AS (SELECT *, sum(pos) OVER o AS tp, sum(n) OVER o AS k FROM g WINDOW o AS (PARTITION BY dataset ORDER BY s DESC))
SELECT dataset, CASE WHEN sum(pos) BETWEEN 1 AND sum(n) - 1 THEN round(sum(pos * (tp / k::DOUBLE)) / sum(pos), 9) END AS auprc FROM w GROUP BY dataset""",
)
def auprc_by_lang(spark, d):
    return _r(S.auprc(records(spark, d).withColumn("s", F.round("s", 2)), "y", "s", ["dataset"]))


@query(
    "roc_points",
    f"""WITH {REC}, g AS (SELECT dataset, round(s, 2) AS threshold, sum(y) AS pos, count(*) AS n FROM rec GROUP BY 1, 2)
SELECT dataset, threshold, round(sum(pos) OVER o / sum(pos) OVER (PARTITION BY dataset)::DOUBLE, 9) AS tpr, round((sum(n) OVER o - sum(pos) OVER o) / (sum(n) OVER (PARTITION BY dataset) - sum(pos) OVER (PARTITION BY dataset))::DOUBLE, 9) AS fpr
FROM g WINDOW o AS (PARTITION BY dataset ORDER BY threshold DESC)""",
)
def roc_points(spark, d):
    return _r(S.roc_points(records(spark, d).withColumn("s", F.round("s", 2)), "y", "s", ["dataset"]))


_TAU = f"""grid AS (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS t),
tc AS (SELECT {{by}}t, count(*) FILTER (y = 1 AND s >= t - 1e-12) AS tp, count(*) FILTER (y = 0 AND s >= t - 1e-12) AS fp, count(*) FILTER (y = 1 AND s < t - 1e-12) AS fn, count(*) FILTER (y = 0 AND s < t - 1e-12) AS tn FROM {{src}}, grid GROUP BY {{by}}t),
tm AS (SELECT *, {_MCC} AS mcc FROM tc),
tb AS (SELECT *, max(mcc) OVER ({{part}}) AS best FROM tm),
tau AS (SELECT {{by}}CASE WHEN best IS NULL THEN 0.5 ELSE t END AS tau, mcc FROM tb WHERE best IS NULL OR mcc >= best - 1e-9 QUALIFY row_number() OVER ({{part}} ORDER BY round(abs(t - 0.5), 9), t) = 1)"""


@query("threshold_search", f"WITH {REC}, {_TAU.format(by='dataset, ', src='rec', part='PARTITION BY dataset')} SELECT dataset, tau, round(mcc, 9) AS mcc FROM tau")
def threshold_search(spark, d):
    return _r(S.threshold_search(records(spark, d), "y", "s", ["dataset"]))


@query(
    "locked_thresholds",
    f"WITH {REC}, v AS (SELECT grp, y, s FROM rec WHERE split = 'validation'), {_TAU.format(by='', src='v', part='')}, t AS (SELECT *, (s >= tau - 1e-12)::INT AS p FROM rec, tau WHERE split = 'test'), c AS (SELECT any_value(tau) AS tau, {_COUNTS} FROM t) SELECT tau, tp, fp, fn, tn, round({_MCC}, 9) AS mcc, round({_F1}, 9) AS f1 FROM c",
)
def locked_thresholds(spark, d):
    """The threshold is taken on validation alone, then applied to test."""
    rows = records(spark, d)
    tau = S.threshold_search(rows.filter("split = 'validation'"), "y", "s").select("tau")
    test = rows.filter("split = 'test'").crossJoin(F.broadcast(tau)).withColumn("p", (F.col("s") >= F.col("tau") - 1e-12).cast("int"))
    return _r(M.thresholded(test, "y", "p", "tau").select("tau", "tp", "fp", "fn", "tn", "mcc", "f1"))


@query(
    "mcnemar_counts",
    f"WITH {REC}, m AS (SELECT dataset, count(*) FILTER (pred_a = y AND pred_b <> y) AS b, count(*) FILTER (pred_a <> y AND pred_b = y) AS c FROM rec WHERE pred_a >= 0 AND pred_b >= 0 GROUP BY dataset) SELECT dataset, b, c, round(COALESCE(greatest(abs(b - c) - 1, 0)::DOUBLE ** 2 / nullif(b + c, 0), 0), 6) AS chi2 FROM m",
)
def mcnemar_counts(spark, d):
    rows = records(spark, d).groupBy("dataset").agg(*[c.alias(k) for k, c in S.mcnemar_counts("y", "pred_a", "pred_b").items()])
    return rows.select("dataset", "b", "c", F.round(S.mcnemar_chi2("b", "c"), 6).alias("chi2"))


@query(
    "mcnemar_stage",
    f"WITH {REC}, m AS (SELECT dataset, count(*) FILTER (pred_a <> y AND pred_b = y) AS b, count(*) FILTER (pred_a = y AND pred_b <> y) AS c FROM rec WHERE pred_a IS NOT NULL AND pred_b IS NOT NULL GROUP BY dataset) SELECT dataset, b, c, round(COALESCE(greatest(abs(b - c) - 1, 0)::DOUBLE ** 2 / nullif(b + c, 0), 0), 6) AS chi2, round(COALESCE(greatest(abs(b - c) - 1, 0)::DOUBLE ** 2 / nullif(b + c, 0), 0), 6) > 3.841 AS significant FROM m",
)
def mcnemar_stage(spark, d):
    """The variant that is always chi-squared, with b and c the other way round."""
    rows = records(spark, d).groupBy("dataset").agg(*[c.alias(k) for k, c in S.mcnemar_counts("y", "pred_b", "pred_a").items()])
    chi2 = F.round(S.mcnemar_chi2("b", "c"), 6)
    return rows.select("dataset", "b", "c", chi2.alias("chi2"), (chi2 > 3.841).alias("significant"))


@query("mcnemar_p")
def mcnemar_p(spark, d):
    """Exact or chi-squared p-values with Holm's adjustment over the datasets."""
    rows = records(spark, d).groupBy("dataset").agg(*[c.alias(k) for k, c in S.mcnemar_counts("y", "pred_a", "pred_b").items()])
    return S.holm(rows.withColumn("p", S.mcnemar_p("b", "c")), "p", key="dataset")


@query(
    "holm_adjusted",
    f"WITH {REC}, p AS (SELECT grp, round(avg(p_gate) / 10, 9) AS p FROM rec GROUP BY grp), r AS (SELECT *, row_number() OVER (ORDER BY p, grp) AS r, count(*) OVER () AS m FROM p) SELECT grp, p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)), 9) AS p_holm FROM r",
)
def holm_adjusted(spark, d):
    rows = records(spark, d).groupBy("grp").agg(F.round(F.avg("p_gate") / 10, 9).alias("p"))
    return S.holm(rows, "p", key="grp").withColumn("p_holm", F.round("p_holm", 9))


@query(
    "effect_verdicts",
    f"WITH {REC}, e AS (SELECT grp, round(avg(s) - 0.5, 9) AS delta FROM rec GROUP BY grp), b AS (SELECT grp, delta, delta - 0.1 AS lo, delta + 0.1 AS hi FROM e) SELECT grp, delta, CASE WHEN lo > 0 AND delta >= 0.02 THEN 'benefit' WHEN hi < 0 THEN 'harm' WHEN hi < 0.02 THEN 'no_meaningful_benefit' ELSE 'inconclusive' END AS verdict FROM b",
)
def effect_verdicts(spark, d):
    rows = records(spark, d).groupBy("grp").agg(F.round(F.avg("s") - 0.5, 9).alias("delta"))
    return rows.select("grp", "delta", M.verdict("delta", F.col("delta") - 0.1, F.col("delta") + 0.1, F.lit(0.02)).alias("verdict"))


@query(
    "label_sensitivity",
    f"WITH {REC}, v AS (SELECT * FROM rec WHERE pred_a IS NOT NULL AND pred_b IS NOT NULL AND pred_c IS NOT NULL) SELECT dataset, round(avg((pred_a <> pred_b)::INT), 9) AS flip, round(avg((pred_a <> pred_c)::INT), 9) AS natural, round(avg((pred_a <> pred_b)::INT) - avg((pred_a <> pred_c)::INT), 9) AS net, round(avg((pred_a = y AND pred_b <> y)::INT), 9) AS correct_to_wrong, round(avg((pred_a <> y AND pred_b = y)::INT), 9) AS wrong_to_correct FROM v GROUP BY dataset",
)
def label_sensitivity(spark, d):
    rows = records(spark, d).filter(M.valid("pred_a") & M.valid("pred_b") & M.valid("pred_c"))
    return _r(rows.groupBy("dataset").agg(*[c.alias(k) for k, c in M.label_sensitivity("pred_a", "pred_b", "pred_c", "y").items()]))


@query(
    "label_flip_statistics",
    f"""WITH {REC}, v AS (SELECT *, pred_a <> pred_b AS f, pred_a <> pred_c AS n FROM rec WHERE pred_a IS NOT NULL AND pred_b IS NOT NULL AND pred_c IS NOT NULL)
SELECT z AS demo_label, count(*) AS n, count(*) FILTER (f) AS flips, count(*) FILTER (n) AS natural_variance, round((count(*) FILTER (f) - count(*) FILTER (n))::DOUBLE / count(*), 6) AS net_rate,
count(*) FILTER (f AND n) AS flip_and_varied, count(*) FILTER (f AND NOT n) AS flip_only, count(*) FILTER (NOT f AND n) AS varied_only, count(*) FILTER (NOT f AND NOT n) AS stable FROM v GROUP BY z""",
)
def label_flip_statistics(spark, d):
    rows = records(spark, d).filter(M.valid("pred_a") & M.valid("pred_b") & M.valid("pred_c"))
    f, n = F.col("pred_a") != F.col("pred_b"), F.col("pred_a") != F.col("pred_c")
    c = M.count_where
    return rows.groupBy(F.col("z").alias("demo_label")).agg(
        F.count("*").alias("n"), c(f).alias("flips"), c(n).alias("natural_variance"), F.round((c(f) - c(n)).cast("double") / F.count("*"), 6).alias("net_rate"),
        c(f & n).alias("flip_and_varied"), c(f & ~n).alias("flip_only"), c(~f & n).alias("varied_only"), c(~f & ~n).alias("stable"),
    )


@query(
    "rater_kappa",
    f"""WITH {REC}, g AS (SELECT dataset, count(*) AS n, avg((y = z)::INT) AS po, avg(y) AS py, avg(z) AS pz FROM rec GROUP BY dataset), k AS (SELECT dataset, n, po, py * pz + (1 - py) * (1 - pz) AS pe FROM g)
SELECT dataset, n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa, CASE WHEN (po - pe) / (1 - pe) < 0 THEN 'Poor' WHEN (po - pe) / (1 - pe) <= 0.2 THEN 'Slight' WHEN (po - pe) / (1 - pe) <= 0.4 THEN 'Fair' WHEN (po - pe) / (1 - pe) <= 0.6 THEN 'Moderate' WHEN (po - pe) / (1 - pe) <= 0.8 THEN 'Substantial' ELSE 'Almost Perfect' END AS band FROM k""",
)
def rater_kappa(spark, d):
    y, z = F.avg("y"), F.avg("z")
    rows = records(spark, d).groupBy("dataset").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("z")).cast("int")).alias("po"), (y * z + (1 - y) * (1 - z)).alias("pe"))
    return _r(rows.withColumn("kappa", M.kappa("po", "pe")).withColumn("band", M.kappa_band("kappa")))


_CATS = ("A", "B", "Equal", "Neither")


def _cat(arm):
    return F.element_at(F.array(*[F.lit(c) for c in _CATS]), F.floor(u("id", arm) * 4).cast("int") + 1)


def _cat_sql(arm):
    return f"(['A', 'B', 'Equal', 'Neither'])[floor({u_sql('id', arm)} * 4)::INT + 1]"


@query("contingency_4x4", f"WITH {REC}, r AS (SELECT {_cat_sql('r1')} AS r1, {_cat_sql('r2')} AS r2 FROM rec), c AS (SELECT unnest(['A', 'B', 'Equal', 'Neither']) AS r1) SELECT c.r1, count(*) FILTER (r2 = 'A') AS A, count(*) FILTER (r2 = 'B') AS B, count(*) FILTER (r2 = 'Equal') AS \"Equal\", count(*) FILTER (r2 = 'Neither') AS \"Neither\" FROM c LEFT JOIN r USING (r1) GROUP BY c.r1")
def contingency_4x4(spark, d):
    """Fixed categories in order; empty cells are 0."""
    rows = records(spark, d).select(_cat("r1").alias("r1"), _cat("r2").alias("r2"))
    cats = spark.createDataFrame([(c,) for c in _CATS], "r1 string")
    return cats.join(rows.groupBy("r1").pivot("r2", list(_CATS)).count(), "r1", "left").fillna(0)


@query(
    "multiclass_kappa",
    f"WITH {REC}, r AS (SELECT {_cat_sql('r1')} AS r1, {_cat_sql('r2')} AS r2 FROM rec), n AS (SELECT count(*)::DOUBLE AS n, avg((r1 = r2)::INT) AS po FROM r), e AS (SELECT sum(a.k * b.k) AS e FROM (SELECT r1 AS c, count(*) AS k FROM r GROUP BY 1) a JOIN (SELECT r2 AS c, count(*) AS k FROM r GROUP BY 1) b USING (c)) SELECT round(po, 9) AS po, round(e / (n * n), 9) AS pe, round((po - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM n, e",
)
def multiclass_kappa(spark, d):
    rows = records(spark, d).select(_cat("r1").alias("r1"), _cat("r2").alias("r2"))
    pair = rows.groupBy("r1", "r2").count()
    total = pair.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("r1") == F.col("r2"), F.col("count")).otherwise(0)).alias("same"))
    a = pair.groupBy(F.col("r1").alias("c")).agg(F.sum("count").alias("k1"))
    b = pair.groupBy(F.col("r2").alias("c")).agg(F.sum("count").alias("k2"))
    chance = a.join(b, "c").agg(F.sum(F.col("k1") * F.col("k2")).alias("e"))
    out = total.crossJoin(chance).select((F.col("same") / F.col("n")).alias("po"), (F.col("e") / (F.col("n") * F.col("n")).cast("double")).alias("pe"))
    return _r(out.withColumn("kappa", M.kappa("po", "pe")))


@query(
    "preference_rates",
    f"WITH {REC}, r AS (SELECT {_cat_sql('r1')} AS r1, {_cat_sql('r2')} AS r2 FROM rec) SELECT c AS choice, round(avg((r1 = c)::INT), 9) AS rate_1, round(avg((r2 = c)::INT), 9) AS rate_2, round((avg((r1 = c)::INT) + avg((r2 = c)::INT)) / 2, 9) AS mean_rate, count(*) FILTER (r1 = c AND r2 = c) AS concordant FROM r, (SELECT unnest(['A', 'B', 'Equal', 'Neither']) AS c) GROUP BY c",
)
def preference_rates(spark, d):
    rows = records(spark, d).select(_cat("r1").alias("r1"), _cat("r2").alias("r2")).groupBy("r1", "r2").count()
    share = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0)) / F.sum("count").cast("double")
    cats = F.broadcast(spark.createDataFrame([(c,) for c in _CATS], "choice string"))
    c = F.col("choice")
    out = rows.crossJoin(cats).groupBy("choice").agg(share(F.col("r1") == c).alias("rate_1"), share(F.col("r2") == c).alias("rate_2"), F.sum(F.when((F.col("r1") == c) & (F.col("r2") == c), F.col("count")).otherwise(0)).alias("concordant"))
    return _r(out.withColumn("mean_rate", (F.col("rate_1") + F.col("rate_2")) / 2))


_RH = "count(*) AS n, count(*) FILTER (ok AND g <> y AND h = y) AS repair, count(*) FILTER (ok AND g = y AND h <> y) AS harm, count(*) FILTER (ok AND g = y AND h = y) AS both_right, count(*) FILTER (ok AND g <> y AND h <> y) AS both_wrong, count(*) FILTER (NOT ok) AS invalid"
_GH = "gh AS (SELECT *, (p_gate >= 0.5)::INT AS g, (s >= 0.5)::INT AS h, valid AS ok FROM rec)"


def _gate(spark, d):
    return records(spark, d).withColumn("g", (F.col("p_gate") >= 0.5).cast("int")).withColumn("h", (F.col("s") >= 0.5).cast("int"))


@query("repair_harm", f"WITH {REC}, {_GH} SELECT COALESCE(y::VARCHAR, 'all') AS class, {_RH} FROM gh GROUP BY ROLLUP (y)")
def repair_harm(spark, d):
    rows = _gate(spark, d).rollup("y").agg(*[c.alias(k) for k, c in M.repair_harm("y", "g", "h", "valid").items()])
    return rows.select(F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("class"), "n", "repair", "harm", "both_right", "both_wrong", "invalid")


@query("oracle_ceiling", f"WITH {REC}, {_GH} SELECT dataset, round(avg((g = y OR (ok AND h = y))::INT), 9) AS oracle_accuracy, round(avg((g = y)::INT), 9) AS gate_accuracy, round(avg((h = y)::INT) FILTER (ok), 9) AS expert_accuracy_valid FROM gh GROUP BY dataset")
def oracle_ceiling(spark, d):
    return _r(_gate(spark, d).groupBy("dataset").agg(*[c.alias(k) for k, c in M.oracle_ceiling("y", "g", "h", "valid").items()]))


_KEY = "('0x' || substr(sha256(id::VARCHAR), 1, 8))::BIGINT"


@query("routing_budget", f"WITH {REC}, {_GH}, r AS (SELECT *, row_number() OVER (ORDER BY s DESC, {_KEY}, id) AS rank, count(*) OVER () AS n FROM gh) SELECT id, rank, rank <= ceil(0.1::DOUBLE * n) AS called, CASE WHEN rank <= ceil(0.1::DOUBLE * n) AND ok THEN h ELSE g END AS routed FROM r")
def routing_budget(spark, d):
    rows = S.budgeted_routing(_gate(spark, d), "s", "id", 0.1)
    routed = F.when(F.col("_call") & F.col("valid"), F.col("h")).otherwise(F.col("g"))
    return rows.select("id", F.col("_rank").alias("rank"), F.col("_call").alias("called"), routed.alias("routed"))


_POL = {"confidence": "-abs(ln(greatest(least(p_gate, 1 - 1e-6), 1e-6) / (1 - greatest(least(p_gate, 1 - 1e-6), 1e-6))))", "benefit": "s - p_gate", "full_expert": "1.0::DOUBLE", "oracle": "((g <> y) AND (h = y) AND ok)::INT::DOUBLE"}
_CURVES = " UNION ALL ".join(
    f"SELECT '{name}' AS policy, q, {_COUNTS} FROM (SELECT y, q, CASE WHEN rank <= ceil(q * n) AND ok THEN h ELSE g END AS p FROM (SELECT *, row_number() OVER (ORDER BY {x} DESC, {_KEY}, id) AS rank, count(*) OVER () AS n FROM gh), (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE]) AS q)) GROUP BY q" for name, x in _POL.items()
)


@query("routing_curves", f"WITH {REC}, {_GH}, c AS ({_CURVES}) SELECT policy, q, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy, round({_F1}, 9) AS f1, round({_MCC}, 9) AS mcc, round({_BA}, 9) AS balanced_accuracy FROM c")
def routing_curves(spark, d):
    rows = _gate(spark, d).withColumns(
        {
            "r_confidence": -F.abs(M.logit("p_gate")),
            "r_benefit": F.col("s") - F.col("p_gate"),
            "r_full": F.lit(1.0),
            "r_oracle": ((F.col("g") != F.col("y")) & (F.col("h") == F.col("y")) & F.col("valid")).cast("double"),
        }
    ).cache()
    return _r(S.routing_curves(rows, "y", "g", "h", "valid", {"confidence": "r_confidence", "benefit": "r_benefit", "full_expert": "r_full", "oracle": "r_oracle"}, "id", [0.05, 0.1, 0.25]), "q")


@query("routing_orders_large", f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT, o_orderkey) AS rank, count(*) OVER () AS n FROM orders) SELECT o_orderkey, rank FROM r WHERE rank <= ceil(0.1::DOUBLE * n)")
def routing_orders_large(spark, d):
    rows = S.budgeted_routing(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 0.1)
    return rows.filter("_call").select("o_orderkey", F.col("_rank").alias("rank"))


@query("expert_features", f"WITH {REC} SELECT id, round(ln(greatest(least(p_gate, 1 - 1e-6), 1e-6) / (1 - greatest(least(p_gate, 1 - 1e-6), 1e-6))), 9) AS logit, CASE WHEN valid THEN s ELSE 0.5 END AS s, valid::INT AS ok, round(CASE WHEN valid THEN s ELSE 0.5 END * p_gate, 9) AS sp, round(CASE WHEN valid THEN s ELSE 0.5 END - p_gate, 9) AS diff FROM rec")
def expert_features(spark, d):
    s = F.when(F.col("valid"), F.col("s")).otherwise(F.lit(0.5))
    return records(spark, d).select("id", F.round(M.logit("p_gate"), 9).alias("logit"), s.alias("s"), F.col("valid").cast("int").alias("ok"), F.round(s * F.col("p_gate"), 9).alias("sp"), F.round(s - F.col("p_gate"), 9).alias("diff"))


@query(
    "arm_table",
    f"""WITH {REC}, a AS (SELECT id, dataset, split, y, arm, s FROM (SELECT id, dataset, split, y, 'gate' AS arm, p_gate AS s FROM rec UNION ALL SELECT id, dataset, split, y, 'expert', s FROM rec)),
v AS (SELECT dataset || '|' || arm AS k, y, s FROM a WHERE split <> 'test'), {_TAU.format(by="k, ", src="v", part="PARTITION BY k")},
t AS (SELECT a.dataset, a.arm, y, (s >= tau - 1e-12)::INT AS p, tau FROM a JOIN tau ON k = dataset || '|' || arm WHERE split = 'test'), c AS (SELECT dataset, arm, tau, {_COUNTS} FROM t GROUP BY ALL)
SELECT dataset, arm, tau, tp, fp, fn, tn, round({_MCC}, 9) AS mcc, round({_BA}, 9) AS balanced_accuracy FROM c""",
)
def arm_table(spark, d):
    """Per dataset and arm: threshold from the rows that aren't test, metrics on test."""
    rec = records(spark, d)
    arms = rec.select("id", "dataset", "split", "y", F.lit("gate").alias("arm"), F.col("p_gate").alias("s")).unionByName(rec.select("id", "dataset", "split", "y", F.lit("expert").alias("arm"), "s"))
    tau = S.threshold_search(arms.filter("split <> 'test'"), "y", "s", ["dataset", "arm"]).select("dataset", "arm", "tau")
    test = arms.filter("split = 'test'").join(tau, ["dataset", "arm"]).withColumn("p", (F.col("s") >= F.col("tau") - 1e-12).cast("int"))
    return _r(M.thresholded(test, "y", "p", "dataset", "arm", "tau").select("dataset", "arm", "tau", "tp", "fp", "fn", "tn", "mcc", "balanced_accuracy"))


@query("run_coverage", f"WITH {REC}, {_LONG} SELECT dataset, arm, count(*) AS total, count(p) AS valid, count(*) - count(p) AS invalid, round((count(*) - count(p))::DOUBLE / count(*), 6) AS invalid_rate, count(*) >= 50 AND count(*) = count(p) AS success FROM long GROUP BY dataset, arm")
def run_coverage(spark, d):
    long = records(spark, d).select("dataset", F.col("pred_a").alias("a"), F.col("pred_b").alias("b"), F.col("pred_c").alias("c")).unpivot("dataset", ["a", "b", "c"], "arm", "p")
    n, k = F.count("*"), F.count("p")
    return long.groupBy("dataset", "arm").agg(n.alias("total"), k.alias("valid"), (n - k).alias("invalid"), F.round((n - k).cast("double") / n, 6).alias("invalid_rate"), ((n >= 50) & (n == k)).alias("success"))


@query("strict_denominator_metrics", f"WITH {REC} SELECT dataset, round(count(*) FILTER (pred_a = y)::DOUBLE / count(*), 9) AS accuracy, round(count(*) FILTER (pred_a = 1 AND y = 1)::DOUBLE / nullif(count(*) FILTER (pred_a = 1), 0), 9) AS precision, count(*) FILTER (COALESCE(pred_a, 2) = 2) AS coded_2 FROM rec GROUP BY dataset")
def strict_denominator_metrics(spark, d):
    """Anything but 0 or 1 is coded 2 and counts in the denominator only."""
    p = F.coalesce("pred_a", F.lit(2))
    c = M.count_where
    rows = records(spark, d).groupBy("dataset").agg((c(p == F.col("y")).cast("double") / F.count("*")).alias("accuracy"), F.try_divide(c((p == 1) & (F.col("y") == 1)).cast("double"), c(p == 1)).alias("precision"), c(p == 2).alias("coded_2"))
    return _r(rows)


@query("bootstrap_unit", f"WITH {REC} SELECT dataset, count(DISTINCT grp) AS groups, CASE WHEN count(DISTINCT grp) < 10 THEN 'sample' ELSE 'cluster' END AS unit FROM rec GROUP BY dataset")
def bootstrap_unit(spark, d):
    n = F.countDistinct("grp")
    return records(spark, d).groupBy("dataset").agg(n.alias("groups"), F.when(n < 10, "sample").otherwise("cluster").alias("unit"))


@query("reparse_changes", f"WITH {REC} SELECT CASE WHEN pred_b IS NULL THEN CASE WHEN pred_a IS NULL THEN 'invalid_both' ELSE pred_a::VARCHAR || '->invalid' END WHEN pred_a IS NULL THEN 'invalid->' || pred_b::VARCHAR ELSE pred_a::VARCHAR || '->' || pred_b::VARCHAR END AS change, y, count(*) AS n FROM rec GROUP BY 1, 2")
def reparse_changes(spark, d):
    a, b = (F.coalesce(F.col(c).cast("string"), F.lit("invalid")) for c in ("pred_a", "pred_b"))
    change = F.when(F.col("pred_a").isNull() & F.col("pred_b").isNull(), "invalid_both").otherwise(F.concat(a, F.lit("->"), b))
    return records(spark, d).groupBy(change.alias("change"), "y").agg(F.count("*").alias("n"))


@query("agreement_with_thresholded_gate", f"WITH {REC}, g AS (SELECT dataset, (p_gate >= 0.36)::INT AS g, pred_a FROM rec) SELECT dataset, count(*) AS n, round(avg((g = pred_a)::INT), 9) AS agreement FROM g GROUP BY dataset")
def agreement_with_thresholded_gate(spark, d):
    same = ((F.col("p_gate") >= 0.36).cast("int") == F.col("pred_a")).cast("int")
    return _r(records(spark, d).groupBy("dataset").agg(F.count("*").alias("n"), F.avg(same).alias("agreement")))

