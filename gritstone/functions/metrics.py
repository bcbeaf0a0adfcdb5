"""Confusion-based metrics as aggregate Columns. Labels and predictions are 0/1; an invalid prediction is NULL or -1.

Undefined values are NULL, never 0, except where a function says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def valid(pred) -> Column:
    return _c(pred).isNotNull() & (_c(pred) != -1)


def confusion(y, pred) -> dict[str, Column]:
    """Counts over rows with a valid prediction."""
    y, pred = _c(y), _c(pred)
    ok = valid(pred)
    return {
        "tp": count_where(ok & (y == 1) & (pred == 1)),
        "fp": count_where(ok & (y == 0) & (pred == 1)),
        "fn": count_where(ok & (y == 1) & (pred == 0)),
        "tn": count_where(ok & (y == 0) & (pred == 0)),
    }


def _d(x: Column) -> Column:
    return x.cast("double")


def mcc(tp, fp, fn, tn) -> Column:
    tp, fp, fn, tn = (_d(_c(x)) for x in (tp, fp, fn, tn))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.try_divide(tp * tn - fp * fn, under)


def f1(tp, fp, fn) -> Column:
    """0 where nothing is positive in either."""
    tp, fp, fn = (_d(_c(x)) for x in (tp, fp, fn))
    return F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), F.lit(0.0))


def balanced_accuracy(tp, fp, fn, tn) -> Column:
    """The rate of a missing class counts as 0."""
    tp, fp, fn, tn = (_d(_c(x)) for x in (tp, fp, fn, tn))
    return (F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)) + F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0))) / F.lit(2.0)


def from_counts(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, Column]:
    """Unrounded metrics from the four counts."""
    a, b, c, d = (_d(_c(x)) for x in (tp, fp, fn, tn))
    n = a + b + c + d
    return {
        "accuracy": F.try_divide(a + d, n),
        "precision": F.try_divide(a, a + b),
        "recall": F.try_divide(a, a + c),
        "f1": f1(tp, fp, fn),
        "mcc": mcc(tp, fp, fn, tn),
        "balanced_accuracy": balanced_accuracy(tp, fp, fn, tn),
        "positive_rate": F.try_divide(a + b, n),
    }


def thresholded(df, y, pred, *by):
    """Counts and metrics of each group."""
    counts = [c.alias(k) for k, c in confusion(y, pred).items()]
    out = (df.groupBy(*by) if by else df).agg(*counts)
    return out.withColumns(from_counts())


def constant_baselines(y) -> dict[str, Column]:
    """ALL-1, ALL-0 and random-at-prevalence accuracy and F1."""
    p = F.avg(_d(_c(y)))
    return {
        "all1_f1": F.lit(2.0) * p / (F.lit(1.0) + p),
        "all1_accuracy": p,
        "all0_f1": p * F.lit(0.0),
        "all0_accuracy": F.lit(1.0) - p,
        "random_f1": p,
        "random_accuracy": p * p + (F.lit(1.0) - p) * (F.lit(1.0) - p),
    }


def report(df, y, pred, *by, digits: int = 4):
    """Rounded report: invalid rows leave the metrics but stay in total and invalid_rate; f1 is 0 if P or R is undefined."""
    total, bad = F.count("*"), count_where(~F.coalesce(valid(pred), F.lit(False)))
    p = F.avg(_d(_c(y)))
    out = (df.groupBy(*by) if by else df).agg(*[c.alias(k) for k, c in confusion(y, pred).items()], total.alias("total"), bad.alias("invalid"), p.alias("prevalence"))
    m = from_counts()
    f = F.coalesce(F.try_divide(F.lit(2.0) * m["precision"] * m["recall"], m["precision"] + m["recall"]), F.lit(0.0))
    rounded = {k: F.round(m[k], digits) for k in ("accuracy", "precision", "recall", "mcc")}
    return out.withColumns(
        rounded
        | {
            "f1": F.round(f, digits),
            "invalid_rate": F.round(_d(F.col("invalid")) / F.col("total"), digits),
            "all1_f1": F.round(F.lit(2.0) * F.col("prevalence") / (F.lit(1.0) + F.col("prevalence")), digits),
            "prevalence": F.round("prevalence", digits),
        }
    )


def verdict(delta, lo, hi, margin) -> Column:
    """Effect verdict of a paired difference; the order of the cases matters."""
    delta, lo, hi, margin = (_c(x) for x in (delta, lo, hi, margin))
    bad = delta.isNull() | lo.isNull() | hi.isNull() | F.isnan(delta) | F.isnan(lo) | F.isnan(hi)
    return (
        F.when(bad, "inconclusive")
        .when((lo > 0) & (delta >= margin), "benefit")
        .when(hi < 0, "harm")
        .when(hi < margin, "no_meaningful_benefit")
        .otherwise("inconclusive")
    )


def label_sensitivity(base, flip, repeat, y) -> dict[str, Column]:
    """Rates over rows valid in all three arms (filter first)."""
    base, flip, repeat, y = (_c(x) for x in (base, flip, repeat, y))
    rate = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    flips, natural = rate(base != flip), rate(base != repeat)
    return {
        "flip": flips,
        "natural": natural,
        "net": flips - natural,
        "correct_to_wrong": rate((base == y) & (flip != y)),
        "wrong_to_correct": rate((base != y) & (flip == y)),
    }


def kappa(po, pe, degenerate: float | None = 1.0) -> Column:
    """Cohen's kappa; what it is when chance agreement is total is the caller's: 1 or NULL."""
    po, pe = _c(po), _c(pe)
    return F.when(pe >= 1, F.lit(degenerate).cast("double")).otherwise(F.try_divide(po - pe, F.lit(1.0) - pe))


def kappa_band(k) -> Column:
    """Landis and Koch bands."""
    k = _c(k)
    return (
        F.when(k.isNull(), "Undefined")
        .when(k < 0, "Poor")
        .when(k <= 0.20, "Slight")
        .when(k <= 0.40, "Fair")
        .when(k <= 0.60, "Moderate")
        .when(k <= 0.80, "Substantial")
        .otherwise("Almost Perfect")
    )


def repair_harm(y, gate, expert, ok) -> dict[str, Column]:
    """Repair, harm, both right, both wrong, and rows whose expert is invalid."""
    y, g, h, ok = (_c(x) for x in (y, gate, expert, ok))
    # gate is the base decision h; the expert's prediction replaces it
    return {
        "n": F.count("*"),
        "repair": count_where(ok & (g != y) & (h == y)),
        "harm": count_where(ok & (g == y) & (h != y)),
        "both_right": count_where(ok & (g == y) & (h == y)),
        "both_wrong": count_where(ok & (g != y) & (h != y)),
        "invalid": count_where(~ok),
    }


def oracle_ceiling(y, gate, expert, ok) -> dict[str, Column]:
    y, g, h, ok = (_c(x) for x in (y, gate, expert, ok))
    return {
        "oracle_accuracy": F.avg(F.when((g == y) | (ok & (h == y)), 1.0).otherwise(0.0)),
        "gate_accuracy": F.avg(F.when(g == y, 1.0).otherwise(0.0)),
        "expert_accuracy_valid": F.avg(F.when(ok, F.when(h == y, 1.0).otherwise(0.0))),
    }


def logit(p, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return F.ln(p / (F.lit(1.0) - p))
