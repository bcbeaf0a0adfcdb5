"""Paired and clustered bootstrap by replicate weights.

Every replicate gives each unit (a row, or a cluster of rows) a Poisson(1) multiplicity drawn from a hash of unit and
replicate: no random stream, the same for any partitioning, one pass. Rows of a unit are summed into its confusion
cells first; each Arrow batch of units multiplies its cells by the weights of all replicates, a matrix product, and gives
a row per replicate, whatever its size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import metrics as M

METRICS = ("mcc", "f1", "balanced_accuracy", "accuracy", "positive_rate")
#: Units whose weights are held at once.
UNITS = 512


def poisson_weights(units: np.ndarray, replicates: int) -> np.ndarray:
    """(units, replicates): Poisson(1) by inversion of a uniform hashed from a unit's 64-bit key and the replicate."""
    x = units.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    cumulative = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cumulative, (x >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")


def _cells(y: str, pred: str, name: str) -> list[Column]:
    return [c.alias(f"{k}_{name}") for k, c in M.confusion(y, pred).items()]


def paired_bootstrap(df: DataFrame, y: str, a: str, b: str, unit: str, metric: str = "mcc", replicates: int = 5000, by: list[str] | None = None, undefined: float | None = None) -> DataFrame:
    """delta (b - a on all rows), lo, hi (2.5 and 97.5 percent by linear interpolation), n_boot, n_degenerate.

    Rows count if both arms are valid. A replicate whose metric is undefined is degenerate and left out, or counts as
    ``undefined`` where that is given.
    """
    by = by or []
    df = df.filter(M.valid(a) & M.valid(b))
    units = df.groupBy(*by, F.col(unit).alias("_unit")).agg(*_cells(y, a, "a"), *_cells(y, b, "b"))
    cells = [f"{k}_{n}" for n in "ab" for k in ("tp", "fp", "fn", "tn")]

    def delta(rows: DataFrame) -> Column:
        of = lambda n: M.from_counts(*[f"{k}_{n}" for k in ("tp", "fp", "fn", "tn")])[metric]
        x, z = of("a"), of("b")
        return F.coalesce(z, F.lit(undefined).cast("double")) - F.coalesce(x, F.lit(undefined).cast("double"))

    full = (units.groupBy(*by) if by else units).agg(*[F.sum(c).alias(c) for c in cells])
    full = full.select(*by, delta(full).alias("delta"))
    key = F.xxhash64(F.lit("boot"), F.coalesce(F.col("_unit").cast("string"), F.lit("\x00")))
    rows = units.select(*by, (F.xxhash64(*by) if by else F.lit(0).cast("long")).alias("_group"), key.alias("_key"), *cells)
    n_by = len(by)

    def resample(batches):
        for batch in batches:
            group, keys = (batch.column(n_by + k).to_numpy() for k in (0, 1))
            counts = np.stack([batch.column(n_by + 2 + k).to_numpy().astype(np.float64) for k in range(len(cells))], axis=1)
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                total = np.zeros((replicates, len(cells)))
                for at in range(0, len(own), UNITS):
                    part = own[at : at + UNITS]
                    total += poisson_weights(keys[part], replicates).T.astype(np.float64) @ counts[part]
                named = [pa.repeat(batch.column(k)[int(own[0])], replicates) for k in range(n_by)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(np.arange(replicates)), *(pa.array(np.rint(total[:, k]).astype(np.int64)) for k in range(len(cells)))], [*by, "_rep", *cells])

    kinds = dict(rows.dtypes)
    sums = rows.mapInArrow(resample, ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["_rep long"] + [f"{c} long" for c in cells]))
    sums = sums.groupBy(*by, "_rep").agg(*[F.sum(c).alias(c) for c in cells])
    stat = sums.select(*by, delta(sums).alias("_d"))
    ci = (stat.groupBy(*by) if by else stat).agg(F.percentile("_d", F.lit(0.025)).alias("lo"), F.percentile("_d", F.lit(0.975)).alias("hi"), F.count("*").alias("n_boot"), (F.count("*") - F.count("_d")).alias("n_degenerate"))
    return full.join(ci, by) if by else full.crossJoin(ci)


def random_experts(df: DataFrame, y: str, key: str, rate: float, n: int = 20) -> DataFrame:
    """Mean and 2.5/97.5 percent of the metrics of n hash-uniform experts of a positive rate."""
    drawn = df.select(y, key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("expert"))
    drawn = drawn.withColumn("p", (F.pmod(F.xxhash64(key, "expert"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < rate).cast("int"))
    m = M.thresholded(drawn, y, "p", "expert")
    return m.agg(*[f.alias(f"{c}_{k}") for c in ("accuracy", "mcc") for k, f in (("mean", F.avg(c)), ("lo", F.percentile(c, F.lit(0.025))), ("hi", F.percentile(c, F.lit(0.975))))])
