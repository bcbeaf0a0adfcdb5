"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are n-grams of words (1 and 2) and of word shapes (1 to 3), hashed into one table of weights; a shape says
which kinds of characters a word has, its length class and whether it repeats the word before. A feature's value is its
share of the text's words. The learner is FTRL-proximal with per-coordinate rates on a sample of labelled rows whose
expected size is a parameter; it sees text and label alone. The weights are broadcast and every whole text is scored
as a sparse dot product in numpy.

Cases: null, empty and wordless texts score 0; unlabelled rows and rows whose label isn't 0 or 1 are scored but not
learned from; repeated rows are scored each; without both labels in the sample every score is that of the intercept.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._shared import HELD_OUT, fold, small_batches, table

U = np.uint64
BUCKETS = 1 << 18
#: Labelled rows learned from, as an expectation.
SAMPLE = 4000
#: FTRL-proximal: rate, its smoothing, L1 and L2; passes over the sample; scale of the shares.
ALPHA, BETA, L1, L2, PASSES, SCALE = 1.0, 1.0, 0.02, 0.5, 4, 10.0
THRESHOLD = 0.7


def _kinds() -> np.ndarray:
    """Kind of each byte: lower-case letter, capital, digit, other ASCII, part of a non-ASCII letter."""
    t = np.full(256, 3)
    t[97:123], t[65:91], t[48:58], t[128:] = 0, 1, 2, 4
    return t


def shapes(words: W.Words) -> np.ndarray:
    """A 64-bit code of each word's shape."""
    kinds, code = _kinds()[words.data], np.zeros(len(words.starts), dtype=U)
    for k, most in enumerate((1, 2, 2, 4, 1)):
        sums = np.concatenate([[0], np.cumsum(kinds == k)])
        code = code * U(8) + np.minimum(sums[words.ends] - sums[words.starts], most).astype(U)
    code = code * U(8) + np.searchsorted([2, 4, 8, 14], words.ends - words.starts).astype(U)
    same = np.zeros(len(code), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    return W.mix(code * U(2) + same.astype(U))


def features(words: W.Words):
    """Bucket and text of every feature occurrence, families one after another."""
    left, of = words.left(), words.text_of()
    shape = shapes(words)
    for salt, (base, n) in enumerate(((words.hashes, 1), (words.hashes, 2), (shape, 1), (shape, 2), (shape, 3)), start=1):
        at = np.flatnonzero(left >= n)
        yield (W.mix(W.grams(base, n)[at] + U(salt * W._STEP & (1 << 64) - 1)) & U(BUCKETS - 1)).astype(np.int64), of[at]


def _chunks(texts):
    data, offsets = W.utf8(texts)
    for a, b in W.pieces(offsets):
        yield a, b, W.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.plain_table())


def ftrl(rows, labels, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: (buckets, values) of each text, buckets distinct."""
    z, n, w = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30)))
            g = (p - labels[i]) * x
            more = n[at] + g * g
            zi = z[at] + g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w[at]
            z[at], n[at] = zi, more
            l1 = np.where(at == BUCKETS, 0.0, L1)
            w[at] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(more)) / ALPHA + L2))
    return w[:BUCKETS].astype(np.float32), float(w[BUCKETS])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and intercept from labelled rows whose fold isn't held out."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.filter((fold() != HELD_OUT) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    share = min(1.0, sample / max(1, usable.count()))
    usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def extract(batches):
        for batch in batches:
            y = batch.column(1)
            for a, b, words in _chunks(batch.column(0)):
                parts = list(features(words))
                key = np.concatenate([o * BUCKETS + f for f, o in parts])
                keys, counts = np.unique(key, return_counts=True)
                ends = np.searchsorted(keys // BUCKETS, np.arange(b - a + 1))
                sizes = np.maximum(np.diff(words.first), 1)
                at, x = (keys % BUCKETS).astype("<i4"), (counts * SCALE / sizes[keys // BUCKETS]).astype("<f4")
                yield pa.RecordBatch.from_arrays([y.slice(a, b - a), *(pa.array([v[ends[i] : ends[i + 1]].tobytes() for i in range(b - a)], pa.binary()) for v in (at, x))], ["label", "at", "x"])

    # The sample has a bounded size, so it can be broadcast and its features brought to the driver.
    chosen = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("text", "label")
    got = chosen.mapInArrow(extract, "label int, at binary, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["at"], r["x"]))  # so that the order of tasks doesn't matter
    rows = [(np.append(np.frombuffer(r["at"], "<i4"), BUCKETS), np.append(np.frombuffer(r["x"], "<f4"), 1.0)) for r in got]
    return ftrl(rows, np.array([r["label"] for r in got], dtype=float))


def score_texts(texts, weights: np.ndarray, intercept: float) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b, words in _chunks(texts):
        sizes, total = np.diff(words.first), np.zeros(b - a)
        for at, of in features(words):
            total += np.bincount(of, weights=weights[at], minlength=b - a)
        score = 1 / (1 + np.exp(-np.clip(intercept + SCALE * total / np.maximum(sizes, 1), -30, 30)))
        out[a:b] = np.where(sizes > 0, score, 0.0)
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def apply(batches):
        for batch in batches:
            scores = score_texts(batch.column(2), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(apply, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))
