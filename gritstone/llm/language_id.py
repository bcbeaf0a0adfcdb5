"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per language come from a sample of labelled rows whose size is a parameter; the log-probability matrix
(buckets x languages) is broadcast, and each Arrow batch is scored in numpy by sparse gathers and segment sums.

Cases: a null text counts as empty; a text without a letter is ``und`` with score 0; rows with a null doc_id are
scored but never learned from; repeated rows are scored each; of languages of equal score the first by name is predicted;
with no labelled row every prediction is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._shared import fold, HELD_OUT, release_worker_state, small_batches, table

BUCKETS = 1 << 16
ORDERS = (2, 3)
UNKNOWN = "und"
#: Labelled rows learned from per language, as an expectation.
SAMPLE_PER_LANGUAGE = 2000
#: All languages are learned; the matrix has 256 KB for each, and with more than these the labels are no languages.
MAX_LANGUAGES = 4096
SMOOTHING = 0.5


def _folded_points() -> np.ndarray:
    """For code points below 128: letters in lower case, all else a space."""
    t = np.full(128, 32, dtype=np.uint32)
    t[65:91] = t[97:123] = np.arange(97, 123)
    return t


def ngram_buckets(data: np.ndarray, offsets: np.ndarray):
    """Buckets of all n-grams of some texts, and the text of each."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = points < 128
    points = np.where(low, _folded_points()[np.where(low, points, 0)], points).astype(np.uint64)
    buckets, owners = [], []
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ points[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = owner[:m] == owner[n - 1 :]
        buckets.append((h >> np.uint64(20)).astype(np.int64)[whole] & (BUCKETS - 1))
        owners.append(owner[:m][whole])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _lowered(texts) -> tuple[np.ndarray, np.ndarray]:
    return W.utf8(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE):
    """(languages, log-probability matrix, log priors), learned from rows whose fold isn't held out."""
    learn = docs.filter((fold(key) != HELD_OUT) & F.col(lang).isNotNull()).select(key, lang, text)
    sizes = learn.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang}")
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0)
    languages = sorted(r[lang] for r in sizes)
    index = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[lang], min(1.0, sample / r["count"]))])
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    learn = learn.filter(draw < share[F.col(lang)])
    spark = docs.sparkSession
    small_batches(spark)

    def count(batches):
        release_worker_state()
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            of = np.array([index[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            data, offsets = _lowered(batch.column(1))
            for a, b in W.pieces(offsets):
                buckets, owner = ngram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total += np.bincount(of[a:b][owner] * BUCKETS + buckets, minlength=total.size).reshape(total.shape)
        which, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(bucket), pa.array(total[which, bucket])], ["k", "bucket", "n"])

    rows = learn.select(lang, text).mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    counts[rows["bucket"].to_numpy(), rows["k"].to_numpy()] += rows["n"].to_numpy()
    prior = np.array([{r[lang]: r["count"] for r in sizes}[x] for x in languages], dtype=float)
    return languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum())


def score_texts(texts, languages: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text of an Arrow array."""
    n = len(texts)
    letters = pc.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
    if not languages:
        return [UNKNOWN] * n, np.zeros(n)
    data, offsets = _lowered(texts)
    logs = np.tile(prior, (n, 1))
    for a, b in W.pieces(offsets, max(1 << 14, W.CHUNK * 4 // max(4, len(languages)))):
        buckets, owner = ngram_buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        order_at = np.flatnonzero(np.diff(owner, prepend=-1) != 0)  # texts ascend within each n-gram order
        if len(order_at):
            np.add.at(logs, a + owner[order_at], np.add.reduceat(matrix[buckets], order_at, axis=0, dtype=np.float64))
    best = logs.argmax(axis=1)
    score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    return [languages[k] if ok else UNKNOWN for k, ok in zip(best, letters)], np.where(letters, score, 0.0)


def identify(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        release_worker_state()
        for batch in batches:
            names, scores = score_texts(batch.column(2), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(fold(key) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model, least: float = 0.3) -> DataFrame:
    """Rows whose text has a language with a posterior of ``least`` or more; all columns stay."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batches):
        release_worker_state()
        for batch in batches:
            names, scores = score_texts(batch.column(at), *shared.value)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, fit(docs))
