"""Substring dedup: words covered by a window of 50 words that also starts in a document with a smaller doc_id.

No suffix tree is built; its deep nodes are found by hashes of their path labels, on sampled suffixes:

1. Every 50-word window owns one anchor, the smallest of its 10-word grams. Anchors are the sampled suffixes; the anchor
   gram is the prefix they are partitioned by. A prefix seen in one document only is a leaf and goes no further.
2. Under a shared prefix the label is lengthened to the anchor's whole context, the words of all windows it owns. A
   context whose least doc_id is smaller than the document's covers it at once; this settles the inside of repeats.
3. Only prefixes that branch into several contexts are expanded to single windows, and there only for the first
   document of each context: nodes at depth 50 with suffixes of several documents are the repeats' ends.

So groups of suffixes are lengthened only where they branch, and no group is gathered in one task: least ids are
combined before shuffles and written as tables, so the joins back have a shuffle on either side and adaptive execution
splits a prefix that very many documents share. Texts are shuffled once, into a table bucketed by row that the later
steps join without a shuffle.

Cases: null and wordless texts have no words; texts under 50 words lose none; windows within one document don't count;
rows with a null doc_id are kept whole and cover nothing; rows that share a doc_id don't cover each other; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._shared import Scratch, small_batches, table

U = np.uint64
WINDOW = 50
ANCHOR = 10


def anchors_of(words: W.Words, window: int = WINDOW, k: int = ANCHOR):
    """For each anchor: its gram, a hash of its context, its text, and the first and last window it owns."""
    n = len(words.hashes)
    if n < window:
        return (np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    grams = W.grams(words.hashes, k)
    at = W.sliding_argmin(grams, window - k + 1)
    own = np.flatnonzero(words.left()[: len(at)] >= window)
    of, p = words.text_of()[own], at[own]
    new = np.ones(len(own), bool)
    new[1:] = (p[1:] != p[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own))[: len(first)] - 1
    lo, hi, p, of = own[first], own[last], p[first], of[first]
    sums = np.concatenate([[U(0)], np.cumsum(words.hashes * W._power(n, W._STEP), dtype=U)])
    inverse = pow(W._STEP, -1, 1 << 64)
    context = (sums[hi + window] - sums[lo]) * W._power(n, inverse)[lo]
    context = W.mix(context + ((p - lo) * 64 + (hi - lo)).astype(U) * U(W._BASE))
    begin = words.first[:-1][of]
    return grams[p], context, of, lo - begin, hi - begin


def _split(column):
    data, offsets = W.utf8(column)
    for a, b in W.pieces(offsets):
        yield a, b, W.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.plain_table())


def _anchors(batches):
    for batch in batches:
        for a, b, words in _split(batch.column(1)):
            gram, context, of, lo, hi = anchors_of(words)
            ids, rows = (batch.column(k).slice(a, b - a).take(pa.array(of)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(gram)), pa.array(W.signed(context)), ids, rows, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["gram", "context", "doc_id", "rid", "lo", "hi"])


def _marks(spans, first: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in the spans [lo, hi) of their texts; spans: a list column of (lo, hi), or null."""
    step = np.zeros(n + 1, np.int64)
    sizes = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    begin = np.repeat(first[:-1], sizes)
    np.add.at(step, begin + flat.field(0).to_numpy(), 1)
    np.add.at(step, begin + flat.field(1).to_numpy(), -1)
    return np.cumsum(step)[:n] > 0


def _windows(batches):
    for batch in batches:
        for a, b, words in _split(batch.column(1)):
            n = len(words.hashes)
            at = np.flatnonzero(_marks(batch.column(3).slice(a, b - a), words.first, n))
            of = words.text_of()[at]
            ids, rows = (batch.column(k).slice(a, b - a).take(pa.array(of)) for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(W.grams(words.hashes, WINDOW)[at])), ids, rows, pa.array((at - words.first[:-1][of]).astype(np.int32))], ["w", "doc_id", "rid", "lo"])


def _cut(batches):
    for batch in batches:
        for a, b, words in _split(batch.column(1)):
            gone = _marks(batch.column(2).slice(a, b - a), words.first, len(words.hashes))
            counts = np.diff(words.first)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            data, digests = words.data.tobytes(), []
            for i in range(b - a):
                own = data[words.offsets[i] : words.offsets[i + 1]].split()
                if removed[i]:
                    own = compress(own, (~gone[words.first[i] : words.first[i + 1]]).tolist())
                digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def covered(scratch: Scratch, texts: DataFrame) -> DataFrame:
    """rid and spans, the word ranges [lo, hi) that windows of smaller documents cover. texts: doc_id, text, rid."""
    kind = dict(texts.dtypes)["doc_id"]
    present = texts.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", "rid")
    anchors = scratch.save(present.mapInArrow(_anchors, f"gram long, context long, doc_id {kind}, rid long, lo int, hi int"), "anchors")
    grams = anchors.groupBy("gram").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("gram")
    shared = scratch.save(anchors.join(scratch.save(grams, "grams"), "gram"), "shared")
    contexts = scratch.save(shared.groupBy("gram", "context").agg(F.min("doc_id").alias("least")), "contexts")
    branches = contexts.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram", F.lit(True).alias("branches"))
    contexts = scratch.save(contexts.join(branches, "gram", "left"), "nodes")
    judged = scratch.save(shared.join(contexts, ["gram", "context"]).select("rid", "lo", "hi", (F.col("least") < F.col("doc_id")).alias("whole"), "branches").filter("whole or branches"), "judged")
    inside = judged.filter("whole").select("rid", "lo", (F.col("hi") + WINDOW).alias("hi"))
    ends = judged.filter("not whole").groupBy("rid").agg(F.collect_list(F.struct("lo", (F.col("hi") + 1).alias("hi"))).alias("spans"))
    windows = texts.join(ends.hint("shuffle_hash"), "rid").select("doc_id", "text", "rid", "spans")
    windows = scratch.save(windows.mapInArrow(_windows, f"w long, doc_id {kind}, rid long, lo int"), "windows")
    seen = scratch.save(windows.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("w", "least"), "seen")
    outside = windows.join(seen, "w").filter("least < doc_id").select("rid", "lo", (F.col("lo") + WINDOW).alias("hi"))
    return inside.union(outside).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "repeats")
    name, buckets = f"gritstone_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")).repartition(buckets, "rid")
    rows.write.option("path", scratch.path("texts")).option("compression", "zstd").bucketBy(buckets, "rid").saveAsTable(name)
    texts = spark.table(name)
    try:
        spans = covered(scratch, texts)
        out = texts.join(spans.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "spans")
        kind = dict(texts.dtypes)["doc_id"]
        return scratch.finish(out.mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"))
    finally:
        spark.sql(f"DROP TABLE {name}")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) t(i)
), hit AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM win) WHERE least < doc_id
), words AS (
  SELECT w.doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)
), judged AS (
  SELECT words.doc_id, p, word, COALESCE(max(hit.i) OVER (PARTITION BY words.doc_id ORDER BY p) >= p - 49, false) AS gone
  FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id AND words.p = hit.i
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, COALESCE(j.gone, 0)::BIGINT AS n_removed, sha256(COALESCE(j.kept, '')) AS kept_sha256
FROM w LEFT JOIN (
  SELECT doc_id, count(*) FILTER (gone) AS gone, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id
) j ON w.doc_id = j.doc_id
"""
