"""Benchmark decontamination by winnowing.

Each text keeps the smallest k-gram hash of every sliding window of k-grams. With k-grams of 7 words and windows of
7 k-grams any shared span of 13 words shares a kept fingerprint, so a document without a fingerprint of the test set
has no window of it. Hits are extended: in documents with a fingerprint, every 13-word window is held against the items'
windows. Items of fewer than 13 words are one window of their own length, found by its whole-item hash.

Fingerprints and windows of the test set are tables of hashes. Two bitmaps of fixed size, one of fingerprints and one of
windows, go to the executors whatever the test set's size, so that a pass over the documents keeps only the windows that
may be in it; those are joined with the test set's windows, exactly. Rows without such a window are done then, and only
the others are shuffled, for their hits. The query passes over the documents once; the stage twice, to write no copy.

Cases: a null or wordless text has no words and is never contaminated; wordless items have no windows; items with a
null id are written as an empty id, and items that share an id are one; repeated rows are judged each; an empty test set
hits nothing. Extra columns are kept in a column of their own, so their names may be any.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._shared import Scratch, bitmap, in_bitmap, release_worker_state, small_batches, table

U = np.uint64
WINDOW = 13
GRAM = 7
#: Bits of each bitmap, as a power of two: 8 MB.
BITMAP = 26
PRINT = 0


def winnow(grams: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Indices kept by winnowing; valid marks the first grams of windows that lie within one text."""
    at = W.sliding_argmin(grams, w)
    return np.unique(at[valid[: len(at)]])


def _salted(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams, apart for each n; n = PRINT for fingerprints."""
    return W.mix(hashes + U((n + 1) * W._STEP & (1 << 64) - 1))


def grams_of(words: W.Words, n: int):
    """Hash and first word of the runs of n words that lie within a text."""
    at = np.flatnonzero(words.left() >= n)
    return W.grams(words.hashes, n)[at], at


def prints_of(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints of texts of WINDOW words or more, and the text of each."""
    grams = W.grams(words.hashes, GRAM)
    kept = winnow(grams, words.left() >= WINDOW, WINDOW - GRAM + 1)
    return grams[kept], words.text_of()[kept]


def _split(column):
    data, offsets = W.utf8(column)
    for a, b in W.pieces(offsets):
        yield a, b, W.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.folded_table())


def item_hashes(bench: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, n, h: windows of n words and, with n = PRINT, fingerprints of the test set, each once."""

    def hashes(batches):
        for batch in batches:
            for a, b, words in _split(batch.column(1)):
                counts, of = np.diff(words.first), words.text_of()
                prints, owners = prints_of(words)
                found = [(_salted(prints, PRINT), owners, PRINT)]
                for n in range(1, WINDOW + 1):
                    if n == WINDOW:
                        grams, at = grams_of(words, n)
                    else:
                        at = words.first[:-1][counts == n]
                        grams = W.grams(words.hashes, n)[at] if len(at) else np.zeros(0, U)
                    found.append((_salted(grams, n), of[at], n))
                h, owners = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                n = np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(owners.astype(np.int64))), pa.array(n), pa.array(W.signed(h))], ["item", "n", "h"])

    rows = bench.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(hashes, "item string, n int, h long").distinct()


def bitmaps(items: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bitmaps of fingerprints and of windows, of fixed size, and the lengths of windows."""
    lengths = sorted(r.n for r in items.filter(F.col("n") != PRINT).select("n").distinct().collect())  # 13 at most
    return bitmap(items.filter(F.col("n") == PRINT), "h", BITMAP), bitmap(items.filter(F.col("n") != PRINT), "h", BITMAP), lengths


def maybe(words: W.Words, prints: np.ndarray, windows: np.ndarray, lengths: list[int]):
    """Text, n, hash and place of every window that the bitmaps don't rule out."""
    of, begin = words.text_of(), words.first[:-1]
    kept, owners = prints_of(words)
    near = np.zeros(len(begin), bool)
    near[owners[in_bitmap(prints, _salted(kept, PRINT))]] = True
    out = []
    for n in lengths:
        if n == WINDOW and not near.any():
            continue
        grams, at = grams_of(words, n)
        if n == WINDOW:
            grams, at = grams[near[of[at]]], at[near[of[at]]]
        h = _salted(grams, n)
        ok = in_bitmap(windows, h)
        out.append((of[at[ok]], np.full(ok.sum(), n, np.int32), h[ok], (at[ok] - begin[of[at[ok]]]).astype(np.int32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, U), np.zeros(0, np.int32)
    of, n, h, at = (np.concatenate([x[k] for x in out]) for k in range(4))
    order = np.argsort(of, kind="stable")
    return of[order], n[order], h[order], at[order]


def hits(docs: DataFrame, bench: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """row (struct of the carried columns, all by default), words, spots (ascending places of hit words) and items (ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "decontaminate")
    items = scratch.save(item_hashes(bench), "items")
    shared = spark.sparkContext.broadcast(bitmaps(items))

    def mark(batches):
        release_worker_state()
        for batch in batches:
            counts, parts = [], []
            for a, b, words in _split(batch.column(2)):
                of, n, h, at = maybe(words, *shared.value)
                counts.append(np.diff(words.first).astype(np.int64))
                parts.append((of + a, n, h, at))
            of, n, h, at = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), pa.array(W.signed(h.astype(U))), pa.array(at.astype(np.int32))], ["n", "h", "at"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), pa.ListArray.from_arrays(pa.array(ends), found)], ["row", "rid", "words", "found"])

    rows = docs.select(F.struct(*(carried or docs.columns)).alias("row"), F.monotonically_increasing_id().alias("rid"), F.col("text").alias("text"))
    schema = rows.select("row", "rid", F.lit(0).cast("long").alias("words"), F.array().cast("array<struct<n:int,h:bigint,at:int>>").alias("found")).schema
    marked = rows.mapInArrow(mark, schema)
    if carried is not None:
        marked = scratch.save(marked, "marked")  # small rows: one pass over the texts
    suspects = marked.filter(F.size("found") > 0)
    if carried is None:
        suspects = scratch.save(suspects, "suspects")  # whole rows, but few; the others are marked again as they are read
    spread = suspects.select("rid", F.explode("found").alias("f")).select("rid", "f.n", "f.h", "f.at")
    windows = items.filter(F.col("n") != PRINT)
    met = scratch.save(spread.join(windows.select("n", "h").distinct(), ["n", "h"]), "met")
    spots = met.groupBy("rid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1))))).alias("spots"))
    named = met.select("rid", "n", "h").distinct().join(windows, ["n", "h"]).select("rid", "item").distinct()
    named = named.groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = [F.array().cast("array<int>").alias("spots"), F.array().cast("array<string>").alias("items")]
    clean = marked.filter(F.size("found") == 0).select("row", "words", *none)
    hit = suspects.join(spots.join(named, "rid"), "rid", "left")
    return clean.unionByName(hit.select("row", "words", *[F.coalesce(x, y).alias(x) for x, y in zip(("spots", "items"), none)]))


def contaminated():
    n = F.size("spots")
    return (n > 0) & (F.lit(20) * n >= F.col("words"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return hits(docs, bench, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("words").alias("n_words"),
        F.size("spots").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = hits(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).filter(~contaminated())
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def brute(words: list[str], items: list[tuple[str, list[str]]]) -> tuple[set[int], set[str]]:
    """Hit positions and ids of one document, window by window: the plain definition, for tests."""
    spots, ids = set(), set()
    for key, item in items:
        n = min(WINDOW, len(item))
        found = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in found:
                spots.update(range(i, i + n))
                ids.add(key)
    return spots, ids


def digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT COALESCE(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), lengths AS (
  SELECT DISTINCT least(13, len(ws)) AS n FROM b WHERE len(ws) > 0
), items AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT *, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - n + 2)) t(i)
), hits AS (
  SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM d, lengths, unnest(range(1, len(ws) - n + 2)) t(i)) JOIN items USING (n, k)
), spots AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) t(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""
