"""Near-duplicate classes by ProbMinHash, banding and verification.

Each document is the set of its 5-word shingles (words between ASCII white space, unchanged; a text of 1 to 4 words is
one shingle), all of weight 1 however often they occur: links are judged by sets, so candidates must be too. A shingle's
arrivals are a Poisson process with its weight as rate, drawn from its hash; each arrival falls into one of the signature's
components, which keeps the earliest. A shingle stops as soon as its next arrival is later than every component's: two
signatures then agree in a component with the probability Jaccard similarity, which for equal weights is the Jaccard
similarity of the sets. Components are banded; ids that share a band are compared, first by their signatures
and then exactly by the Jaccard similarity of their shingle sets (see _links for how no bucket becomes all its pairs).

Texts of equal words are one class head from the start, so copies are never paired. Classes are the connected
components of links of ``threshold`` or more; class_id is the least doc_id.

Cases: texts without words are classes of their own; rows with a null doc_id have a null class; rows that share a doc_id
are one node; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._links import classes_of
from ._shared import release_worker_state, Scratch, small_batches, table

U = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
#: 40 bands of 5 components: a pair at 0.8 shares none with a probability of 1.3e-7, one at 0.85 of 7e-11.
BANDS, ROWS = 40, 5
COMPONENTS = BANDS * ROWS
#: Pairs whose signatures agree in less than this share are no links: 7 standard deviations below 0.8 (3e-11).
SURELY_BELOW = 0.6


def shingles(words: W.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every shingle, repeats included."""
    left, of = words.left(), words.text_of()
    at = np.flatnonzero(left >= k)
    hashes, owners = [W.grams(words.hashes, k)[at]], [of[at]]
    counts = np.diff(words.first)
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            hashes.append(W.grams(words.hashes, n)[words.first[short]])
            owners.append(short)
    return np.concatenate(hashes), np.concatenate(owners)


def weighted(hashes: np.ndarray, owners: np.ndarray):
    """Distinct shingles of each text and their counts."""
    _, at, counts = np.unique(W.mix(hashes + owners.astype(U) * U(W._BASE)), return_index=True, return_counts=True)
    return hashes[at], owners[at], counts


def prob_minhash(hashes: np.ndarray, owners: np.ndarray, weights: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """(n, m) hashes of the earliest elements; 0 where a text has no element."""
    first, ident = np.full(n * m, np.inf), np.zeros(n * m, dtype=U)
    latest, time = np.full(n, np.inf), np.zeros(len(hashes))
    alive, turn = np.arange(len(hashes)), 0
    while len(alive):
        turn += 1
        draw = W.mix(hashes[alive] + U(turn * W._STEP & (1 << 64) - 1))
        time[alive] -= np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[alive]
        ok = time[alive] < latest[owners[alive]]
        alive, draw = alive[ok], draw[ok]
        slot = owners[alive] * m + (W.mix(draw) % U(m)).astype(np.int64)
        sooner = time[alive] < first[slot]
        at, slot = alive[sooner], slot[sooner]
        np.minimum.at(first, slot, time[at])
        won = first[slot] == time[at]
        ident[slot[won]] = hashes[at[won]]
        changed = np.unique(owners[at])
        latest[changed] = first.reshape(n, m)[changed].max(axis=1)
    return ident.reshape(n, m)


def band_keys(ident: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    factors = W.mix(np.arange(1, rows + 1, dtype=U)) | U(1)
    x = (ident.reshape(len(ident), bands, rows) * factors).sum(axis=2, dtype=U)
    return W.mix(x + np.arange(1, bands + 1, dtype=U) * U(W._STEP))


def text_keys(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the word sequence of each text."""
    of = words.text_of()
    place = (np.arange(len(words.starts)) - words.first[:-1][of]).astype(U)
    out = []
    for salt in (W._BASE, W._STEP):
        parts = W.mix(words.hashes * U(salt) + place * U(0xA0761D6478BD642F))
        sums = np.concatenate([[U(0)], np.cumsum(parts, dtype=U)])
        out.append(sums[words.first[1:]] - sums[words.first[:-1]])
    return out[0], out[1]


def signatures(docs: DataFrame) -> DataFrame:
    """v, key_a, key_b, n (words), bands, sketch (16 bits of each component) of rows with an id; no bands without words."""
    small_batches(docs.sparkSession)

    def sign(batches):
        release_worker_state()
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            for a, b in W.pieces(offsets):
                words = W.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.plain_table())
                hashes, owners, _ = weighted(*shingles(words))
                ident = prob_minhash(hashes, owners, np.ones(len(hashes)), b - a)
                n = np.diff(words.first)
                keys = W.signed(band_keys(ident))[n > 0]
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))])
                sketch = (ident & U(0xFFFF)).astype("<u2")
                key_a, key_b = text_keys(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(W.signed(key_a)), pa.array(W.signed(key_b)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel())), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    ["v", "key_a", "key_b", "n", "bands", "sketch"],
                )

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("v"), "text")
    return rows.mapInArrow(sign, f"v {dict(rows.dtypes)['v']}, key_a long, key_b long, n long, bands array<long>, sketch binary")


def _agree(batches):
    """Pairs whose sketches agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, COMPONENTS) for k in (2, 3))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= SURELY_BELOW))


def jaccard_of_pairs(left, right) -> np.ndarray:
    """Jaccard similarity of the shingle sets of two Arrow columns of texts, row by row."""
    sets = []
    for column in (left, right):
        data, offsets = W.utf8(column)
        own = []
        for a, b in W.pieces(offsets):
            hashes, owners, _ = weighted(*shingles(W.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.plain_table())))
            order = np.argsort(owners, kind="stable")
            own += np.split(hashes[order], np.cumsum(np.bincount(owners, minlength=b - a))[:-1])
        sets.append(own)
    out = np.zeros(len(left))
    for i, (x, y) in enumerate(zip(*sets)):
        if len(x) and len(y):
            both = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = both / (len(x) + len(y) - both)
    return out


def near_in_block(group: pa.Table, threshold: float):
    """Ends (least first) of links between outer and other ids of a block with different roots.

    Shingles of one text of the block alone can't be common, so only the others become columns of 0/1 matrices, whose
    products are the intersections.
    """
    data, offsets = W.utf8(group["text"])
    hashes, owners = [], []
    for a, b in W.pieces(offsets):
        own, of, _ = weighted(*shingles(W.split(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], W.plain_table())))
        hashes.append(own)
        owners.append(of + a)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    sizes = np.bincount(owners, minlength=len(group))
    _, column, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    common = np.flatnonzero(counts[column] > 1)
    outer = group["outer"].to_numpy()
    roots, ids = group["root"].to_numpy(), group["v"].to_numpy()
    x, y = np.flatnonzero(outer), np.flatnonzero(~outer)
    both = np.zeros((len(x), len(y)), np.float32)
    place = np.full(len(group), -1)
    place[x], place[y] = np.arange(len(x)), np.arange(len(y))
    order = common[np.argsort(column[common], kind="stable")]
    dense = np.unique(column[order], return_inverse=True)[1] if len(order) else np.zeros(0, np.int64)
    for at in range(0, int(dense.max()) + 1 if len(dense) else 0, 8192):
        part = order[(dense >= at) & (dense < at + 8192)]
        where = dense[(dense >= at) & (dense < at + 8192)] - at
        left, right = np.zeros((len(x), 8192), np.float32), np.zeros((len(y), 8192), np.float32)
        side = outer[owners[part]]
        left[place[owners[part]][side], where[side]] = 1
        right[place[owners[part]][~side], where[~side]] = 1
        both += left @ right.T
    near = both >= threshold * (sizes[x][:, None] + sizes[y][None, :] - both)
    i, j = np.nonzero(near & (roots[x][:, None] != roots[y][None, :]) & (both > 0))
    return np.minimum(ids[x[i]], ids[y[j]]), np.maximum(ids[x[i]], ids[y[j]])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select("doc_id", "text")
    signed = scratch.save(signatures(docs), "signatures")
    worded = signed.filter("n > 0")
    # Written, so that the join back has a shuffle on either side and a text that very many rows share is split.
    copies = scratch.save(worded.groupBy("key_a", "key_b", "n").agg(F.min("v").alias("head")), "copies")
    heads = scratch.save(worded.select("v", "key_a", "key_b", "n").join(copies, ["key_a", "key_b", "n"]).select("v", "head"), "heads")
    own = scratch.save(signed.join(heads.filter("v = head").select("v").distinct(), "v", "left_semi").select("v", "bands", "sketch"), "own")

    # Joins by merging, whatever the sizes: what is moved then grows evenly with the input.
    several = own.select(F.explode("bands").alias("bucket"), "v")
    several = several.groupBy("bucket").agg(F.min("v").alias("least"), F.max("v").alias("most")).filter("least < most").select("bucket").join(several, "bucket").select(F.col("v").alias("doc_id")).distinct()
    texts = scratch.save(docs.hint("merge").join(several, "doc_id", "left_semi"), "texts")

    def verify(pairs: DataFrame, tag: str) -> DataFrame:
        sketch = own.select("v", "sketch").hint("merge")
        both = pairs.join(sketch.select(F.col("v").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        both = both.join(sketch.select(F.col("v").alias("b"), F.col("sketch").alias("sketch_b")), "b").select("a", "b", "sketch_a", "sketch_b")
        kind = dict(pairs.dtypes)["a"]
        near = scratch.save(both.mapInArrow(_agree, f"a {kind}, b {kind}"), f"near{tag}")
        text = texts.hint("merge")
        full = near.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        full = full.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

        def exact(batches):
            release_worker_state()
            for batch in batches:
                same = jaccard_of_pairs(batch.column(2), batch.column(3)) >= threshold
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(same))

        return scratch.save(full.mapInArrow(exact, f"a {kind}, b {kind}"), f"links{tag}")

    def compare(blocks: DataFrame) -> DataFrame:
        kind = dict(blocks.dtypes)["v"]
        rows = blocks.join(texts.hint("merge").select(F.col("doc_id").alias("v"), "text"), "v").select("family", "i", "j", "outer", "v", "root", "text")

        def links(group: pa.Table) -> pa.Table:
            a, b = near_in_block(group, threshold)
            return pa.table({"a": a, "b": b})

        return rows.groupBy("family", "i", "j").applyInArrow(links, f"a {kind}, b {kind}")

    roots = classes_of(scratch, own.select("v", "bands"), verify, compare)
    heads_in = heads.distinct().join(roots.withColumnRenamed("v", "head"), "head", "left").select("v", F.coalesce("root", "head").alias("class_id"))
    least = heads_in.groupBy("v").agg(F.min("class_id").alias("class_id"))
    out = docs.select("doc_id").join(least.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return scratch.finish(out)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the least doc_id."""
    dropped = near_duplicates(docs).filter("class_id < doc_id").select("doc_id").distinct()
    return docs.hint("merge").join(dropped, "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE common >= 0.8 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, COALESCE(c.class_id, d.doc_id) AS class_id FROM documents d LEFT JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) c ON d.doc_id = c.a
"""
