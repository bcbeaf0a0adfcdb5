"""Vector kNN, reranking and pair selection."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gritstone.functions import text as T

#: Queries that are broadcast at once; more are taken in further blocks.
QUERY_BLOCK = 4096


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix, shorter ones padded with zeros."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.array([(v or []) + [0.0] * (dim - len(v or [])) for v in lists.to_pylist()], dtype=np.float64).reshape(-1, dim)


def nearest(q: np.ndarray, x: np.ndarray, keys: np.ndarray, k: int, metric: str, skip: np.ndarray):
    """For each query the places and distances of its k nearest rows, ties by key. skip: (queries, rows) left out.

    A matrix product selects the rows within a rounding error of the k-th; those are measured again one by one, so the
    distance is the same whatever the batch.
    """
    fast = -(q @ x.T) if metric == "dot" else (q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1)
    fast[skip] = np.inf
    slack = 1e-9 * (1 + (q**2).sum(1) + (x**2).sum(1).max(initial=0))
    for i in range(len(q)):
        last = np.partition(fast[i], k - 1)[k - 1] if len(keys) > k else np.inf
        near = np.flatnonzero((fast[i] <= last + slack[i]) & np.isfinite(fast[i]))
        d = -(x[near] * q[i]).sum(axis=1) if metric == "dot" else np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((keys[near], d))[:k]
        yield near[order], -d[order] if metric == "dot" else d[order]


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", exclude_self: bool = True) -> DataFrame:
    """query_id, vec_id, distance, l2_rank: the k nearest base vectors of each query, ties by vec_id.

    Sides: vec_id, embedding. Queries go out in blocks of bounded size; each Arrow batch of the base is one matrix
    product, keeps its own k best per query, and only those are shuffled. metric dot ranks by largest inner product.
    Shorter vectors count as padded with zeros, on both sides.
    """
    spark = base.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        part = queries.select("vec_id", "embedding").filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        if not len(part):
            continue
        lists = part["embedding"].combine_chunks()
        dim = max(lists.value_lengths().fill_null(0).to_pylist())
        shared = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), _matrix(lists, dim)))

        def best(batches, shared=shared):
            ids, q = shared.value
            for batch in batches:
                lists, keys = batch.column(1), batch.column(0).to_numpy()
                wide = max([q.shape[1], *lists.value_lengths().fill_null(0).to_pylist()])
                x, own = _matrix(lists, wide), np.pad(q, ((0, 0), (0, wide - q.shape[1])))
                skip = (ids[:, None] == keys[None, :]) & exclude_self
                found = list(nearest(own, x, keys, k, metric, skip))
                if found:
                    at, dist = (np.concatenate([f[j] for f in found]) for j in (0, 1))
                    of = np.repeat(ids, [len(f[0]) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(keys[at]), pa.array(dist)], ["query_id", "vec_id", "distance"])

        rows = base.select("vec_id", "embedding").mapInArrow(best, "query_id long, vec_id long, distance double")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, distance double")
    order = F.desc("distance") if metric == "dot" else F.col("distance")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id"))
    return out.withColumn("l2_rank", rank).filter(F.col("l2_rank") <= k)


@F.pandas_udf(DoubleType())
def outline_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two graph outlines; 0 if either is empty."""
    return pd.Series([0.0 if not x or not y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def rerank(candidates: DataFrame, score: str, *ties: str) -> DataFrame:
    """rank of each query's candidates by score descending."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), *ties)))


def hybrid(candidates: DataFrame, texts: DataFrame, graphs: DataFrame | None = None, weights=(0.7, 0.3)) -> DataFrame:
    """score = 0.7 Jaccard of words + 0.3 graph similarity, and rank by it, ties by L2 rank.

    candidates: query_id, vec_id, l2_rank. texts: id, text. graphs: id, outline; ids without one have similarity 0.
    Only texts of candidates are cut into words, as hashes.
    """
    ids = candidates.select(F.explode(F.array("query_id", "vec_id")).alias("id")).distinct()
    words = F.array_distinct(F.transform(T.words("text"), lambda w: F.xxhash64(w)))
    items = texts.join(ids, "id", "left_semi").select("id", words.alias("items"))
    rows = candidates.join(items.select(F.col("id").alias("query_id"), F.col("items").alias("q_items")), "query_id")
    rows = rows.join(items.select(F.col("id").alias("vec_id"), F.col("items").alias("c_items")), "vec_id").withColumn("jaccard", T.jaccard("q_items", "c_items")).drop("q_items", "c_items")
    graph = F.lit(0.0)
    if graphs is not None:
        outlines = graphs.join(ids, "id", "left_semi").select("id", "outline")
        rows = rows.join(outlines.select(F.col("id").alias("query_id"), F.col("outline").alias("q_outline")), "query_id", "left")
        rows = rows.join(outlines.select(F.col("id").alias("vec_id"), F.col("outline").alias("c_outline")), "vec_id", "left")
        rows = rows.withColumn("graph", outline_similarity("q_outline", "c_outline")).drop("q_outline", "c_outline")
        graph = F.col("graph")
    rows = rows.withColumn("score", F.round(F.lit(weights[0]) * F.col("jaccard") + F.lit(weights[1]) * graph, 6))
    return rerank(rows, "score", "l2_rank")


def constrained_first(ranked: DataFrame, families: str = "families", wanted: str = "query_families") -> DataFrame:
    """Per query the first candidate that shares a family, else the first of all, with a reason."""
    hit = F.arrays_overlap(families, wanted)
    best = ranked.groupBy("query_id").agg(F.min_by("vec_id", F.when(hit, F.col("rank"))).alias("match"), F.min_by("vec_id", "rank").alias("first"))
    reason = F.when(F.col("match").isNull(), "no_matching_candidate").when(F.col("match") == F.col("first"), "first_matches").otherwise("moved_to_match")
    return best.select("query_id", F.coalesce("match", "first").alias("selected"), reason.alias("reason"))


def with_fallback(ranked: DataFrame, base: DataFrame, n: int = 5) -> DataFrame:
    """ranked with, for each query and label it lacks, the first n rows of that label in base, at score 0.5 and ``fallback``.

    ranked: query_id, vec_id, label, rank, score. base: id, label.
    """
    order = W.partitionBy("label").orderBy("id")
    first = base.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    have = ranked.groupBy("query_id").agg(F.collect_set("label").alias("have"))
    lacking = have.select("query_id", F.explode(F.array_except(F.array(F.lit(1), F.lit(0)), F.col("have").cast("array<int>"))).alias("label"))
    added = lacking.join(F.broadcast(first), "label").filter(F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("vec_id"), "label", "rank", F.lit(0.5).alias("score"), F.lit(True).alias("fallback"))
    both = ranked.select("query_id", "vec_id", "label", "rank", "score", F.lit(False).alias("fallback")).unionByName(added)
    return both.hint("rebalance")  # the union's own partitioning isn't what adaptive execution makes of its sides


def contrastive_pairs(ranked: DataFrame, texts: DataFrame, strategy: str = "counterexample_pair", top: int = 10, base: DataFrame | None = None) -> DataFrame:
    """Per query the best pair of a positive and a negative candidate: query_id, v, s, pair_score, v_fallback, s_fallback.

    ranked: query_id, vec_id, label, rank, score. texts: id, text. counterexample_pair: sum of scores + half the pair's
    Jaccard; minimal_security_diff: the pair's Jaccard; anything else takes the first of each label. Only the first
    ``top`` of each label are paired. A query whose candidates lack a label takes the first rows of that label of base
    (id, label); without base it has no pair.
    """
    ranked = with_fallback(ranked, base) if base is not None else ranked.withColumn("fallback", F.lit(False))
    by = W.partitionBy("query_id", "label").orderBy("rank")
    rows = ranked.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= (top if strategy in ("counterexample_pair", "minimal_security_diff") else 1))
    side = lambda v, n: rows.filter(F.col("label") == v).select("query_id", F.col("vec_id").alias(n), F.col("score").alias(f"{n}_score"), F.col("r").alias(f"{n}_rank"), F.col("fallback").alias(f"{n}_fallback"))
    pairs = side(1, "v").join(side(0, "s"), "query_id")
    ids = rows.select(F.col("vec_id").alias("id")).distinct()
    items = texts.join(ids, "id", "left_semi").select("id", F.array_distinct(F.transform(T.words("text"), lambda w: F.xxhash64(w))).alias("items"))
    named = lambda n: items.select(F.col("id").alias(n), F.col("items").alias(f"{n}_items"))
    pairs = pairs.join(named("v"), "v").join(named("s"), "s").withColumn("pair_jaccard", T.jaccard("v_items", "s_items"))
    score = {"counterexample_pair": F.col("v_score") + F.col("s_score") + F.lit(0.5) * F.col("pair_jaccard"), "minimal_security_diff": F.col("pair_jaccard")}.get(strategy, F.lit(0.0))
    order = W.partitionBy("query_id").orderBy(F.desc("pair_score"), "v_rank", "s_rank")
    pairs = pairs.withColumn("pair_score", F.round(score, 6)).withColumn("r", F.row_number().over(order)).filter("r = 1")
    return pairs.select("query_id", "v", "s", "pair_score", "v_fallback", "s_fallback")


def retrieval_case(code_sim, sec_sim, target, demo, high_code: float = 0.25, high_sec: float = 0.5):
    """Case letter of a retrieved example; a label mismatch comes before superficial similarity."""
    code, sec, same = F.col(code_sim) >= high_code, F.col(sec_sim) >= high_sec, F.col(target) == F.col(demo)
    return F.when(code & sec & same, "A").when(code & ~same, "C").when(code & ~sec, "B").when(~code & sec, "D").otherwise("uncorrelated")
