"""Nearest neighbours, reranking, pair selection and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.operators import retrieval as R

from ._bind import WORDS, query, read, u, u_sql

#: Queries are the vectors whose id is divisible by 10; embeddings and documents share ids.
_TOP = 20
_DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))"
_KNN = f"""kn AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0 AND a.vec_id <> b.vec_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {_TOP}), knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS l2_rank FROM kn)"""
_ITEMS = f"items AS (SELECT doc_id AS id, list_distinct({WORDS}) AS items FROM documents)"
_J = "round(0.7::DOUBLE * CASE WHEN len(q.items) = 0 OR len(c.items) = 0 THEN 0 ELSE len(list_intersect(q.items, c.items))::DOUBLE / (len(q.items) + len(c.items) - len(list_intersect(q.items, c.items))) END, 6)"
_HYB = f"hyb AS (SELECT k.query_id, k.vec_id, k.l2_rank, {_J} AS score FROM knn k JOIN items q ON q.id = k.query_id JOIN items c ON c.id = k.vec_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l2_rank) AS rank FROM hyb)"
_LAB = "lab AS (SELECT vec_id AS id, (label >= 5)::INT AS label, label % 4 AS family FROM embeddings)"
_ALL = f"WITH {_KNN}, {_ITEMS}, {_HYB}, {_LAB}"


def _knn(spark, d):
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    return R.knn(vectors.filter("vec_id % 10 = 0"), vectors, _TOP)


def _texts(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _labels(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"), F.pmod("label", F.lit(4)).alias("family"))


def _ranked(spark, d):
    return R.hybrid(_knn(spark, d), _texts(spark, d))


@query("vector_knn", f"WITH {_KNN} SELECT query_id, vec_id, l2_rank, round(distance, 5) AS distance FROM knn")
def vector_knn(spark, d):
    return _knn(spark, d).select("query_id", "vec_id", "l2_rank", F.round("distance", 5).alias("distance"))


@query("inner_product_knn", "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, round(distance, 5) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, vec_id) <= 5")
def inner_product_knn(spark, d):
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    return R.knn(vectors.filter("vec_id % 10 = 0"), vectors, 5, "dot").select("query_id", "vec_id", F.round("distance", 5).alias("distance"))


@query("matrix_scan_check", "SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS right_size, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x))) > 0) AS with_nan FROM embeddings")
def matrix_scan_check(spark, d):
    return read(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 64).alias("right_size"), F.count_if(F.exists("embedding", lambda x: F.isnan(x))).alias("with_nan"))


@query("knn_jaccard_rerank", f"{_ALL} SELECT query_id, vec_id, l2_rank, score, rank FROM ranked WHERE rank <= 5")
def knn_jaccard_rerank(spark, d):
    return _ranked(spark, d).filter("rank <= 5").select("query_id", "vec_id", "l2_rank", "score", "rank")


@query("hybrid_graph_rerank")
def hybrid_graph_rerank(spark, d):
    """0.7 Jaccard of words + 0.3 similarity of the graphs' outlines; the order of the same number is a vector's graph."""
    from .tables import graph_outlines

    rows = R.hybrid(_knn(spark, d), _texts(spark, d), graph_outlines(spark, d))
    return rows.filter("rank <= 5").select("query_id", "vec_id", "l2_rank", F.round("graph", 6).alias("graph"), "score", "rank")


_SEC = f"round(0.3::DOUBLE * score + 0.7::DOUBLE * {u_sql('vec_id', 'sec')}, 4)"


@query("weighted_rerank", f"{_ALL}, w AS (SELECT *, {_SEC} AS final FROM ranked) SELECT query_id, vec_id, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, l2_rank) AS final_rank FROM w")
def weighted_rerank(spark, d):
    """0.3 hybrid + 0.7 security score, rounded before the stable sort."""
    rows = _ranked(spark, d).withColumn("final", F.round(F.lit(0.3) * F.col("score") + F.lit(0.7) * u("vec_id", "sec"), 4)).drop("rank")
    return R.rerank(rows, "final", "l2_rank").select("query_id", "vec_id", "final", F.col("rank").alias("final_rank"))


_CON = f"con AS (SELECT r.query_id, r.vec_id, r.rank, q.family = c.family AS hit FROM ranked r JOIN lab q ON q.id = r.query_id JOIN lab c ON c.id = r.vec_id), pick AS (SELECT query_id, arg_min(vec_id, rank) FILTER (hit) AS m, arg_min(vec_id, rank) AS f FROM con GROUP BY query_id)"


def _constrained(spark, d):
    lab = _labels(spark, d)
    rows = _ranked(spark, d).join(lab.select(F.col("id").alias("query_id"), F.array("family").alias("query_families")), "query_id").join(lab.select(F.col("id").alias("vec_id"), F.array("family").alias("families")), "vec_id")
    return R.constrained_first(rows)


@query("family_constrained_first", f"{_ALL}, {_CON} SELECT query_id, COALESCE(m, f) AS selected, CASE WHEN m IS NULL THEN 'no_matching_candidate' WHEN m = f THEN 'first_matches' ELSE 'moved_to_match' END AS reason FROM pick")
def family_constrained_first(spark, d):
    return _constrained(spark, d)


@query("selection_diagnostics", f"{_ALL}, {_CON} SELECT count(*) AS queries, count(*) FILTER (m IS NOT NULL AND m <> f) AS changed, count(DISTINCT COALESCE(m, f)) AS unique_selected, count(*) FILTER (m IS NULL) AS unmatched FROM pick")
def selection_diagnostics(spark, d):
    return _constrained(spark, d).agg(F.count("*").alias("queries"), F.count_if(F.col("reason") == "moved_to_match").alias("changed"), F.countDistinct("selected").alias("unique_selected"), F.count_if(F.col("reason") == "no_matching_candidate").alias("unmatched"))


@query("selected_rank_histogram", f"{_ALL}, {_CON} SELECT r.l2_rank, count(*) AS n FROM pick p JOIN ranked r ON r.query_id = p.query_id AND r.vec_id = COALESCE(m, f) GROUP BY r.l2_rank")
def selected_rank_histogram(spark, d):
    picked = _constrained(spark, d).select("query_id", F.col("selected").alias("vec_id"))
    return _knn(spark, d).join(picked, ["query_id", "vec_id"]).groupBy("l2_rank").agg(F.count("*").alias("n"))


@query("demo_reuse", f"{_ALL}, {_CON}, c AS (SELECT COALESCE(m, f) AS demo, count(*) AS n FROM pick GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, demo) AS r FROM c) SELECT count(*) AS unique_demos, max(n) AS top1, sum(n) FILTER (r <= 3)::BIGINT AS top3, string_agg(demo::VARCHAR, ',' ORDER BY r) FILTER (r <= 5) AS top5 FROM o")
def demo_reuse(spark, d):
    counts = _constrained(spark, d).groupBy(F.col("selected").alias("demo")).agg(F.count("*").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "demo"))), 1, 5)
    out = counts.orderBy(F.desc("n"), "demo").limit(5).agg(F.max("n").alias("top1"), top.alias("t"))
    return counts.agg(F.count("*").alias("unique_demos")).crossJoin(out).select("unique_demos", "top1", (-F.aggregate(F.slice("t", 1, 3), F.lit(0).cast("long"), lambda a, x: a + x["m"])).alias("top3"), F.array_join(F.transform("t", lambda x: x["demo"].cast("string")), ",").alias("top5"))


_PAIRS = f"""fb AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS rank FROM lab QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 5),
rl AS (SELECT r.query_id, r.vec_id, c.label, r.rank, r.score, false AS fallback FROM ranked r JOIN lab c ON c.id = r.vec_id UNION ALL SELECT q.query_id, fb.id, fb.label, fb.rank, 0.5, true FROM (SELECT DISTINCT query_id FROM ranked) q, fb
  WHERE fb.id <> q.query_id AND NOT EXISTS (SELECT 1 FROM ranked r JOIN lab c ON c.id = r.vec_id WHERE r.query_id = q.query_id AND c.label = fb.label)),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS r FROM rl),
pr AS (SELECT v.query_id, v.vec_id AS v, s.vec_id AS s, v.r AS vr, s.r AS sr, v.score AS vs, s.score AS ss, v.fallback AS v_fallback, s.fallback AS s_fallback, CASE WHEN len(vi.items) = 0 OR len(si.items) = 0 THEN 0 ELSE len(list_intersect(vi.items, si.items))::DOUBLE / (len(vi.items) + len(si.items) - len(list_intersect(vi.items, si.items))) END AS j
FROM lr v JOIN lr s ON v.query_id = s.query_id AND v.label = 1 AND s.label = 0 AND v.r <= 10 AND s.r <= 10 JOIN items vi ON vi.id = v.vec_id JOIN items si ON si.id = s.vec_id)"""


def _pairs(spark, d, strategy):
    lab = _labels(spark, d).select("id", "label")
    ranked = _ranked(spark, d).join(lab.select(F.col("id").alias("vec_id"), "label"), "vec_id")
    return R.contrastive_pairs(ranked, _texts(spark, d), strategy, base=lab)


@query("contrastive_counterexamples", f"{_ALL}, {_PAIRS}, b AS (SELECT *, round(vs + ss + 0.5::DOUBLE * j, 6) AS pair_score FROM pr) SELECT query_id, v, s, pair_score, v_fallback, s_fallback FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, vr, sr) = 1")
def contrastive_counterexamples(spark, d):
    return _pairs(spark, d, "counterexample_pair")


@query("contrastive_minimal_difference", f"{_ALL}, {_PAIRS}, b AS (SELECT *, round(j, 6) AS pair_score FROM pr) SELECT query_id, v, s, pair_score, v_fallback, s_fallback FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, vr, sr) = 1")
def contrastive_minimal_difference(spark, d):
    return _pairs(spark, d, "minimal_security_diff")


@query("contrastive_label_contrast", f"{_ALL}, {_PAIRS} SELECT query_id, v, s, 0.0::DOUBLE AS pair_score, v_fallback, s_fallback FROM pr WHERE vr = 1 AND sr = 1")
def contrastive_label_contrast(spark, d):
    return _pairs(spark, d, "label_contrast")


_CASES = f"cs AS (SELECT r.query_id, r.vec_id, r.rank, r.score / 0.7 AS code_sim, {u_sql('r.vec_id', 'sec')} AS sec_sim, q.label AS target, c.label AS demo FROM ranked r JOIN lab q ON q.id = r.query_id JOIN lab c ON c.id = r.vec_id WHERE rank = 1)"
_CASE = "CASE WHEN code_sim >= 0.1 AND sec_sim >= 0.5 AND target = demo THEN 'A' WHEN code_sim >= 0.1 AND target <> demo THEN 'C' WHEN code_sim >= 0.1 AND sec_sim < 0.5 THEN 'B' WHEN code_sim < 0.1 AND sec_sim >= 0.5 THEN 'D' ELSE 'uncorrelated' END"


@query("retrieval_case_mix", f"{_ALL}, {_CASES} SELECT target, {_CASE} AS c, count(*) AS n, count(*) FILTER (target <> demo) AS mismatched FROM cs GROUP BY 1, 2")
def retrieval_case_mix(spark, d):
    lab = _labels(spark, d)
    rows = _ranked(spark, d).filter("rank = 1").join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("target")), "query_id").join(lab.select(F.col("id").alias("vec_id"), F.col("label").alias("demo")), "vec_id")
    rows = rows.withColumn("code_sim", F.col("score") / 0.7).withColumn("sec_sim", u("vec_id", "sec"))
    case = R.retrieval_case("code_sim", "sec_sim", "target", "demo", 0.1)
    return rows.groupBy("target", case.alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col("target") != F.col("demo")).alias("mismatched"))


@query("retrieval_comparison", f"{_ALL}, x AS (SELECT r.query_id, r.rank, r.score, q.label AS target, c.label AS demo FROM ranked r JOIN lab q ON q.id = r.query_id JOIN lab c ON c.id = r.vec_id) SELECT round(avg(score) FILTER (rank = 1), 6) AS sim_at_1, round(avg(score) FILTER (rank <= 5), 6) AS sim_at_5, round(avg((target = demo)::INT) FILTER (rank = 1), 6) AS agree_at_1, round(avg((demo = 1)::INT) FILTER (rank = 1 AND target = 1), 6) AS positive_demo_rate, count(*) FILTER (rank = 1 AND target <> demo AND score >= 0.05) AS dangerous FROM x")
def retrieval_comparison(spark, d):
    lab = _labels(spark, d)
    rows = _ranked(spark, d).join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("target")), "query_id").join(lab.select(F.col("id").alias("vec_id"), F.col("label").alias("demo")), "vec_id")
    first, same = F.col("rank") == 1, (F.col("target") == F.col("demo")).cast("int")
    return rows.agg(
        F.round(F.avg(F.when(first, F.col("score"))), 6).alias("sim_at_1"),
        F.round(F.avg(F.when(F.col("rank") <= 5, F.col("score"))), 6).alias("sim_at_5"),
        F.round(F.avg(F.when(first, same)), 6).alias("agree_at_1"),
        F.round(F.avg(F.when(first & (F.col("target") == 1), (F.col("demo") == 1).cast("int"))), 6).alias("positive_demo_rate"),
        F.count_if(first & (same == 0) & (F.col("score") >= 0.05)).alias("dangerous"),
    )
