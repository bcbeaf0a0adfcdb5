"""Evidence and signatures, prompts, resampling, learned models and runs. Most have no SQL form; tests hold them to goldens."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gritstone.functions import evidence as E
from gritstone.functions import signature as G
from gritstone.functions import text as T
from gritstone.functions.skeleton import skeleton
from gritstone.operators import controls, ml, prompts, resample
from gritstone.operators import retrieval as R
from gritstone.plans import diagnostic
from gritstone.streaming import runs

from ._bind import query, read, records
from ._code import CALLS, JUDGED, code_of, codes, conditions, heads, texts


@query("call_evidence")
def call_evidence(spark, d):
    return E.call_sites(codes(spark, d), "api", "family", "status", "reason", "state", "role", "start", "end", "line", "expression")


@query("evidence_text")
def evidence_text(spark, d):
    return E.evidence_texts(texts(spark, d), code_of)


@query("unknown_call_inventory", f"WITH {CALLS} SELECT api, count(*) AS sites, count(DISTINCT id) AS queries, array_to_string(list_sort(list(DISTINCT id)), ',') AS query_ids FROM calls WHERE status = 'unknown' GROUP BY api")
def unknown_call_inventory(spark, d):
    rows = E.call_sites(codes(spark, d), "api", "status").filter("status = 'unknown'").groupBy("api", "id").agg(F.count("*").alias("n"))
    ids = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",")
    return rows.groupBy("api").agg(F.sum("n").alias("sites"), F.count("*").alias("queries"), ids.alias("query_ids"))


@query("evidence_roles", f"WITH {CALLS} SELECT status, state, role, count(*) AS n FROM calls GROUP BY ALL")
def evidence_roles(spark, d):
    return E.call_sites(codes(spark, d), "status", "state", "role").groupBy("status", "state", "role").agg(F.count("*").alias("n"))


@query("evidence_diagnostics")
def evidence_diagnostics(spark, d):
    """Names that never close and problems of directives, of texts cut at two thirds."""
    cut = F.expr("substring(code, 1, cast(2 * char_length(code) / 3 as int))")
    rows = codes(spark, d).select("id", F.explode(E.diagnostics_of(cut)).alias("p"))
    return rows.select("id", "p.start", "p.reason", "p.name")


@query("preprocessor_conditions", f"WITH {JUDGED} SELECT id, count(*) FILTER (value) AS n_true, count(*) FILTER (NOT value) AS n_false, count(*) FILTER (value IS NULL) AS n_unknown FROM judged GROUP BY id")
def preprocessor_conditions(spark, d):
    rows = conditions(spark, d).select("id", E.condition_of("text").alias("value"))
    return rows.groupBy("id").agg(F.count_if("value").alias("n_true"), F.count_if(~F.col("value")).alias("n_false"), F.count_if(F.col("value").isNull()).alias("n_unknown"))


@query("extractor_comparison", f"WITH {CALLS} SELECT count(*) FILTER (status = 'recognized') AS kept, count(*) FILTER (status = 'excluded_inactive' AND api = 'strcpy') AS removed, count(*) FILTER (status = 'recognized' AND state = 'conditional') AS conditional, 0::BIGINT AS excluded_syntax, count(*) FILTER (role = 'buffer_formatting') AS formatting FROM calls")
def extractor_comparison(spark, d):
    """Call sites that region-aware scanning keeps and removes beside plain scanning, and roles it adds."""
    rows = E.call_sites(codes(spark, d), "family", "status", "state", "role")
    known, dead = F.col("status") == "recognized", (F.col("status") == "excluded_inactive") & F.col("family").isin("buffer_write")
    return rows.agg(F.count_if(known).alias("kept"), F.count_if(dead).alias("removed"), F.count_if(known & (F.col("state") == "conditional")).alias("conditional"), F.count_if(F.col("status") == "excluded_syntax").alias("excluded_syntax"), F.count_if(F.col("role") == "buffer_formatting").alias("formatting"))


@query(
    "callee_definitions",
    f"WITH {CALLS}, un AS (SELECT api, count(*) AS sites FROM calls WHERE status = 'unknown' GROUP BY api), def AS (SELECT id, 'helper_' || COALESCE(ws[1], 'v_') AS api FROM ws) SELECT un.api, sites, count(def.id) AS definitions, min(def.id) AS first_id FROM un LEFT JOIN def ON un.api = def.api GROUP BY un.api, sites",
)
def callee_definitions(spark, d):
    """Functions whose header names an unknown call: possible definitions, none resolved."""
    unknown = E.call_sites(codes(spark, d), "api", "status").filter("status = 'unknown'").groupBy("api").agg(F.count("*").alias("sites"))
    header = F.regexp_extract(F.substring_index("code", "{", 1), r"\b([A-Za-z_]\w*)\s*\([^{};]*\)\s*$", 1)
    defined = codes(spark, d).groupBy(header.alias("api")).agg(F.count("*").alias("definitions"), F.min("id").alias("first_id"))
    return unknown.join(defined, "api", "left").select("api", "sites", F.coalesce("definitions", F.lit(0)).alias("definitions"), "first_id")


@query("security_signatures")
def security_signatures(spark, d):
    rows = codes(spark, d).withColumn("s", G.signature_of("code"))
    joined = lambda c: F.array_join(F.col(f"s.{c}"), ",").alias(c)
    return rows.select("id", "s.func_name", *[joined(c) for c in ("sources", "sink_apis", "sink_categories", "controlled", "guards", "effective_guards", "paths", "clues")])


def _signed(spark, d, *more):
    """id, s and more of every function, kept on the disks of the executors: a join with itself reads it twice."""
    return codes(spark, d).withColumn("s", G.signature_of("code")).select("id", "s", *more).persist(StorageLevel.DISK_ONLY)


@query("signature_similarity")
def signature_similarity(spark, d):
    rows = _signed(spark, d)
    both = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("s").alias("t")), "id")
    return both.select("id", G.signature_similarity("s", "t").alias("similarity"), G.difference_text(F.col("s"), F.col("t")).alias("difference"))


@query("security_rerank")
def security_rerank(spark, d):
    """Shared pool of the 50 nearest, 0.3 hybrid + 0.7 signature similarity, family-constrained choice."""
    vectors = read(spark, d, "embeddings").select("vec_id", "embedding")
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    near = R.knn(vectors.filter("vec_id % 10 = 0"), vectors, 50)
    rows = R.hybrid(near, texts).drop("rank")
    ids = near.select(F.explode(F.array("query_id", "vec_id")).alias("id")).distinct()  # only candidates are scanned
    signed = codes(spark, d).join(ids, "id", "left_semi").repartition("id").withColumn("s", G.signature_of("code")).select("id", "s")
    rows = rows.join(signed.select(F.col("id").alias("query_id"), F.col("s").alias("q")), "query_id").join(signed.select(F.col("id").alias("vec_id"), F.col("s").alias("c")), "vec_id")
    rows = rows.withColumn("final", F.round(F.lit(0.3) * F.col("score") + F.lit(0.7) * G.signature_similarity("q", "c"), 4))
    rows = R.rerank(rows, "final", "l2_rank").withColumn("families", F.col("c.sink_categories")).withColumn("query_families", F.col("q.sink_categories"))
    return R.constrained_first(rows)


@query("signature_emptiness")
def signature_emptiness(spark, d):
    s = codes(spark, d).withColumn("s", G.signature_of("code"))
    empty = lambda c: F.avg((F.size(f"s.{c}") == 0).cast("int")).alias(f"empty_{c}")
    return s.agg(empty("sink_apis"), empty("guards"), empty("clues"), F.avg((~F.exists("s.memory", lambda x: x)).cast("int")).alias("empty_memory"))


@query("random_pair_similarity")
def random_pair_similarity(spark, d):
    """Signature similarity of random pairs: each function with the one at its place in an order by hash."""
    signed = _signed(spark, d)
    n = read(spark, d, "documents").count()
    partner = F.pmod(F.xxhash64("id"), F.lit(max(1, n)))
    both = signed.withColumn("other", partner).join(signed.select(F.col("id").alias("other"), F.col("s").alias("t")), "other").filter("id <> other")
    sim = both.select(G.signature_similarity("s", "t").alias("x"))
    return sim.agg(F.count("*").alias("pairs"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("median"), F.round(F.avg((F.col("x") >= 0.5).cast("int")), 6).alias("above_half"))


@query("older_features")
def older_features(spark, d):
    rows = codes(spark, d).select("id", G.older_features("code").alias("f"))
    joined = lambda c: F.array_join(F.col(f"f.{c}").cast("array<string>"), ",").alias(c)
    return rows.select("id", joined("apis"), joined("guards"), joined("memory"), F.size("f.inputs").alias("n_inputs"))


@query("older_similarity")
def older_similarity(spark, d):
    rows = codes(spark, d).select("id", G.older_features("code").alias("f"))
    both = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("f").alias("g")), "id")
    return both.select("id", F.round(G.older_similarity("f", "g"), 6).alias("similarity"))


#: Ids whose functions are put side by side in one task, and those ahead of them that the task also needs.
SIDE, AHEAD = 64, (1, 2, 3, 4)


def _specs(spark, d, caps: dict | None = None):
    """A spec for each function: its statements are nodes, the next four functions its demonstrations and donor.

    A function is moved once, and again to the block before if it is among the first of its block. Demonstrations are cut
    as render cuts them, which its own cut and the shorter ones of controls leave as they are. With the caps of layouts,
    only what they show of a function leaves its scanner: nodes and edges are the first ones, n_nodes and n_edges count all.
    """
    rows = heads(spark, d, caps["target"], caps["demo"], caps["nodes"]) if caps else codes(spark, d)
    kept, func = (["code", "lines", "n_lines"], F.col("func")) if caps else (["code"], T.fit_tokens(F.trim("code"), prompts.BUDGET["demo"]))
    uid, target = F.concat(F.lit("u"), F.col("id").cast("string")), F.pmod("id", F.lit(2)).cast("int")
    block = F.floor(F.col("id") / SIDE)
    demo = F.struct(uid.alias("function_uid"), func.alias("func"), target.alias("target"))
    # A place is (block, whether the row is there for itself); the copy for the block before holds no code.
    places = F.when(F.pmod("id", F.lit(SIDE)) < max(AHEAD), F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block - 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))
    rows = rows.withColumn("at", F.explode(places)).select("id", "at.block", "at.own", *[F.when(F.col("at.own"), F.col(c)).alias(c) for c in kept], demo.alias("demo"))
    order = W.partitionBy("block").orderBy("id")
    near = {f"d{k}": F.when(F.col("id").isNotNull(), F.first("demo").over(order.rangeBetween(k, k))) for k in AHEAD}
    # A number of partitions, so that adaptive execution doesn't gather small rows that cost much to render.
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "block").withColumns(near).filter("own").drop("block", "own", "demo")
    lines = F.col("lines") if caps else F.filter(F.split("code", "\n"), lambda x: F.trim(x) != "")
    kind = lambda x: F.when(x.startswith("#"), "Directive").when(x.contains("if ("), "IfStatement").when(x.rlike(r"\w\("), "CallExpression").otherwise("Statement")
    nodes = F.transform(lines, lambda x, i: F.struct(i.cast("string").alias("id"), kind(x).alias("type"), x.alias("code")))
    n_nodes = F.col("n_lines") if caps else F.size("nodes")
    # A function has two lines at least: its first and its last.
    n_edges = n_nodes - 1
    edges = F.transform(F.sequence(F.lit(1), F.least(n_edges, F.lit(caps["edges"])) if caps else n_edges), lambda i: F.struct((i - 1).cast("string").alias("start"), i.cast("string").alias("end"), F.lit("REACHES").alias("type")))
    rows = rows.withColumn("nodes", nodes)
    pair = F.when(F.col("d2").isNotNull() & F.col("d3").isNotNull(), F.array(F.when(F.col("d2.target") == 1, F.col("d2")).otherwise(F.col("d3")), F.when(F.col("d2.target") == 1, F.col("d3")).otherwise(F.col("d2"))))
    text = F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Only the Vulnerable one is unsafe at line "), n_nodes.cast("string")))
    counts = [n_nodes.alias("n_nodes"), n_edges.alias("n_edges")] if caps else []
    return rows.select("id", F.col("code").alias("query_code"), "nodes", edges.alias("edges"), F.array_compact(F.array("d1")).alias("demonstrations"), F.coalesce(pair, F.slice(F.array("d2"), 1, 0)).alias("demonstrations_pair"), text.alias("security_difference"), F.concat(F.lit("Sink memcpy (buffer_write) in "), F.substring_index("code", "(", 1)).alias("h2_evidence"), F.col("d4").alias("donor"), *counts)


@query("arm_prompts")
def arm_prompts(spark, d):
    return prompts.render(_specs(spark, d)).select("id", "arm", "prompt_sha256", "tokens", "over_budget")


@query("arm_block_changes")
def arm_block_changes(spark, d):
    rendered = prompts.render(_specs(spark, d))
    return prompts.changed_blocks(rendered, "B2", "B2-flip").select("id", F.array_join("changed", ",").alias("changed"))


def _samples(spark, d, caps: dict | None = None):
    rows, counts = _specs(spark, d, caps), ["n_nodes", "n_edges"] if caps else []
    n_nodes = F.col("n_nodes") if caps else F.size("nodes")
    pair = F.when(F.size("demonstrations_pair") == 2, F.col("demonstrations_pair")).otherwise(F.col("demonstrations"))
    clue = F.when(F.pmod("id", F.lit(3)) == 0, F.lit("")).otherwise(F.concat(F.lit("checks len before memcpy in statement "), n_nodes.cast("string")))
    return rows.select("id", "query_code", "nodes", "edges", *counts, pair.alias("demonstrations"), F.array_compact(F.array("donor", F.get("demonstrations", F.lit(0)))).alias("random_demonstrations"), clue.alias("security_difference"))


@query("prompt_modes")
def prompt_modes(spark, d):
    """Every layout of every sample."""
    return controls.prompts(_samples(spark, d, controls.CAPS)).select("id", "mode", F.sha2("prompt", 256).alias("prompt_sha256"), F.char_length("prompt").alias("chars"))


@query("control_prompts_v1")
def control_prompts_v1(spark, d):
    return controls.render_controls(_samples(spark, d), "v1").select("id", "condition", "problem", F.sha2("prompt", 256).alias("prompt_sha256"), "rendered_nodes", "rendered_edges")


@query("control_prompts_v2")
def control_prompts_v2(spark, d):
    return controls.render_controls(_samples(spark, d), "v2").select("id", "condition", "problem", F.sha2("prompt", 256).alias("prompt_sha256"), "rendered_nodes", "rendered_edges")


@query("payload_plan_violations")
def payload_plan_violations(spark, d):
    """A plan made by the renderer, with faults by id: another prompt, hash, pool, repeated candidate and token count."""
    specs = _samples(spark, d).withColumn("arm", F.lit("B3"))
    named = specs.withColumn("demo_uids", F.transform("demonstrations", lambda x: x["function_uid"]))
    rendered = controls.render_controls(named, keep=("demo_uids",)).filter("problem is null")
    fault = F.pmod("id", F.lit(10))
    pool = F.concat("demo_uids", F.array(F.lit("x"), F.when(fault == 3, F.lit("x")).otherwise(F.lit("y"))))
    items = rendered.select(
        F.concat_ws(":", F.col("id").cast("string"), "condition").alias("item_id"), "id", F.lit("B3").alias("arm"), "condition", F.when(fault == 1, F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt")).alias("prompt"),
        F.when(fault == 2, F.lit("0")).otherwise(F.col("target_sha256")).alias("target_sha256"), F.when(fault == 4, F.slice(pool, 2, 9)).otherwise(pool).alias("candidate_ids"), "demo_uids", (T.approx_tokens("prompt") + F.when(fault == 5, 1).otherwise(0)).alias("tokens"),
    )
    found = controls.plan_violations(items, specs)
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("mock_arm_run")
def mock_arm_run(spark, d):
    scored = prompts.render(_specs(spark, d)).withColumn("s", prompts.mock_score("prompt"))
    return scored.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_s"), F.count_if(T.leaks("prompt")).alias("leaks"))


@query("paired_bootstrap")
def paired_bootstrap(spark, d):
    return resample.paired_bootstrap(records(spark, d), "y", "pred_a", "pred_b", "id", "mcc", 5000, ["dataset"])


@query("cluster_bootstrap")
def cluster_bootstrap(spark, d):
    return resample.paired_bootstrap(records(spark, d), "y", "pred_a", "pred_b", "grp", "balanced_accuracy", 5000)


@query("stage_bootstrap_zero")
def stage_bootstrap_zero(spark, d):
    """The variant that takes an undefined metric as 0."""
    return resample.paired_bootstrap(records(spark, d), "y", "pred_a", "pred_c", "id", "mcc", 2000, undefined=0.0)


@query("random_experts")
def random_experts(spark, d):
    return resample.random_experts(records(spark, d), "y", "id", 0.4)


@query("contrast_table")
def contrast_table(spark, d):
    return diagnostic.contrast_table(records(spark, d), {"a_b": ("pred_a", "pred_b"), "a_c": ("pred_a", "pred_c")})


@query("two_split_diagnostic")
def two_split_diagnostic(spark, d):
    rec = records(spark, d)
    return diagnostic.two_split(rec.filter("split <> 'test'"), rec.filter("split = 'test'"))


@query("single_split_diagnostic")
def single_split_diagnostic(spark, d):
    return diagnostic.single_split(records(spark, d))


@query("out_of_fold_scores")
def out_of_fold_scores(spark, d):
    rows = ml.out_of_fold(diagnostic.features(records(spark, d)), diagnostic.PRE + diagnostic.POST)
    return rows.select("id", "fold", F.round("oof", 6).alias("oof"))


@query("benefit_router")
def benefit_router(spark, d):
    rows = diagnostic.features(records(spark, d)).withColumn("g", (F.col("p_gate") >= 0.5).cast("int")).withColumn("h", (F.col("s") >= 0.5).cast("int"))
    rows = rows.withColumn("gain", ((F.col("h") == F.col("y")).cast("int") - (F.col("g") == F.col("y")).cast("int")).cast("double"))
    return ml.benefit_router(rows, ["lg", "s_or_half", "diff"], "gain", "valid").select("id", F.round("rank_score", 6).alias("rank_score"))


@query("supervised_anchor_mlp")
def supervised_anchor_mlp(spark, d):
    rows = diagnostic.features(records(spark, d))
    return ml.anchor_mlp(rows.filter("split <> 'test'"), rows.filter("split = 'test'"), ["lg", "s_or_half", "diff"], "y").select("id", F.round("s_mlp", 6).alias("s_mlp"))


@query("tfidf_embeddings")
def tfidf_embeddings(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = ml.tfidf(read(spark, d, "documents").select("doc_id", "text"))
    x = vector_to_array("features")
    return rows.select("doc_id", F.round(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)), 6).alias("norm"), F.size(F.filter(x, lambda v: v > 0)).alias("terms"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return runs.windowed_counts(read(spark, d, "events")).withColumn("total", F.round("total", 6))


@query("code_pair_rubric")
def code_pair_rubric(spark, d):
    """Weighted relevance of neighbours by shared signature features, guards and identifiers."""
    rows = _signed(spark, d, F.array_distinct(F.regexp_extract_all("code", F.lit(r"\b([a-zA-Z_]\w*)\b"), 1)).alias("ids"))
    both = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("s").alias("t"), F.col("ids").alias("jds")), "id")
    feats, guards, names = F.size(F.array_intersect("s.sink_categories", "t.sink_categories")), F.size(F.array_intersect("s.guards", "t.guards")), F.size(F.array_intersect("ids", "jds"))
    hit = lambda x: F.when(x, 1.0).otherwise(0.0)
    score = hit(feats > 0) * 2.5 + hit(guards > 0) * 2.0 + hit(names >= 2) * 1.5 + feats + guards + F.least(names, F.lit(5)) * 0.2
    return both.select("id", F.round(score, 4).alias("relevance"))


@query("graph_similarity")
def graph_similarity(spark, d):
    """Outline similarity of the graphs of neighbouring orders."""
    from .tables import graph_outlines

    g = graph_outlines(spark, d)
    near = g.select((F.col("id") - 1).alias("id"), F.col("outline").alias("other"))
    return g.join(near, "id").select("id", F.round(R.outline_similarity("outline", "other"), 6).alias("similarity"))


@query("skeleton_graphs")
def skeleton_graphs(spark, d):
    """Sizes and types of the skeleton graph of every function."""
    rows = codes(spark, d).select("id", skeleton("code").alias("g"))
    types = F.transform(F.col("g.nodes"), lambda n: n["type"])
    flows = F.size(F.filter("g.edges", lambda e: e["type"] == "FLOWS_TO"))
    return rows.select("id", F.size("g.nodes").alias("nodes"), F.size("g.edges").alias("edges"), flows.alias("flows"), F.sha2(F.array_join(types, ","), 256).alias("types_sha256"))


@query("gold_annotation_ordinals")
def gold_annotation_ordinals(spark, d):
    """Occurrence ordinals of each name in a text, with stated occurrences left out."""
    rows = E.call_sites(codes(spark, d), "api", "status", "start", "end").filter("status <> 'excluded_inactive'")
    rows = rows.withColumn("ordinal", F.row_number().over(W.partitionBy("id", "api").orderBy("start")))
    left_out = spark.createDataFrame([("free", 1)], "api string, ordinal int")
    return rows.join(F.broadcast(left_out), ["api", "ordinal"], "left_anti").select("id", "api", "ordinal", "start", "end")
