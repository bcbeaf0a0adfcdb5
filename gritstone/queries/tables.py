"""Reshaping, identity joins, reconciliation, sampling, graphs, run state and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators import tables as B

from ._bind import REC, SAMPLES, h8, h8_sql, query, read, records, samples, u, u_sql

_UNPIVOT = "WITH " + REC + ", w AS (SELECT id, y AS target, pred_a AS a, pred_b AS b, pred_c AS c FROM rec), n AS (SELECT id, target, CASE s WHEN 'a' THEN 'original' WHEN 'b' THEN 'label_flip' ELSE 'repeat_original' END AS condition, p AS prediction, p IS NOT NULL AS is_valid FROM w UNPIVOT INCLUDE NULLS (p FOR s IN (a, b, c)))"


def _long(spark, d):
    return B.unpivot_records(records(spark, d).withColumnRenamed("y", "target"), "b2")


@query("normalize_records", f"{_UNPIVOT} SELECT id, target, 'b2' AS arm, condition, prediction, is_valid FROM n")
def normalize_records(spark, d):
    return _long(spark, d).drop("raw")


@query("paired_arm_join", f"WITH {REC} SELECT id, y, pred_a AS a, pred_b AS b FROM rec WHERE pred_a IS NOT NULL AND pred_b IS NOT NULL")
def paired_arm_join(spark, d):
    long = _long(spark, d).filter("is_valid")
    side = lambda c, n: long.filter(F.col("condition") == c).select("id", F.col("target").alias("y"), F.col("prediction").alias(n))
    return side("original", "a").join(side("label_flip", "b"), ["id", "y"])


@query("three_arm_join", f"WITH {REC} SELECT id FROM rec WHERE pred_a IS NOT NULL AND pred_b IS NOT NULL AND pred_c IS NOT NULL")
def three_arm_join(spark, d):
    long = _long(spark, d).filter("is_valid")
    return long.groupBy("id").agg(F.countDistinct("condition").alias("k")).filter("k = 3").select("id")


@query("validity_mask", f"WITH {REC} SELECT id, pred_a IS NOT NULL AND pred_b IS NOT NULL AS both_valid FROM rec")
def validity_mask(spark, d):
    from gritstone.functions.metrics import valid

    return records(spark, d).select("id", (valid("pred_a") & valid("pred_b")).alias("both_valid"))


@query("gate_expert_join", f"WITH {REC} SELECT id, y, round(p_gate, 9) AS p_gate, round(CASE WHEN valid THEN s ELSE 0.5 END, 9) AS s_llm, valid::INT AS valid, grp AS \"group\" FROM rec WHERE {h8_sql('id', 'has')} % 10 <> 0")
def gate_expert_join(spark, d):
    """Alias-resolved gate rows joined to alias-resolved expert rows; duplicates of an id keep the last."""
    rec = records(spark, d)
    gate = B.resolve(rec.select(F.col("id").alias("Record_ID"), F.col("y").alias("Target"), F.col("p_gate").alias("prob"), F.col("grp").alias("project")), {"id": ["id", "record_id"], "y": ["y", "target", "label"], "p": ["p_gate", "p", "prob"], "group": ["group", "project"]}, ["id", "y", "p"])
    expert = rec.filter(F.pmod(h8("id", "has"), F.lit(10)) != 0).select("id", F.when(F.col("valid"), F.col("s").cast("string")).otherwise("n/a").alias("prediction"), F.lit(1).alias("pos"))
    expert = B.last_of_each(expert.unionByName(expert.limit(5).withColumn("pos", F.lit(0))), "id", "pos")
    s, ok = B.expert_score(F.col("prediction"))
    return gate.join(expert, "id").select("id", "y", F.round("p", 9).alias("p_gate"), F.round(s, 9).alias("s_llm"), ok.cast("int").alias("valid"), "group")


@query("expert_alias_scores", f"WITH {REC} SELECT id, CASE id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS s, id % 4 <> 3 AS valid FROM rec")
def expert_alias_scores(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Vulnerable", "safe", "0.25", "??")]), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    s, ok = B.expert_score(F.lit(None).cast("string"), raw)
    return records(spark, d).select("id", s.alias("s"), ok.alias("valid"))


@query("canonical_join_csv", f"WITH {REC} SELECT id, y, printf('%.6f', p_gate) AS p_gate, printf('%.6f', CASE WHEN valid THEN s ELSE 0.5 END) AS s_llm, valid::INT AS valid FROM rec")
def canonical_join_csv(spark, d):
    s = F.when(F.col("valid"), F.col("s")).otherwise(F.lit(0.5))
    return records(spark, d).select("id", "y", F.format_string("%.6f", "p_gate").alias("p_gate"), F.format_string("%.6f", s).alias("s_llm"), F.col("valid").cast("int").alias("valid"))


@query("ragged_union", f"WITH {REC} SELECT id, y, NULL::DOUBLE AS s FROM rec WHERE id % 2 = 0 UNION ALL BY NAME SELECT id, s FROM rec WHERE id % 2 = 1")
def ragged_union(spark, d):
    rec = records(spark, d)
    return rec.filter("id % 2 = 0").select("id", "y").unionByName(rec.filter("id % 2 = 1").select("id", "s"), allowMissingColumns=True)


@query("latex_rows", f"WITH {REC} SELECT dataset, dataset || ' & ' || printf('%.3f', avg(s)) || ' & ' || COALESCE(printf('%.3f', avg(CASE WHEN z > 1 THEN s END)), 'N/A') || ' \\\\' AS line FROM rec GROUP BY dataset")
def latex_rows(spark, d):
    fmt = lambda c: F.coalesce(F.format_string("%.3f", c), F.lit("N/A"))
    rows = records(spark, d).groupBy("dataset").agg(F.avg("s").alias("a"), F.avg(F.when(F.col("z") > 1, F.col("s"))).alias("b"))
    b = F.when(F.col("b").isNull(), "N/A").otherwise(fmt(F.col("b")))
    return rows.select("dataset", F.concat("dataset", F.lit(" & "), fmt(F.col("a")), F.lit(" & "), b, F.lit(" \\\\")).alias("line"))


@query("report_json", f"WITH {REC} SELECT dataset, '{{\"n\":' || count(*) || ',\"pos\":' || sum(y) || ',\"undefined\":null}}' AS report FROM rec GROUP BY dataset")
def report_json(spark, d):
    nan = F.lit(float("nan"))
    body = F.struct(F.col("n"), F.col("pos"), F.nanvl(nan, F.lit(None).cast("double")).alias("undefined"))
    return records(spark, d).groupBy("dataset").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).select("dataset", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


@query("anchor_label_join", f"WITH {REC} SELECT r.id, r.y AS label FROM rec r WHERE dataset IN ('en', 'de')")
def anchor_label_join(spark, d):
    rec = records(spark, d)
    labels = rec.filter(F.col("dataset").isin("en", "de")).select("dataset", "split", "id", F.col("y").alias("label"))
    return rec.join(labels, ["dataset", "split", "id"], "left").filter("label is not null").select("id", "label")


@query("exact_set_alignment", f"WITH {REC}, l AS (SELECT id, y FROM rec WHERE id % 11 <> 0), r AS (SELECT id, CASE WHEN id % 13 = 0 THEN 1 - y ELSE y END AS y FROM rec WHERE id % 17 <> 0) SELECT count(*) FILTER (r.id IS NULL) AS missing, count(*) FILTER (l.id IS NULL) AS extra, count(*) FILTER (l.y <> r.y) AS conflicts, count(*) FILTER (l.id IS NOT NULL AND r.id IS NOT NULL) AS matched FROM l FULL JOIN r ON l.id = r.id")
def exact_set_alignment(spark, d):
    rec = records(spark, d).select("id", "y")
    right = rec.filter("id % 17 <> 0").withColumn("y", F.when(F.col("id") % 13 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    return B.align_exactly(rec.filter("id % 11 <> 0"), right, "id", ["y"])


@query("exactly_one_match", f"WITH {SAMPLES}, h AS (SELECT sha256(text) AS h, label, count(*) AS n FROM samples GROUP BY 1, 2) SELECT count(*) FILTER (n = 1) AS unique_keys, count(*) FILTER (n > 1) AS ambiguous FROM h")
def exactly_one_match(spark, d):
    n = samples(spark, d).groupBy(T.sha("text").alias("h"), "label").count()
    return n.agg(F.count_if(F.col("count") == 1).alias("unique_keys"), F.count_if(F.col("count") > 1).alias("ambiguous"))


@query("lookup_by_keys", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'id' WHEN doc_id % 3 = 1 THEN 'raw' END AS found FROM documents")
def lookup_by_keys(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("a"), F.when(F.col("doc_id") % 3 == 1, F.col("doc_id")).alias("b"))
    table = read(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("a"), F.when(F.col("doc_id") % 3 == 1, F.col("doc_id")).alias("b"), F.when(F.col("doc_id") % 3 == 0, "id").otherwise("raw").alias("found"))
    return B.lookup_chain(docs, table.filter("a is not null or b is not null"), ["a", "b"], "found").select("doc_id", "found")


@query("rater_join", f"WITH {REC} SELECT id, y AS rater_1, z AS rater_2, y = z AS agree FROM rec")
def rater_join(spark, d):
    labels = read(spark, d, "labels")
    key = read(spark, d, "documents").select("doc_id")
    r1, r2 = labels.select("doc_id", F.col("quality").cast("int").alias("rater_1")), labels.select("doc_id", F.col("toxic").cast("int").alias("rater_2"))
    return key.join(r1, "doc_id", "left").join(r2, "doc_id", "left").filter("rater_1 is not null").select(F.col("doc_id").alias("id"), "rater_1", "rater_2", (F.col("rater_1") == F.col("rater_2")).alias("agree"))


@query("fill_missing_join", f"WITH {REC} SELECT id, CASE WHEN id % 3 = 0 THEN 'fill' ELSE 'history' END AS origin, COALESCE(CASE WHEN id % 3 <> 0 THEN pred_a END, CASE WHEN id % 3 = 0 THEN pred_b END, -1) AS prediction FROM rec")
def fill_missing_join(spark, d):
    rec = records(spark, d)
    history, fill = rec.filter("id % 3 <> 0").select("id", F.coalesce("pred_a", F.lit(-1)).alias("h")), rec.filter("id % 3 = 0").select("id", F.coalesce("pred_b", F.lit(-1)).alias("f"))
    rows = rec.select("id").join(history, "id", "left").join(fill, "id", "left")
    return rows.select("id", F.when(F.col("h").isNotNull(), "history").otherwise("fill").alias("origin"), F.coalesce("h", "f").alias("prediction"))


_CELL = "CASE WHEN y = 1 AND pred_a = 0 AND pred_b = 1 THEN 'FN_repaired' WHEN y = 1 AND pred_a = 1 AND pred_b = 0 THEN 'FN_created' WHEN y = 0 AND pred_a = 1 AND pred_b = 0 THEN 'FP_repaired' WHEN y = 0 AND pred_a = 0 AND pred_b = 1 THEN 'FP_created' END"


@query("discordance_packets", f"WITH {REC}, c AS (SELECT id, {_CELL} AS cell FROM rec) SELECT cell, id, substr(sha256('blind:' || id), 1, 12) AS blind_id FROM c WHERE cell IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell ORDER BY sha256('packets:' || id), id) <= 15")
def discordance_packets(spark, d):
    y, a, b = F.col("y"), F.col("pred_a"), F.col("pred_b")
    cell = F.when((y == 1) & (a == 0) & (b == 1), "FN_repaired").when((y == 1) & (a == 1) & (b == 0), "FN_created").when((y == 0) & (a == 1) & (b == 0), "FP_repaired").when((y == 0) & (a == 0) & (b == 1), "FP_created")
    rows = records(spark, d).select("id", cell.alias("cell")).filter("cell is not null")
    return B.sample_per_group(rows, "id", ["cell"], 15, "packets").select("cell", "id", T.sha(F.concat(F.lit("blind:"), F.col("id").cast("string")), 12).alias("blind_id"))


@query("value_reconciliation", f"WITH {REC}, m AS (SELECT dataset AS metric, round(avg(s), 6) AS v FROM rec GROUP BY 1), st AS (SELECT metric, CASE WHEN metric = 'en' THEN v + 0.001 ELSE v + 0.00005 END AS stored FROM m WHERE metric <> 'es') SELECT m.metric, CASE WHEN stored IS NULL THEN 'missing' WHEN abs(v - stored) > 5.1e-5 THEN 'conflict' ELSE 'ok' END AS status FROM m LEFT JOIN st USING (metric)")
def value_reconciliation(spark, d):
    m = records(spark, d).groupBy(F.col("dataset").alias("metric")).agg(F.round(F.avg("s"), 6).alias("v"))
    stored = m.filter("metric <> 'es'").select("metric", F.when(F.col("metric") == "en", F.col("v") + 0.001).otherwise(F.col("v") + 0.00005).alias("stored"))
    status = F.when(F.col("stored").isNull() | F.col("v").isNull(), "missing").when(F.abs(F.col("v") - F.col("stored")) > 5.1e-5, "conflict").otherwise("ok")
    return m.join(stored, "metric", "full_outer").select("metric", status.alias("status"))


@query("graph_band_join", "WITH q AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS n FROM documents WHERE doc_id % 100 = 0), dn AS (SELECT len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS m FROM documents), w AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE, 0.8::DOUBLE, 1.6::DOUBLE]) AS w), h AS (SELECT doc_id, w, count(*) AS n_donors, min(m) AS least, max(m) AS most FROM q, w, dn WHERE m >= floor(n * (1 - w)) AND m <= ceil(n * (1 + w)) GROUP BY doc_id, w) SELECT q.doc_id, h.w, n_donors, least, most FROM q LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w) = 1) h USING (doc_id)")
def graph_band_join(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.size(T.words("text")).cast("long").alias("n"))
    return B.band_join(rows.filter("doc_id % 100 = 0"), rows).select("doc_id", "w", "n_donors", "least", "most")


@query("interval_containment", "SELECT l_orderkey, l_linenumber, o_orderkey IS NOT NULL AS inside FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 90 DAY")
def interval_containment(spark, d):
    """Points in their key's intervals through day cells of 30: an equi-join, not a range scan."""
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    points = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", day("l_shipdate").alias("at"))
    spans = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("lo"), (day("o_orderdate") + 90 * 86400 * 1000000).alias("hi"))
    return B.interval_join(points, spans, 30 * 86400 * 1000000).select(F.col("key").alias("l_orderkey"), "l_linenumber", F.lit(True).alias("inside"))


@query("design_completeness", f"{_UNPIVOT}, g AS (SELECT id, c AS condition FROM (SELECT DISTINCT id FROM n), (SELECT unnest(['original', 'label_flip', 'repeat_original']) AS c)) SELECT (SELECT count(*) FROM g) AS planned, (SELECT count(*) FROM (SELECT id, condition FROM g EXCEPT SELECT id, condition FROM n WHERE is_valid)) AS missing, 0::BIGINT AS unplanned")
def design_completeness(spark, d):
    long = _long(spark, d)
    grid = long.select("id").distinct().withColumn("condition", F.explode(F.array(F.lit("original"), F.lit("label_flip"), F.lit("repeat_original"))))
    done = long.filter("is_valid").select("id", "condition")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(grid, "planned").crossJoin(n(grid.exceptAll(done), "missing")).crossJoin(n(done.exceptAll(grid), "unplanned"))


@query("collision_audit", f"WITH {SAMPLES}, g AS (SELECT sha256(text) AS h, count(DISTINCT id) AS ids, count(DISTINCT label) AS labels FROM samples GROUP BY 1) SELECT count(*) FILTER (ids > 1) AS shared_code, count(*) FILTER (labels > 1) AS both_labels, count(*) AS n FROM g")
def collision_audit(spark, d):
    g = samples(spark, d).groupBy(T.sha("text").alias("h")).agg(F.countDistinct("id").alias("ids"), F.countDistinct("label").alias("labels"))
    return g.agg(F.count_if(F.col("ids") > 1).alias("shared_code"), F.count_if(F.col("labels") > 1).alias("both_labels"), F.count("*").alias("n"))


@query("micro_set_precision_recall", f"WITH {REC}, x AS (SELECT dataset, {u_sql('id', 'gold')} < 0.6 AS g, {u_sql('id', 'found')} < 0.5 AS f FROM rec) SELECT dataset, count(*) FILTER (g AND f) AS tp, count(*) FILTER (f AND NOT g) AS fp, count(*) FILTER (g AND NOT f) AS fn, round(count(*) FILTER (g AND f)::DOUBLE / nullif(count(*) FILTER (f), 0), 9) AS precision, round(count(*) FILTER (g AND f)::DOUBLE / nullif(count(*) FILTER (g), 0), 9) AS recall FROM x GROUP BY dataset")
def micro_set_precision_recall(spark, d):
    rec = records(spark, d)
    gold = rec.filter(u("id", "gold") < 0.6).select("dataset", "id", F.lit(1).alias("g"))
    found = rec.filter(u("id", "found") < 0.5).select("dataset", "id", F.lit(1).alias("f"))
    c = lambda cond: F.count_if(cond)
    g, f = F.col("g").isNotNull(), F.col("f").isNotNull()
    out = gold.join(found, ["dataset", "id"], "full_outer").groupBy("dataset").agg(c(g & f).alias("tp"), c(f & ~g).alias("fp"), c(g & ~f).alias("fn"))
    tp = F.col("tp").cast("double")
    return out.withColumn("precision", F.round(F.try_divide(tp, F.col("tp") + F.col("fp")), 9)).withColumn("recall", F.round(F.try_divide(tp, F.col("tp") + F.col("fn")), 9))


@query("historical_remetric", "WITH x AS (SELECT l_returnflag AS run, (l_discount >= 0.05)::INT AS y, (l_tax >= 0.04)::INT AS p FROM lineitem), c AS (SELECT run, count(*) FILTER (y = p)::DOUBLE / count(*) AS acc FROM x GROUP BY run) SELECT run, round(acc, 6) AS accuracy, round(abs(acc - round(acc, 3)), 6) AS max_abs_diff FROM c")
def historical_remetric(spark, d):
    acc = F.avg(((F.col("l_discount") >= 0.05) == (F.col("l_tax") >= 0.04)).cast("int"))
    rows = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(acc.alias("acc"))
    return rows.select("run", F.round("acc", 6).alias("accuracy"), F.round(F.abs(F.col("acc") - F.round("acc", 3)), 6).alias("max_abs_diff"))


@query("unfinished_attempts", "SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events e WHERE event_type = (SELECT min(event_type) FROM events) AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = (SELECT max(event_type) FROM events) AND f.user_id = e.user_id AND f.ts >= e.ts) GROUP BY user_id")
def unfinished_attempts(spark, d):
    """Attempts (events of the first type) after which no event of the last type of their user follows."""
    e = read(spark, d, "events")
    kinds = e.agg(F.min("event_type").alias("opens"), F.max("event_type").alias("closes"))
    e = e.crossJoin(F.broadcast(kinds))
    closed = e.filter("event_type = closes").groupBy("user_id").agg(F.max("ts").alias("closed"))
    left = e.filter("event_type = opens").join(closed, "user_id", "left").filter("closed is null or ts > closed")
    return left.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("resume_filter", f"WITH {REC} SELECT id FROM rec WHERE NOT (split = 'train' AND id % 2 = 0)")
def resume_filter(spark, d):
    rec = records(spark, d)
    done = rec.filter((F.col("split") == "train") & (F.col("id") % 2 == 0)).select(F.lit("run-1").alias("run"), "id")
    return rec.select(F.lit("run-1").alias("run"), "id").join(done, ["run", "id"], "left_anti").select("id")


@query("response_cache_misses", "SELECT count(DISTINCT sha256(text)) AS misses FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0)")
def response_cache_misses(spark, d):
    keys = read(spark, d, "documents").select("doc_id", T.sha("text").alias("k"))
    return keys.join(keys.filter("doc_id % 4 = 0").select("k").distinct(), "k", "left_anti").agg(F.countDistinct("k").alias("misses"))


@query("arm_seed_matrix", f"WITH {REC} SELECT dataset, arm, seed, count(*) AS todo FROM rec, (SELECT unnest(['B0', 'B2', 'B3']) AS arm), (SELECT unnest([42, 43]) AS seed) WHERE NOT (arm = 'B0' AND id % 5 = 0) GROUP BY ALL")
def arm_seed_matrix(spark, d):
    specs = records(spark, d).select("id", "dataset").withColumn("arm", F.explode(F.array(F.lit("B0"), F.lit("B2"), F.lit("B3")))).withColumn("seed", F.explode(F.array(F.lit(42), F.lit(43))))
    done = records(spark, d).filter("id % 5 = 0").select("id", F.lit("B0").alias("arm"))
    return specs.join(done, ["id", "arm"], "left_anti").groupBy("dataset", "arm", "seed").agg(F.count("*").alias("todo"))


@query("test_readiness", f"WITH {REC}, locked AS (SELECT DISTINCT dataset FROM rec WHERE split = 'validation' AND dataset <> 'es') SELECT DISTINCT dataset FROM rec WHERE split = 'test' AND dataset NOT IN (SELECT dataset FROM locked)")
def test_readiness(spark, d):
    rec = records(spark, d)
    locked = rec.filter("split = 'validation' and dataset <> 'es'").select("dataset").distinct()
    return rec.filter("split = 'test'").select("dataset").distinct().join(locked, "dataset", "left_anti")


@query("record_validation", f"WITH {REC} SELECT count(*) = count(DISTINCT id) AS unique_ids, count(*) FILTER (y NOT IN (0, 1)) AS bad_truth, count(*) FILTER (pred_a NOT IN (0, 1)) AS bad_predictions FROM rec")
def record_validation(spark, d):
    return records(spark, d).agg((F.count("*") == F.countDistinct("id")).alias("unique_ids"), F.count_if(~F.col("y").isin(0, 1)).alias("bad_truth"), F.count_if(~F.col("pred_a").isin(0, 1)).alias("bad_predictions"))


@query("stratified_slice", f"WITH {REC}, q AS (SELECT y, greatest(1, floor(count(*) * 0.1::DOUBLE)) AS quota FROM rec GROUP BY y) SELECT id, y FROM rec JOIN q USING (y) QUALIFY row_number() OVER (PARTITION BY y ORDER BY sha256('slice:' || id), id) <= quota")
def stratified_slice(spark, d):
    return B.stratified(records(spark, d).select("id", "y"), "id", "y", 0.1, "slice").select("id", "y")


@query("balanced_sample_hash", f"WITH {REC}, s AS (SELECT id FROM rec QUALIFY row_number() OVER (PARTITION BY y ORDER BY sha256('42:' || id), id) <= 50) SELECT count(*) AS n, substr(sha256(string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR)), 1, 16) AS split_hash FROM s")
def balanced_sample_hash(spark, d):
    s = B.sample_per_group(records(spark, d).select("id", "y"), "id", ["y"], 50, "42")
    return s.agg(F.count("*").alias("n"), T.sha(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","), 16).alias("split_hash"))


@query("proportional_subset", f"WITH {REC}, c AS (SELECT dataset, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM rec) AS e FROM rec GROUP BY dataset), q AS (SELECT dataset, floor(e) + (row_number() OVER (ORDER BY e - floor(e) DESC, dataset) <= 100 - (SELECT sum(floor(e)) FROM c))::INT AS quota FROM c) SELECT dataset, id FROM rec JOIN q USING (dataset) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sha256('600:' || id), id) <= quota")
def proportional_subset(spark, d):
    return B.proportional(records(spark, d).select("id", "dataset"), "id", "dataset", 100, "600").select("dataset", "id")


@query("length_tertile_sample", "WITH x AS (SELECT doc_id, length(text) AS n, doc_id % 2 = 0 AS cut FROM documents), p AS (SELECT quantile_cont(n, 0.333) AS lo, quantile_cont(n, 0.667) AS hi FROM x), t AS (SELECT doc_id, cut, CASE WHEN n <= lo THEN 0 WHEN n <= hi THEN 1 ELSE 2 END AS tertile FROM x, p) SELECT doc_id, tertile, cut FROM t QUALIFY row_number() OVER (PARTITION BY tertile, cut ORDER BY sha256('audit:' || doc_id), doc_id) <= 5")
def length_tertile_sample(spark, d):
    x = read(spark, d, "documents").select("doc_id", F.char_length("text").alias("n"), (F.col("doc_id") % 2 == 0).alias("cut"))
    p = x.agg(F.percentile("n", F.lit(0.333)).alias("lo"), F.percentile("n", F.lit(0.667)).alias("hi"))
    t = x.crossJoin(F.broadcast(p)).withColumn("tertile", F.when(F.col("n") <= F.col("lo"), 0).when(F.col("n") <= F.col("hi"), 1).otherwise(2))
    return B.sample_per_group(t, "doc_id", ["tertile", "cut"], 5, "audit").select("doc_id", "tertile", "cut")


@query("per_target_choice", "SELECT doc_id, ((('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT + 42) % 4294967296) % 7 AS choice FROM documents")
def per_target_choice(spark, d):
    seed = F.pmod(F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") + 42, F.lit(4294967296))
    return read(spark, d, "documents").select("doc_id", F.pmod(seed, F.lit(7)).alias("choice"))


@query("blind_assignment", f"SELECT doc_id, CASE WHEN {h8_sql('doc_id', 'blind')} % 2 = 0 THEN 'A' ELSE 'B' END AS baseline_side FROM documents")
def blind_assignment(spark, d):
    return read(spark, d, "documents").select("doc_id", F.when(F.pmod(h8("doc_id", "blind"), F.lit(2)) == 0, "A").otherwise("B").alias("baseline_side"))


@query("fresh_sample", "WITH k AS (SELECT doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) AS h FROM documents), seen AS (SELECT DISTINCT h FROM k WHERE doc_id % 5 = 0) SELECT doc_id FROM k WHERE h NOT IN (SELECT h FROM seen) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 ORDER BY sha256('fresh:' || doc_id), doc_id LIMIT 50")
def fresh_sample(spark, d):
    k = read(spark, d, "documents").select("doc_id", T.sha(F.regexp_replace("text", r"\s+", "")).alias("h"))
    fresh = k.join(k.filter("doc_id % 5 = 0").select("h").distinct(), "h", "left_anti").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return fresh.orderBy(F.sha2(F.concat(F.lit("fresh:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(50).select("doc_id")


@query("row_cap", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def row_cap(spark, d):
    return read(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(100)


_GRAPH = "g AS (SELECT o_orderkey AS id, list({'id': l_linenumber::VARCHAR, 'type': l_returnflag, 'code': 'part ' || l_partkey} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nodes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"


def _graphs(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("id"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.struct(F.col("l_linenumber").cast("string").alias("id"), F.col("l_returnflag").alias("type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("code")).alias("node"))
    rows = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["node"]).alias("nodes"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("nodes")), lambda i: F.struct(F.element_at("nodes", i)["id"].alias("start"), F.element_at("nodes", F.pmod(i, F.size("nodes")) + 1)["id"].alias("end"), F.lit("REACHES").alias("type")))
    return rows.withColumn("edges", pairs)


def graph_outlines(spark, d):
    """id, outline of every graph: sizes and the types of its first 30 nodes; empty without nodes."""
    outline = F.when(F.size("nodes") == 0, "").otherwise(F.concat(F.lit("N:"), F.size("nodes").cast("string"), F.lit("_"), F.array_join(F.transform(F.slice("nodes", 1, 30), lambda n: n["type"]), "_"), F.lit("|E:"), F.size("edges").cast("string"), F.lit("|")))
    return _graphs(spark, d).select("id", outline.alias("outline"))


@query("compact_graph_bank", f"WITH {_GRAPH} SELECT id, len(nodes) AS num_nodes, least(len(nodes), 25) AS kept_nodes, least(len(nodes), 25) AS kept_edges, list_aggregate(list_transform(nodes[1:25], lambda n: length(n.code[1:40])), 'sum')::BIGINT AS code_chars FROM g")
def compact_graph_bank(spark, d):
    """25 nodes of 40 characters and the first 25 edges among them; the sizes before are kept."""
    nodes, edges = B.graph_prefix(F.col("nodes"), F.col("edges"), 25, 25)
    chars = F.aggregate(F.transform(nodes, lambda n: F.char_length(F.substring(n["code"], 1, 40))), F.lit(0).cast("long"), lambda a, x: a + x)
    return _graphs(spark, d).select("id", F.size("nodes").cast("long").alias("num_nodes"), F.size(nodes).cast("long").alias("kept_nodes"), F.size(edges).cast("long").alias("kept_edges"), chars.alias("code_chars"))


_NODE_LINE = "'Node ' || n.id || ': (' || n.type || ') ' || chr(39) || trim(n.code)[1:40] || CASE WHEN length(trim(n.code)) > 40 THEN '...' ELSE '' END || chr(39)"
_EDGE_LINES = "list_transform(range(1, len(nodes) + 1), lambda i: 'Edge: Node ' || nodes[i].id || ' -> REACHES -> Node ' || nodes[i % len(nodes) + 1].id)"


@query("graph_text", f"WITH {_GRAPH} SELECT id, 'The node information of the code snippet is as follows:' || chr(10) || array_to_string(list_transform(nodes, lambda n: {_NODE_LINE}), chr(10)) || chr(10) || 'The edge information of the code snippet is as follows:' || chr(10) || array_to_string({_EDGE_LINES}, chr(10)) AS text FROM g")
def graph_text(spark, d):
    """No graph of the tables has more than 25 nodes, so all of each is shown."""
    nodes, edges = B.graph_prefix(F.col("nodes"), F.col("edges"), 25, 25)
    return _graphs(spark, d).select("id", B.graph_text(nodes, edges).alias("text"))


@query(
    "positional_manifest_join",
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, 'uid-' || substr(sha256(text), 1, 12) AS uid FROM documents",
)
def positional_manifest_join(spark, d):
    """Rows attached to a manifest by place, code hash and id."""
    docs = read(spark, d, "documents").select("doc_id", T.sha("text").alias("code"))
    numbered = B.positions(docs, "doc_id")
    manifest = numbered.select("position", F.col("doc_id").alias("legacy_id"), F.col("code").alias("code_sha256"), F.concat(F.lit("uid-"), F.substring("code", 1, 12)).alias("uid"))
    return B.positional_join(numbered, manifest, {"doc_id": "legacy_id", "code": "code_sha256"}).select("doc_id", "position", "uid")


@query(
    "report_readiness",
    f"WITH {REC}, {_GRAPH}, m AS (SELECT dataset AS metric, round(avg((pred_a = y)::INT), 6) AS value FROM rec GROUP BY 1) SELECT 'edge_outside_shown_nodes' AS check, count(*) AS n, 0::BIGINT AS failed FROM g UNION ALL SELECT 'stored_metric_differs', count(*), count(*) FILTER (metric = 'en') FROM m UNION ALL SELECT 'demo_label_follows_target', count(*), count(*) FILTER (y = z) FROM rec",
)
def report_readiness(spark, d):
    """Stored metrics are the recomputed ones, but for one language."""
    rec = records(spark, d)
    metrics = rec.groupBy(F.col("dataset").alias("metric")).agg(F.round(F.avg((F.col("pred_a") == F.col("y")).cast("int")), 6).alias("value"))
    stored = metrics.select("metric", F.when(F.col("metric") == "en", F.col("value") + 0.01).otherwise(F.col("value")).alias("value"))
    return B.report_readiness(_graphs(spark, d), stored, metrics, rec.select(F.col("y").alias("target_label"), F.col("z").alias("demo_label")))


@query("review_adjudication", f"WITH {REC}, c AS (SELECT id, ['A', 'B', 'Equal', 'Neither'][1 + id % 4] AS f, ['A', 'B', 'Equal', 'Neither'][1 + (id + y) % 4] AS s, CASE WHEN id % 7 = 0 THEN 'Neither' END AS r FROM rec) SELECT id, f AS first_choice, s AS second_choice, COALESCE(r, f) AS choice, COALESCE(r, f) <> f AS changed, f = s AS agreed FROM c")
def review_adjudication(spark, d):
    rec = records(spark, d).select("id", "y")
    said = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("A", "B", "Equal", "Neither")]), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("func"))
    snippet = F.concat(F.rtrim(F.substring("func", 1, 200)), F.lit(" /* ... [cut] */"))
    one = rec.join(texts, "id").select("id", snippet.alias("snippet"), said(F.col("id")).alias("choice"))
    two = rec.join(texts, "id").select("id", F.replace(snippet, F.lit("\n"), F.lit("\r\n")).alias("snippet"), said(F.col("id") + F.col("y")).alias("choice"))
    revised = rec.filter("id % 7 = 0").select("id", F.lit("Neither").alias("choice"))
    return B.adjudicate(one, two, texts, revised)


@query("graph_cleanup", f"WITH {_GRAPH} SELECT id, array_to_string(list_transform(nodes, lambda n: n.id || ':' || COALESCE(nullif(n.type, 'R'), 'Node')), ',') AS cleaned FROM g")
def graph_cleanup(spark, d):
    clean = F.transform("nodes", lambda n: F.concat(n["id"], F.lit(":"), F.coalesce(F.nullif(n["type"], F.lit("R")), F.lit("Node"))))
    return _graphs(spark, d).select("id", F.array_join(clean, ",").alias("cleaned"))


@query("graph_tsv_scan", "SELECT l_orderkey AS id, count(*) AS nodes, count(*) FILTER (l_returnflag <> 'N') AS kept, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS types FROM lineitem GROUP BY l_orderkey")
def graph_tsv_scan(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("nodes"), F.count_if(F.col("l_returnflag") != "N").alias("kept"), F.array_join(F.array_sort(F.collect_list("l_returnflag")), "").alias("types"))


@query("plan_to_specs", f"{_UNPIVOT} SELECT id, min(CASE condition WHEN 'original' THEN id % 100 END) AS demo, list_sort(list(DISTINCT target))[1] AS label, count(*) AS items FROM n GROUP BY id")
def plan_to_specs(spark, d):
    return _long(spark, d).groupBy("id").agg(F.max_by(F.pmod("id", F.lit(100)), F.col("condition") == "original").alias("demo"), F.min("target").alias("label"), F.count("*").alias("items"))


@query("code_enrichment", "SELECT doc_id, COALESCE(CASE WHEN doc_id % 4 <> 0 THEN sha256(text) END, 'meta:' || substr(sha256(text), 1, 8)) AS code FROM documents")
def code_enrichment(spark, d):
    docs = read(spark, d, "documents")
    files = docs.filter("doc_id % 4 <> 0").select("doc_id", T.sha("text").alias("file_code"))
    meta = docs.select("doc_id", F.concat(F.lit("meta:"), T.sha("text", 8)).alias("meta_code"))
    return docs.select("doc_id").join(files, "doc_id", "left").join(meta, "doc_id", "left").select("doc_id", F.coalesce("file_code", "meta_code").alias("code"))


@query("donor_text_guard", "SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), 'vulnerab|ground truth|label')")
def donor_text_guard(spark, d):
    return read(spark, d, "documents").filter(~F.lower("text").rlike("vulnerab|ground truth|label")).select("doc_id")


@query("pinned_inputs", "SELECT item_id, sha256(text) AS digest FROM benchmark")
def pinned_inputs(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("prompt_audit_summary", "WITH x AS (SELECT lang AS arm, floor(length(text) / 4.0::DOUBLE + 0.999)::BIGINT AS t FROM documents) SELECT arm, count(*) AS n, round(avg(t), 6) AS tokens_mean, round(quantile_cont(t, 0.5), 6) AS tokens_p50, round(quantile_cont(t, 0.95), 6) AS tokens_p95, max(t) AS tokens_max, round(avg((t > 1024)::INT), 6) AS rate_truncated, bool_or(t = 0) AS any_empty FROM x GROUP BY arm")
def prompt_audit_summary(spark, d):
    x = read(spark, d, "documents").select(F.col("lang").alias("arm"), T.approx_tokens("text").alias("t"))
    return x.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("tokens_mean"), F.round(F.percentile("t", F.lit(0.5)), 6).alias("tokens_p50"), F.round(F.percentile("t", F.lit(0.95)), 6).alias("tokens_p95"), F.max("t").alias("tokens_max"), F.round(F.avg((F.col("t") > 1024).cast("int")), 6).alias("rate_truncated"), F.bool_or(F.col("t") == 0).alias("any_empty"))


@query("relevance_sheet_validation", f"WITH {REC} SELECT count(*) FILTER (y NOT IN (0, 1) OR z NOT IN (0, 1)) AS outside_vocabulary, count(*) = count(DISTINCT id) AS unique_ids, CASE WHEN count(y) = count(*) AND count(z) = count(*) THEN round(avg((y = z)::INT), 9) END AS agreement FROM rec")
def relevance_sheet_validation(spark, d):
    complete = (F.count("y") == F.count("*")) & (F.count("z") == F.count("*"))
    return records(spark, d).agg(F.count_if(~F.col("y").isin(0, 1) | ~F.col("z").isin(0, 1)).alias("outside_vocabulary"), (F.count("*") == F.countDistinct("id")).alias("unique_ids"), F.when(complete, F.round(F.avg((F.col("y") == F.col("z")).cast("int")), 9)).alias("agreement"))


@query("feature_row_lock", f"WITH {REC} SELECT count(*) AS n, count(*) FILTER (abs(p_gate - round(p_gate, 8)) > 1e-7) AS drifted FROM rec")
def feature_row_lock(spark, d):
    rec = records(spark, d).select("id", "p_gate")
    both = rec.join(rec.select("id", F.round("p_gate", 8).alias("stored")), "id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("p_gate") - F.col("stored")) > 1e-7).alias("drifted"))


@query("id_alignment", "SELECT bool_and(doc_id = rn - 1) AS aligned FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)")
def id_alignment(spark, d):
    ids = read(spark, d, "documents").select("doc_id")
    made = spark.range(ids.count()).select(F.col("id").alias("doc_id"), F.lit(True).alias("made"))
    return ids.join(made, "doc_id", "full_outer").agg(F.coalesce(F.bool_and(F.col("made").isNotNull() & F.col("doc_id").isNotNull()), F.lit(True)).alias("aligned"))


@query("failure_taxonomy", f"WITH {REC} SELECT CASE WHEN pred_a IS NULL THEN 'no_answer' WHEN id % 7 = 0 THEN 'same_demo' WHEN pred_a <> y THEN 'wrong' ELSE 'fine' END AS category, count(*) AS n FROM rec GROUP BY 1")
def failure_taxonomy(spark, d):
    fixed = spark.range(0, 7, 7).select(F.col("id").alias("m"), F.lit("same_demo").alias("named"))
    rows = records(spark, d).withColumn("m", F.pmod("id", F.lit(7))).join(F.broadcast(fixed), "m", "left")
    cat = F.when(F.col("pred_a").isNull(), "no_answer").when(F.col("named").isNotNull(), F.col("named")).when(F.col("pred_a") != F.col("y"), "wrong").otherwise("fine")
    return rows.groupBy(cat.alias("category")).agg(F.count("*").alias("n"))
