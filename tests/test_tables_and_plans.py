import pytest
from pyspark.sql import functions as F

from gritstone.operators import prompts, retrieval
from gritstone.operators import tables as B
from gritstone.sources import readers, sinks
from gritstone.streaming import runs


def test_unpivot_contracts(spark):
    wide = spark.createDataFrame([(1, 1, 1, None, 0, "r")], "id int, target int, pred_a int, pred_b int, pred_c int, raw_resp_a string")
    rows = {r.condition: r for r in B.unpivot_records(wide, "b3").collect()}
    assert set(rows) == {"original", "order_swap", "repeat_original"} and rows["original"].raw == "r"
    assert rows["order_swap"].prediction is None and not rows["order_swap"].is_valid and rows["order_swap"].raw is None
    for bad in ([(1, None, 1)], [(1, 1, 7)], [(1, 1, 1), (1, 1, 0)]):
        with pytest.raises(B.ContractError):
            B.unpivot_records(spark.createDataFrame(bad, "id int, target int, pred_a int"), "b2")
    with pytest.raises(B.ContractError):
        B.unpivot_records(spark.createDataFrame([(1, 1)], "id int, target int"), "b2")


def test_aliases_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 0.5)], "Record_ID int, PROB double")
    assert B.resolve(df, {"id": ["id", "record_id"], "p": ["p", "prob"]}, ["id", "p"]).columns == ["id", "p"]
    with pytest.raises(B.ContractError):
        B.resolve(df, {"y": ["y"]}, ["y"])


def test_expert_words(spark):
    raw = spark.createDataFrame([("Vulnerable",), ("safe",), ("0.7",), ("?",), (None,)], "r string")
    s, ok = B.expert_score(F.col("r"))
    assert [tuple(r) for r in raw.select(s, ok).collect()] == [(1.0, True), (0.0, True), (0.7, True), (0.5, False), (0.5, False)]


def test_interval_join_equals_a_range_join(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 5, 25), (2, 3, 4)], "key int, lo int, hi int")
    points = spark.createDataFrame([(1, t) for t in (0, 5, 9, 10, 24, 25)] + [(2, 3), (2, 4)], "key int, at int")
    got = sorted((r.key, r.at, r.lo) for r in B.interval_join(points, spans, 7).collect())
    assert got == [(1, 0, 0), (1, 5, 0), (1, 5, 5), (1, 9, 0), (1, 9, 5), (1, 10, 5), (1, 24, 5), (2, 3, 3)]


def test_band_join_widens_until_something_fits(spark):
    q, d = spark.createDataFrame([(1, 10), (2, 1)], "id int, n int"), spark.createDataFrame([(15,), (1000,)], "n int")
    got = {r.id: r for r in B.band_join(q, d).collect()}
    assert got[1].w == 0.8 and got[1].n_donors == 1 and got[2].w is None


def test_samplers_are_stable_and_sized(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    a = {r.id for r in B.stratified(df, "id", "y", 0.1, "s").collect()}
    b = {r.id for r in B.stratified(df.repartition(7), "id", "y", 0.1, "s").collect()}
    assert a == b and len(a) == 2 + 7
    assert B.proportional(df, "id", "y", 10, "s").count() == 10


def test_graph_prefix_is_closed(spark):
    df = spark.createDataFrame([([("1", "A", "a"), ("2", "B", "b\n" + "x" * 50), ("3", "C", "")], [("1", "2", "E"), ("2", "3", "E")])], "nodes array<struct<id:string,type:string,code:string>>, edges array<struct<start:string,end:string,type:string>>")
    nodes, edges = B.graph_prefix(F.col("nodes"), F.col("edges"), 2, 5)
    row = df.select(nodes.alias("n"), edges.alias("e"), B.graph_text(nodes, edges).alias("t"), B.graph_text(F.col("nodes"), F.slice("edges", 1, 0)).alias("u")).first()
    assert len(row.n) == 2 and [(e.start, e.end) for e in row.e] == [("1", "2")]
    assert row.t.split("\n") == [B.NODE_HEAD, "Node 1: (A) 'a'", "Node 2: (B) 'b " + "x" * 38 + "...'", B.EDGE_HEAD, "Edge: Node 1 -> E -> Node 2"]
    assert row.u.split("\n")[3:] == ["Node 3: (C)", B.EDGE_HEAD, B.NO_EDGES]


def test_fitting_nodes_is_the_largest_prefix(spark):
    import random

    rng = random.Random(2)
    rows = []
    for g in range(12):
        nodes = [(str(i), "T" * rng.randint(1, 9), "c" * rng.randint(0, 60)) for i in range(rng.randint(1, 14))]
        edges = [(str(rng.randrange(16)), str(rng.randrange(16)), "E") for _ in range(rng.randint(0, 20))]
        rows.append((g, nodes, edges))
    df = spark.createDataFrame(rows, "g int, nodes array<struct<id:string,type:string,code:string>>, edges array<struct<start:string,end:string,type:string>>")
    for budget in (150, 400, 900):
        got = {r.g: r.k for r in df.select("g", B.fitting_nodes(F.col("nodes"), F.col("edges"), budget).alias("k")).collect()}
        for g, nodes, edges in rows:
            fits = [k for k in range(1, len(nodes) + 1) if spark_text_length(nodes[:k], edges) <= budget]
            assert got[g] == max(fits, default=1)


def spark_text_length(nodes, edges):
    ids = {n[0] for n in nodes}
    lines = [f"Node {i}: ({t})" + (f" '{c[:40]}{'...' * (len(c) > 40)}'" if c else "") for i, t, c in nodes]
    inside = [f"Edge: Node {a} -> {t} -> Node {b}" for a, b, t in edges if a in ids and b in ids]
    return len("\n".join([B.NODE_HEAD, *lines, B.EDGE_HEAD, *(inside or [B.NO_EDGES])]))


def test_knn_distance_is_the_same_for_any_batch(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32) * 100
    x[50] = x[51] = x[7]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = base.filter("vec_id % 25 = 0")
    want = {i: sorted((float(np.sqrt(((x[i].astype(float) - x[j]) ** 2).sum())), j) for j in range(300) if j != i)[:9] for i in range(0, 300, 25)}
    for parts in (1, 7):
        got = {}
        for r in retrieval.knn(q, base.repartition(parts), 9).collect():
            got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
        assert {i: sorted(v) for i, v in got.items()} == want
    longer = spark.createDataFrame([(1, [3.0, 4.0, 12.0])], "vec_id long, embedding array<float>")
    assert retrieval.knn(spark.createDataFrame([(0, [3.0])], "vec_id long, embedding array<float>"), longer, 1).first().distance == pytest.approx(160**0.5)


def test_pairs_fall_back_to_the_first_rows_of_a_missing_label(spark):
    ranked = spark.createDataFrame([(1, 10, 1, 1, 0.9), (1, 11, 1, 2, 0.8), (2, 10, 1, 1, 0.9), (2, 12, 0, 2, 0.4)], "query_id long, vec_id long, label int, rank int, score double")
    base = spark.createDataFrame([(k, k % 2) for k in range(20)], "id long, label int")
    texts = spark.createDataFrame([(k, f"w{k} w{k + 1}") for k in range(20)], "id long, text string")
    got = {r.query_id: r for r in retrieval.contrastive_pairs(ranked, texts, base=base).collect()}
    assert got[1].s_fallback and not got[1].v_fallback and (got[1].v, got[1].s) in {(10, 0), (10, 2), (10, 4), (10, 6), (10, 8), (11, 0)} and not got[2].s_fallback and got[2].s == 12
    assert [r.query_id for r in retrieval.contrastive_pairs(ranked, texts).collect()] == [2]


def test_knn_ties_keep_id_order_and_short_vectors_are_padded(spark):
    base = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(1, 52)] + [(99, [9.0, 9.0]), (100, [1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.l2_rank) for r in retrieval.knn(q, base, 50).orderBy("l2_rank").collect()]
    assert got == [(i, i) for i in range(1, 51)]
    assert retrieval.knn(q.limit(0), base, 5).count() == 0


def test_family_choice(spark):
    rows = [(1, 10, 1, ["a"], ["b"]), (1, 11, 2, ["b"], ["b"]), (2, 12, 1, ["a"], ["z"])]
    got = {r.query_id: (r.selected, r.reason) for r in retrieval.constrained_first(spark.createDataFrame(rows, "query_id int, vec_id int, rank int, families array<string>, query_families array<string>")).collect()}
    assert got == {1: (11, "moved_to_match"), 2: (12, "no_matching_candidate")}


def _spec(spark):
    demo = "struct<function_uid:string,func:string,target:int>"
    return spark.createDataFrame(
        [("1", "int f();", [("0", "A", "x"), ("1", "B", "y")], [("0", "1", "E")], [("u", "bad()", 1)], [("u", "bad()", 1), ("v", "good()", 0)], "the Vulnerable one is unsafe", "line 1", ("w", "other()", 0))],
        f"id string, query_code string, nodes array<struct<id:string,type:string,code:string>>, edges array<struct<start:string,end:string,type:string>>, demonstrations array<{demo}>, demonstrations_pair array<{demo}>, security_difference string, h2_evidence string, donor {demo}",
    )


@pytest.mark.parametrize("a,b,block", [("B0", "B1", "graph"), ("B1", "B1-shuf", "graph"), ("B1", "B1-H2", "graph"), ("B1", "B2", "demonstration"), ("B2", "B2-flip", "demonstration"), ("B2", "B2-rand", "demonstration"), ("B2", "B2-nolabel", "demonstration"), ("B3", "B3-swap", "demonstration"), ("B3", "B3-nodiff", "demonstration"), ("B3", "B3-flip", "demonstration")])
def test_each_probe_changes_one_block(spark, a, b, block):
    assert prompts.changed_blocks(prompts.render(_spec(spark)), a, b).first().changed == [block]


def test_repeat_changes_nothing_and_labels_are_refused(spark):
    rendered = prompts.render(_spec(spark))
    assert rendered.count() == 15 and prompts.changed_blocks(rendered, "B2", "B2-rep").first().changed == []
    with pytest.raises(B.ContractError):
        prompts.render(_spec(spark).withColumn("label", F.lit(1)))


def test_readers_and_sinks_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "func": "f", "target": 1}, {"id": "2", "func": "g{\\"}", "target": 0}]')
    assert readers.json_array(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "g.csv").write_text("Func_ID,Label,prob\nreveal:t:abc#1,1,0.5\nreveal:t:abc#1,0,0.7\n")
    gate = readers.gate_csv(spark, str(tmp_path / "g.csv")).collect()
    assert [(r.id, r.y, r.p, r.group) for r in gate] == [("reveal:t:abc#1", 0, 0.7, "abc")]
    sinks.report_json(spark.createDataFrame([(1, float("nan"))], "a int, b double"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a":1,"b":null}'
    assert "N/A" in sinks.latex_table(spark.createDataFrame([("x", None)], "a string, b double"), ["a", "b"])
    with pytest.raises(B.ContractError):
        readers.matrix(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2)


def test_journal_and_retries(spark):
    ok = spark.createDataFrame([("r", "k1")], "run string, key string")
    runs.check_journal(ok, ok.select("key"), "r")
    for records, events in ((ok, ok.union(spark.createDataFrame([("r", "k2")], "run string, key string"))), (ok.union(ok), ok)):
        with pytest.raises(B.ContractError):
            runs.check_journal(records, events.select("key"), "r")
    with pytest.raises(B.ContractError):
        runs.check_journal(ok, ok.select("key"), "other")
    assert runs.delays() == [5.0, 10.0, 20.0, 40.0]

    class Refused(Exception):
        status = 401

    def refuse():
        raise Refused

    def fail():
        raise OSError

    assert runs.with_retries(refuse)[2] == 1 and runs.with_retries(fail)[2] == 5 and runs.with_retries(lambda: 7)[0] == 7


def test_stream_resumes_without_repeats(spark, tmp_path):
    spark.range(10).withColumn("id", F.col("id").cast("long")).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        runs.run_stream(source, lambda b: b.withColumn("s", F.lit(0.5)), str(tmp_path / "out"), str(tmp_path / "cp"), "abc").awaitTermination()
    spark.range(8, 12).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    runs.run_stream(source, lambda b: b.withColumn("s", F.lit(0.5)), str(tmp_path / "out"), str(tmp_path / "cp"), "abc").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(12))
