"""Queries on rows that only larger tables hold."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from gritstone.functions import evidence as E
from gritstone.functions import text as T
from gritstone.operators import controls
from gritstone.queries import analysis, catalog
from gritstone.queries._code import _shown, code_of, codes


def test_label_free_ids_beyond_five_digits_equal_sql(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    rows = spark.range(0, 250_050, 2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("text"), F.lit("en").alias("lang"))
    rows.union(spark.createDataFrame([(None, "null id", "en"), (1, "other", "de")], "doc_id long, text string, lang string")).coalesce(2).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES["label_free_projection"]).fetchall())
    got = sorted(map(tuple, catalog.QUERIES["label_free_projection"](spark, str(tmp_path)).collect()))
    assert got == want and len(got) == 125_026


def test_call_sites_leave_a_worker_in_small_batches(spark):
    code = code_of(" ".join(f"word{i}" for i in range(600)))
    many = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([code] * 400)], ["id", "code"])
    out = list(E.batched(pa.int64(), E.SITES, E.evidence)([many]))
    assert len(out) > 4 and max(b.nbytes for b in out) < 8 << 20
    assert sum(b.num_rows for b in out) == 400 * len(E.evidence(code)) and out[0].column("expression")[0].as_py() == E.evidence(code)[0]["expression"]
    got = E.call_sites(spark.createDataFrame([(7, code), (8, None)], "id int, code string"), "api", "start").collect()
    assert [(r.id, r.api, r.start) for r in got] == [(7, e["api"], e["start"]) for e in E.evidence(code)]


def test_code_of_documents_has_a_statement_for_every_three_words(spark):
    assert code_of(None) == code_of(" \t") == "int helper_v_(char *buf, int len) {\n\n}\n"
    assert code_of("\u0130x ?! K{}").startswith("int helper_v_ix(") and code_of("%a {0} b").count("\n") >= 3




def test_evidence_texts(spark):
    shown = E.evidence_texts(spark.createDataFrame([(7, "void f() {\n free(p); }"), (8, None)], "id int, code string")).collect()
    assert {r.id: r.text for r in shown} == {7: "Sink free (pointer_free) at line 2: free(p)", 8: "No guarded sink evidence detected."}


def test_evidence_texts_are_made_by_one_worker_in_small_batches(spark, tmp_path):
    path = _texts(spark, tmp_path, range(30))
    df = catalog.QUERIES["evidence_text"](spark, path)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = E.evidence_texts(codes(spark, path)).collect()
    assert {r.id: r.text for r in df.collect()} == {r.id: r.text for r in want} and len({r.text for r in want}) > 5
    text = " ".join(f"word{i}" for i in range(600))
    many = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([text] * 1000)], ["id", "text"])
    long = lambda code: [{"text": code * 4}]
    out = list(E.batched(pa.int64(), {"text": pa.string()}, long, code_of)([many]))
    assert sum(b.num_rows for b in out) == 1000 and max(b.nbytes for b in out) < 3 << 20


def test_signatures_are_made_once_for_both_sides(spark, tmp_path):
    rows = [(k, "if a b memcpy " * (k % 5 + 1) + f"w{k}") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("signature_similarity", "code_pair_rubric", "random_pair_similarity"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        assert df.collect()
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("TableCacheQueryStage") == 2, name
    spark.catalog.clearCache()


def _texts(spark, tmp_path, ids):
    rows = [(k, "if a b memcpy c d " * (k % 7 + 1) + f"w{k}") for k in ids]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_specs_move_a_function_without_joins(spark, tmp_path):
    ids = [-5, -4, -2, 0, 1, 3, 254, 255, 256, 257, 258, 260, 262, 511, 516]
    df = analysis._specs(spark, _texts(spark, tmp_path, ids))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r for r in df.collect()}
    uid = lambda k: f"u{k}" if k in ids else None
    assert sorted(got) == ids
    for k, r in got.items():
        assert [d.function_uid for d in r.demonstrations] == ([uid(k + 1)] if uid(k + 1) else []) and (r.donor and r.donor.function_uid) == uid(k + 4)
        assert {d.function_uid for d in r.demonstrations_pair} == ({uid(k + 2), uid(k + 3)} if uid(k + 2) and uid(k + 3) else set())


def test_prompt_modes_move_only_what_layouts_show(spark, tmp_path):
    rows = [(k, " ".join(f"w{k}{i % 9}" for i in range(3 * (k % 90)))) for k in range(180)] + [(200, None), (201, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    path = str(tmp_path)
    few = analysis._samples(spark, path, controls.CAPS)
    most = few.agg(F.max(F.char_length("query_code")), F.max(F.size("nodes")), F.max("n_nodes")).first()
    assert most[0] == 3001 and most[1] == 25 < most[2]
    every = lambda samples: sorted(map(tuple, controls.prompts(samples).collect()))
    want = every(analysis._samples(spark, path))
    assert every(few) == want and len(want) == 182 * 8
    assert {tuple(r) for r in catalog.QUERIES["prompt_modes"](spark, path).select("id", "mode", "chars").collect()} == {(k, mode, len(p)) for k, mode, p in want}


def test_cut_texts_stay_longer_than_their_cap():
    for text, want in (("ab c", "ab c"), ("abc d", "abc ."), (" abcde ", "abcd."), ("abcd   ", "abcd"), ("", "")):
        assert _shown(text, 4) == want


def test_leaks_are_found_where_a_word_of_a_leak_is(spark):
    said = [("a LABEL \n: 1", True), ("labelled", False), ("Ground - Truth", True), ("the target is non-vulnerable", True), ("the target is safe", False), ("none", False), (None, None)]
    assert [r[0] for r in spark.createDataFrame(said, "p string, want boolean").select(T.leaks("p")).collect()] == [w for _, w in said]


def test_plans_and_arms_join_hashes_not_prompts(spark, tmp_path):
    d = _texts(spark, tmp_path, range(30))
    for name, n in (("arm_block_changes", 2), ("payload_plan_violations", 1)):
        df = catalog.QUERIES[name](spark, d)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("InMemoryRelation") >= n, name
        assert df.collect()
    spark.catalog.clearCache()
