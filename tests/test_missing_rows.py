"""Readers, locks, atomic writes, positional joins, reviews, layouts and the ordering suite."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritstone.functions import signature as G
from gritstone.functions.skeleton import skeleton
from gritstone.operators import controls
from gritstone.operators import tables as B
from gritstone.sources import readers, sinks
from gritstone.streaming import runs

#: target, the one that should be nearer, the other, least margin (fixed cases of similarity order).
ORDER = [
    ("void copy(char *dst, char *src, int len) { if (len <= dst_size) { memcpy(dst, src, len); } }", "void transfer(char *out, char *in, int count) { if (count <= max_cap) { memcpy(out, in, count); } }", "void transfer(char *out, char *in, int count) { if (retry > 0) { memcpy(out, in, count); } }", 0.10),
    ("void send_buf(char *dest, char *msg, int size) { if (size <= MAX_BUF) { memcpy(dest, msg, size); } }", "void log_msg(char *dst, char *src, int len) { if (len <= LIMIT) { memcpy(dst, src, len); } }", "void log_msg(char *dst, char *src, int len) { memcpy(dst, src, len); if (len <= LIMIT) { return; } }", 0.10),
    ("void write_data(char *src, int n) { memcpy(buffer, src, n); }", "void packet_in(char *raw, int sz) { memmove(storage, raw, sz); }", "void audit_log(char *name) { system(name); }", 0.15),
    ("void process_node(struct Node *node) { if (node != NULL) { free(node->data); free(node); } }", "void release_item(struct Item *item) { if (item != NULL) { free(item->payload); free(item); } }", "void release_item(struct Item *item, struct Item *other) { if (other != NULL) { free(item->payload); free(item); } }", 0.10),
    ("void cleanup(Object *obj) { free(obj->buf); free(obj); }", "void teardown(Session *s) { free(s->token); free(s); }", "int calc_hash(int a, int b) { return (a * 31 + b) % 1000; }", 0.20),
    ("int alloc_mem(int count, int elem_sz) { if (count > 0 && count <= MAX_INT / elem_sz) { return count * elem_sz; } return -1; }", "int calc_size(int n, int sz) { if (n <= INT_MAX / sz) { return n * sz; } return 0; }", "int calc_size(int n, int sz) { return n * sz; }", 0.05),
    ("int get_elem(int *arr, int idx) { if (idx >= 0 && idx < MAX_LEN) { return arr[idx]; } return -1; }", "int fetch_data(int *buf, int pos) { if (pos < BUF_SIZE) { return buf[pos]; } return 0; }", "int fetch_data(int *buf, int pos) { return buf[pos]; }", 0.05),
    ("void log_user(char *fmt, char *arg) { printf(fmt); }", "void debug_msg(char *user_input) { sprintf(log_buf, user_input); }", "void close_connection(FILE *fp) { fclose(fp); }", 0.15),
    ("void process_req(char *src, int len) { memcpy(dest, src, len); }", "void parse_chunk(char *payload, int n) { memcpy(temp_buf, payload, n); }", "void parse_chunk(char *payload, int n) { if (n <= sizeof(temp_buf)) { memcpy(temp_buf, payload, n); } }", 0.10),
    ("void read_buffer(char *in, int len) { memcpy(out, in, len); }", "void copy_packet(char *data, int sz) { memcpy(queue, data, sz); }", "void read_buffer_math(char *in, int len) { int out = 0; for(int i=0; i<len; i++) out += in[i]; }", 0.05),
]


def test_similarity_prefers_the_same_mechanism_in_every_case(spark):
    df = spark.createDataFrame([(i, *case) for i, case in enumerate(ORDER)], "i int, t string, p string, d string, margin double")
    df = df.select("i", "margin", *[G.signature_of(c).alias(c) for c in "tpd"])
    for r in df.select("i", "margin", G.signature_similarity("t", "p").alias("near"), G.signature_similarity("t", "d").alias("far")).collect():
        assert r.near - r.far >= r.margin - 1e-9, r


def test_older_features(spark):
    df = spark.createDataFrame([("if (buf == NULL) return -1; memcpy(buf, src, len); x[i] = p->y;", "int a;")], "a string, b string")
    r = df.select(G.older_features("a").alias("a"), G.older_features("b").alias("b")).withColumn("s", G.older_similarity("a", "b")).withColumn("t", G.older_similarity("b", "b")).first()
    assert r.a.apis == ["memcpy"] and r.a.guards == [1, 2, 3] and r.a.memory == [True, True, False] and r.a.inputs == ["buf", "len", "src"]
    assert r.b.apis == [] and r.s == pytest.approx(0.3 / 3) and r.t == 1.0


def test_skeleton_graph(spark):
    code = "static int f(char *buf, int n) {\n  // note\n  int a = 0;\n  if (n > 2)\n    g(buf);\n  a = n;\n  return a;\n}\n"
    g = spark.createDataFrame([(code,), (None,)], "c string").select(skeleton("c").alias("g")).collect()
    nodes, edges = g[0].g.nodes, g[0].g.edges
    assert [(n.id, n.type, n.identifier) for n in nodes] == [("1", "FunctionDef", "f"), ("2", "Parameter", "buf"), ("3", "Parameter", "n"), ("4", "CompoundStatement", ""), ("5", "IdentifierDeclStatement", "a"), ("6", "IfStatement", "n > 2"), ("7", "CallExpression", "g"), ("8", "AssignmentExpr", "a"), ("9", "ReturnStatement", ""), ("10", "CFGExitNode", "")]
    assert [(e.start, e.end) for e in edges if e.type == "FLOWS_TO"] == [("1", "5"), ("5", "6"), ("6", "7"), ("7", "8"), ("8", "9"), ("9", "10")]
    assert [(e.start, e.end) for e in edges if e.type == "IS_AST_PARENT"] == [("1", "2"), ("1", "3"), ("1", "4"), *(("4", str(k)) for k in range(5, 10))]
    assert [n.type for n in g[1].g.nodes] == ["FunctionDef", "CompoundStatement", "CFGExitNode"]


def test_lock_and_atomic_write(spark, tmp_path):
    with runs.run_lock(spark, str(tmp_path / "run")):
        with pytest.raises(B.ContractError), runs.run_lock(spark, str(tmp_path / "run")):
            pass
    with runs.run_lock(spark, str(tmp_path / "run")):
        pass
    for text in ("one", "two"):
        runs.write_atomic(spark, str(tmp_path / "x.json"), text)
        assert (tmp_path / "x.json").read_text() == text
    assert [p.name for p in tmp_path.iterdir() if "tmp-" in p.name] == []


def test_matrix_resumes(spark, tmp_path):
    rows, made = spark.range(40), []

    def embed(part):
        made.append(part.count())
        if len(made) == 3 and len(made) < 100 and not (tmp_path / "go").exists():
            raise OSError("killed")
        return part.withColumn("embedding", F.array(F.col("id").cast("float")))

    with pytest.raises(OSError):
        runs.resumable_matrix(rows, str(tmp_path / "m"), "a", embed, parts=4)
    (tmp_path / "go").touch()
    assert runs.resumable_matrix(rows, str(tmp_path / "m"), "a", embed, parts=4).count() == 40 and len(made) == 5
    with pytest.raises(B.ContractError):
        runs.resumable_matrix(spark.range(41), str(tmp_path / "m"), "a", embed, parts=4)


def test_positional_join(spark):
    rows = spark.createDataFrame([(0, "a", 7), (1, "a", 8)], "position long, h string, x int")
    manifest = spark.createDataFrame([(0, "a", "u0"), (1, "a", "u1")], "position long, sha string, uid string")
    assert {(r.x, r.uid) for r in B.positional_join(rows, manifest, {"h": "sha"}).collect()} == {(7, "u0"), (8, "u1")}
    for bad in (manifest.limit(1), manifest.withColumn("sha", F.lit("b")), manifest.withColumn("position", F.lit(0).cast("long"))):
        with pytest.raises(B.ContractError):
            B.positional_join(rows, bad, {"h": "sha"})


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"id": "1", "func": "f(},", "target": 1},\n  {"id": "2", "func": "g", "target": 0},\nnot json,\n{"id": }\n]\n')
    assert sorted((r.id, r.target) for r in readers.json_array_lines(spark, str(tmp_path / "a.json")).collect()) == [("1", 1), ("2", 0)]
    assert readers.json_array_lines(spark, str(tmp_path / "a.json"), most=1).count() == 1
    assert readers.first_location(spark, [str(tmp_path / "none"), str(tmp_path / "a.json")]).endswith("a.json")
    with pytest.raises(B.ContractError):
        readers.first_location(spark, [str(tmp_path / "none")])
    x = np.arange(12, dtype=np.float64).reshape(4, 3)
    np.save(tmp_path / "x.npy", x)
    held = io.BytesIO()
    np.savez(held, one=x, two=x + 1)
    (tmp_path / "y.npz").write_bytes(held.getvalue())
    assert {r.row: r.embedding for r in readers.npy_matrix(spark, str(tmp_path / "x.npy")).collect()} == {i: v.tolist() for i, v in enumerate(x)}
    assert readers.npy_matrix(spark, str(tmp_path / "y.npz"), "two").filter("row = 3").first().embedding == [10.0, 11.0, 12.0]
    assert readers.yaml_config("a: 1\nb: [x, y]") == {"a": 1, "b": ["x", "y"]} and readers.yaml_config("") == {}
    text = sinks.markdown_summary({"One": spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")})
    assert text.startswith("## One\n\n| k | v |") and "| 1 | 0.5000 |" in text and "| 2 | n/a |" in text


def _spec(spark, **change):
    demo = "struct<function_uid:string,func:string,target:int>"
    row = {"id": "1", "query_code": " int f() { } ", "nodes": [("0", "A", "x"), ("1", "B", "y")], "edges": [("0", "1", "E")], "demonstrations": [("u", "bad()", 1), ("v", "good()", 0)], "random_demonstrations": [("w", "other()", 0), ("z", "more()", 1)], "security_difference": "checks len before memcpy"} | change
    kinds = f"id string, query_code string, nodes array<struct<id:string,type:string,code:string>>, edges array<struct<start:string,end:string,type:string>>, demonstrations array<{demo}>, random_demonstrations array<{demo}>, security_difference string"
    return spark.createDataFrame([tuple(row[k.split()[0]] for k in kinds.split(", "))], kinds)


def test_layouts(spark):
    got = {r.mode: r.prompt for r in controls.prompts(_spec(spark, query_code="q" * 3100)).collect()}
    assert set(got) == set(controls.MODES)
    assert got["legacy"].split("\n\n")[0] == controls.TASK and "Label: Vulnerable (1)" in got["legacy"] and controls.DEMO_HEAD not in got["legacy_zero_shot"]
    assert "q" * 3000 + controls.MEMORY_CUT in got["legacy"] and "q" * 3001 not in got["legacy"]
    assert got["figure"].startswith("q" * 3000 + "\n\n" + controls.FIGURE_TASK) and got["figure"].endswith("it is Vulnerable.\nbad()\n\n" + controls.FIGURE_ANSWER)
    assert "node information" not in got["figure_no_graph"] and "following is an example" not in got["figure_zero_shot"]
    a, b = got["contrastive"], got["contrastive_inverted"]
    assert a.index("bad()") < a.index("good()") and b.index("good()") < b.index("bad()") and "CORE SECURITY DIFFERENCE" in a and "CORE" not in got["contrastive_no_difference"]
    one_sided = {r.mode: r.prompt for r in controls.prompts(_spec(spark, demonstrations=[("u", "bad()", 1)], nodes=[], edges=[])).collect()}
    assert one_sided["contrastive"] == one_sided["legacy"] and "[No Node Information Available]" in one_sided["legacy"]
    many = [(str(i), "T", "") for i in range(30)]
    assert "... (and 5 more nodes omitted for token budget)" in controls.prompts(_spec(spark, nodes=many)).filter("mode = 'legacy'").first().prompt


@pytest.mark.parametrize("version", ["v1", "v2"])
def test_controls_change_one_thing(spark, version):
    got = {r.condition: r for r in controls.render_controls(_spec(spark), version).collect()}
    assert set(got) == set(controls.CONTROLS[version]) and all(r.problem is None for r in got.values())
    base = got["original"].prompt
    assert got["repeat_original"].prompt == base and "graph" not in got["graph_omitted"].prompt.lower().replace("### target graph", "graph") and got["graph_omitted"].rendered_nodes == 0
    assert controls.CLUES not in got["no_difference"].prompt and controls.CLUES in base
    swapped = got["order_swap"].prompt
    assert swapped != base and sorted(swapped) != "" and swapped.index("good()") < swapped.index("bad()")
    assert got["label_flip"].prompt != base and len(got["label_flip"].prompt) == len(base)
    if version == "v2":
        assert "bad()" not in got["demo_random"].prompt and "other()" in got["demo_random"].prompt and "bad()" not in got["demo_labelonly"].prompt and "it is Vulnerable" not in got["demo_nolabel"].prompt


def test_controls_refuse_what_does_not_fit(spark):
    problems = lambda **c: {r.condition: r.problem for r in controls.render_controls(_spec(spark, **c)).collect()}
    assert problems(demonstrations=[("u", "bad()", 1)])["order_swap"] == "order_swap_needs_two"
    assert problems(security_difference="")["no_difference"] == "no_difference_needs_one"
    assert set(problems(security_difference="the first one is safe").values()) == {"difference_names_classes"}
    assert set(problems(query_code=" ").values()) == {"empty_target_code"} and set(problems(demonstrations=[]).values()) == {"one_or_two_unique_demonstrations_required"}
    assert set(problems(demonstrations=[("u", " ", 1)]).values()) == {"demo_code_or_label"}
    assert problems(edges=[])["original"] == "no_closed_graph" and problems(edges=[])["graph_omitted"] is None
    with pytest.raises(B.ContractError):
        controls.render_controls(_spec(spark).withColumn("target", F.lit(1)))


def test_plan_violations(spark):
    specs = _spec(spark).withColumn("arm", F.lit("B3"))
    good = controls.render_controls(specs.drop("arm")).select("condition", "prompt", "target_sha256").withColumns({"id": F.lit("1"), "arm": F.lit("B3"), "item_id": F.col("condition"), "candidate_ids": F.array(*map(F.lit, "uvxy")), "demo_uids": F.array(F.lit("u"), F.lit("v"))})
    good = good.withColumn("tokens", F.floor(F.length("prompt") / 4.0 + 0.999).cast("long"))
    assert controls.plan_violations(good, specs).count() == 0
    reasons = lambda items: {r.reason for r in controls.plan_violations(items, specs).collect()}
    assert reasons(good.withColumn("prompt", F.concat("prompt", F.lit("x" * 8)))) == {"prompt_differs_from_renderer", "token_budget_differs"}
    assert reasons(good.withColumn("candidate_ids", F.array(F.lit("u"), F.lit("u")))) == {"candidates_repeat", "demo_outside_candidates"}
    assert reasons(good.withColumn("candidate_ids", F.when(F.col("condition") == "original", F.array(*map(F.lit, "uvx"))).otherwise(F.col("candidate_ids")))) == {"arms_have_other_pools"}
    assert reasons(good.withColumn("target_sha256", F.lit("0"))) == {"query_code_hash"} and reasons(good.withColumn("condition", F.lit("odd"))) == {"unknown_control_or_spec"}


def test_reviews(spark):
    sheet = lambda rows: spark.createDataFrame(rows, "id int, snippet string, choice string")
    full = spark.createDataFrame([(1, "int f()\n{ }"), (2, "g();")], "id int, func string")
    one, two = sheet([(1, "int f()\n /* ... [cut] */", "A"), (2, "g();", "B")]), sheet([(1, "int f()\r\n /* ... [cut] */", "A"), (2, "g();", "Equal")])
    got = {r.id: (r.choice, r.changed, r.agreed) for r in B.adjudicate(one, two, full, spark.createDataFrame([(2, "Neither")], "id int, choice string")).collect()}
    assert got == {1: ("A", False, True), 2: ("Neither", True, False)}
    none = spark.createDataFrame([], "id int, choice string")
    for bad in (sheet([(1, "int f()\n /* ... [cut] */", "A")]), sheet([(1, "x", "A"), (2, "g();", "B")])):
        with pytest.raises(B.ContractError):
            B.adjudicate(one, bad, full, none)
    with pytest.raises(B.ContractError):
        B.adjudicate(sheet([(1, "h()", "A")]), sheet([(1, "h()", "A")]), full, none)
