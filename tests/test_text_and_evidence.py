import pytest
from pyspark.sql import functions as F

from gritstone.functions import evidence as E
from gritstone.functions import signature as G
from gritstone.functions import text as T
from gritstone.operators import overlap as O


def test_comments_go_and_literals_stay(spark):
    code = 'a = "x // y"; // gone\n/* gone */ b = \'"\';'
    row = spark.createDataFrame([(code,)], "c string").select(T.strip_comments("c").alias("s"), T.token_stream("c").alias("t"), T.plain_normalized("c").alias("p")).first()
    assert "gone" not in row.s and '"x // y"' in row.s and row.t == 'a="x//y";b=\'"\';' and row.p.startswith('a="x')


def test_spacing_is_normalised_outside_literals(spark):
    one = lambda code: tuple(spark.createDataFrame([(code,)], "c string").select(T.normalize_wide("c"), T.normalize_short("c")).first())
    assert one("int   foo  (  int x  )  {\n\n\treturn x + 1;\n}")[0] == one("int foo(int x) { /* add */ return x + 1; // done \n}")[0] == "int foo(int x) { return x + 1; }"
    assert one("void bar  (   )   {\n\n}")[0] == "void bar() {}"
    assert one("f( a , b ) ;") == ("f(a, b);", "f(a , b) ;")
    assert one("if (a) b;")[0] != one("if (a)b;")[0] and one("a; b")[0] != one("a;b")[0]
    assert one('g("a  ,  b" ,\'{\' )')[0] == 'g("a  ,  b", \'{\')' and one('"a"+x')[0] != one('"a" +x')[0]
    assert one("x [ 3 ]") == ("x[3]", "x[ 3 ]") and one("s = '" + "y" * 50_000 + "' ;")[0].endswith("y';")


def test_first_token_scores(spark):
    tops = [({"1": -0.2, " 0": -1.8, "The": -5.0},), ({"The": -0.1},)]
    a, b = spark.createDataFrame(tops, "t map<string,double>").select(T.first_token_score("t").alias("p")).select("p.*").collect()
    assert a.valid and a.pred == 1 and 0.8 < a.s < 0.9
    assert not b.valid and b.s is None and b.pred is None


@pytest.mark.parametrize(
    "raw,label",
    [("1", 1), ("'0'", 0), ("thoughts\n1", 1), ("cannot determine", None), ("Label: non-vulnerable (0)", 0), ("Vulnerable (1)", 1), ("not vulnerable", 0), ("it is vulnerable", 1), ("vulnerable, yet safe", None), ("only 1 here", 1), ("0 or 1", None), ("", None), (None, None), ("hm", None)],
)
def test_free_text_rules(spark, raw, label):
    assert spark.createDataFrame([(raw,)], "r string").select(T.free_text_label("r")["label"]).first()[0] == label


def test_strict_binary(spark):
    rows = [(" 1 ", "stop"), ("0", "length"), ("yes", "stop"), ("0", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "r string, f string").select(T.strict_binary("r", "f")).collect()] == [1, None, None, 0]


def test_jaccard_conventions(spark):
    rows = [([], []), (["a"], []), (["a", "b"], ["b", "c"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(T.jaccard("a", "b"), T.jaccard_or_one("a", "b")).collect()
    assert [tuple(r) for r in got] == [(0.0, 1.0), (0.0, 0.0), (1 / 3, 1 / 3)]


@pytest.mark.parametrize(
    "text,value",
    [("0", False), ("1", True), ("!0", True), ("!1", False), ("0x0", False), ("0x1F", True), ("010", True), ("0b0", False), ("1UL", True), ("09", None), ("X", None), ("!X", None), ("defined(X)", None), ("defined X", None), ("0 && X", False), ("X && 0", False),
     ("1 && X", None), ("1 || X", True), ("X || 1", True), ("0 || X", None), ("(1)", True), ("(1", None), ("1 + 1", None), ("defined", None)],
)
def test_condition_truth_table(text, value):
    assert E.condition(text) is value


def test_dead_code_is_left_out_with_offsets_kept():
    code = "int f() {\n#if 0\n  strcpy(a, b);\n#endif\n  memcpy(a, b, n);\n}\n"
    rows = E.evidence(code)
    live = [r for r in rows if r["status"] == "recognized"]
    assert [(r["api"], r["line"], r["state"]) for r in live] == [("memcpy", 5, "active")]
    assert code[live[0]["start"] : live[0]["end"]] == live[0]["expression"] == "memcpy(a, b, n)"
    assert [r["api"] for r in rows if r["status"] == "excluded_inactive"] == ["strcpy"]


def test_unknown_and_unclosed_conditionals_stay_conditional():
    both = E.evidence("void f(void) {\n#ifdef A\nfree(a);\n#else\nmemcpy(d,s,n);\n#endif\n}")
    assert {(r["api"], r["state"]) for r in both} == {("free", "conditional"), ("memcpy", "conditional")}
    assert E.evidence("void f(void) {\n#if 0\nfree(a);\n}")[0]["state"] == "conditional"
    chain = E.evidence("void f(void) {\n#if FLAG\nfree(a);\n#elif 0\nfree(b);\n#elif 1\nfree(c);\n#else\nfree(d);\n#endif\n}")
    assert [(r["expression"], r["status"]) for r in chain] == [("free(a)", "recognized"), ("free(b)", "excluded_inactive"), ("free(c)", "recognized"), ("free(d)", "excluded_inactive")]


@pytest.mark.parametrize(
    "code,live",
    [
        ("void f(void) {\n#if 0\n#ifdef FOO\nfree(a);\n#else\nfree(b);\n#endif\n#endif\nfree(c);\n}", ["free(c)"]),
        ("void f(void) {\n#if 1\nfree(a);\n#elif FEATURE\nfree(b);\n#else\nfree(c);\n#endif\n}", ["free(a)"]),
        ('void f(void) { /*\n#if 0\n*/\nchar *s="#if 0";\n#define FAKE(x) free(x)\nfree(p);\n}', ["free(p)"]),
        ("void f(void) {\n#if 0 \\\n && FLAG\nfree(p);\n#endif\nfree(q);\n}", ["free(q)"]),
        ("void f(void) {\n#if 0\nnot_c( (((\n#endif\nmemcpy(d,s,n);\n}", ["memcpy(d,s,n)"]),
        ("#define COPY(x,y,n) \\\n+ memcpy(x,y,n)\nvoid f(void) {}", []),
        ("void f(void) { free(\n#ifdef A\np\n#else\nq\n#endif\n); }", ["free(\n#ifdef A\np\n#else\nq\n#endif\n)"]),
        ("void f(void) { memcpy(d, malloc(n), n); custom::free(b); p.read(b); }", ["memcpy(d, malloc(n), n)", "malloc(n)"]),
        ("void f(void) { (void)memcpy(d,s,n); for (i=0;i<n;i++) tcg_malloc(p); }", ["memcpy(d,s,n)", "tcg_malloc(p)"]),
        ("void f(void) { extern void free(void *p); } void free(void *p) { }", []),
    ],
)
def test_recognised_calls(code, live):
    rows = [r for r in E.evidence(code) if r["status"] == "recognized"]
    assert [r["expression"] for r in rows] == live and all(code[r["start"] : r["end"]] == r["expression"] for r in rows)


def test_look_alikes_and_problems():
    rows = E.evidence("static void RENAME(foo)(uint8_t (*a)[4]) { RENAME(x); }")
    assert [(r["api"], r["status"], r["exclusion"]) for r in rows] == [("RENAME", "excluded_syntax", "macro_decorated_function_declaration_not_call"), ("uint8_t", "excluded_syntax", "array_pointer_parameter_type_not_call"), ("RENAME", "unknown", None)]
    for tail, reason in (("#else", "duplicate_else"), ("#elif 1", "elif_after_else")):
        code = f"void f(void) {{\n#if 1\nfree(p);\n#else\nfree(q);\n{tail}\nfree(r);\n#endif\n}}"
        assert [(r["expression"], r["state"]) for r in E.evidence(code) if r["status"] == "recognized"] == [("free(p)", "active"), ("free(r)", "conditional")]
        assert [p["reason"] for p in E.diagnostics(code)] == [reason]
    assert [p["reason"] for p in E.diagnostics("#endif\n#if 0\nmemcpy(")] == ["unbalanced_call_or_declaration", "orphan_endif", "unclosed_conditional"]
    assert E.evidence(None) == [] and E.diagnostics("") == []


def test_what_is_and_is_not_a_call():
    names = lambda code: [(r["api"], r["status"]) for r in E.evidence(code)]
    assert names('// free(a)\nvoid f(void) { puts("memcpy(x)"); }') == [("puts", "unknown")]
    assert names("int memcpy(void *, int);") == []
    assert names("void f(void) { p->free(x); return free(y); }") == [("free", "unknown"), ("free", "recognized")]
    assert names("void f(void) { outer(g_free(x)); HELPER(1); }") == [("outer", "unknown"), ("g_free", "recognized"), ("HELPER", "unknown")]
    assert names("void f(void) { free(a; }") == []
    roles = [r["role"] for r in E.evidence('void f(void) { fprintf(stderr, "a"); printf("b"); sprintf(b, "c"); }')]
    assert roles == ["diagnostic_stderr", "standard_stdout", "buffer_formatting"]


def test_signature_guards_before_sinks():
    guarded = G.signature("void f(char *dst, int len) { if (len < 10) memcpy(dst, src, len); }")
    late = G.signature("void f(char *dst, int len) { memcpy(dst, src, len); if (len < 10) return; }")
    assert guarded["controlled"] == ["memcpy"] and "bounds_check" in guarded["effective_guards"]
    assert late["controlled"] == [] and "bounds_check" not in late["effective_guards"] and "unbounded_buffer_copy" in late["clues"]
    assert G.signature(None)["func_name"] == "unknown_func"


def test_signature_similarity_prefers_the_same_mechanism(spark):
    rows = [("void f(char *p) { free(p); }", "void g(char *q) { free(q); }", 'void h(int n) { printf("%d", n); }')]
    r = spark.createDataFrame(rows, "a string, b string, c string").select(*[G.signature_of(c).alias(c) for c in "abc"]).select(G.signature_similarity("a", "b"), G.signature_similarity("a", "c")).first()
    assert r[0] > r[1] + 0.2


def test_leakage_levels(spark):
    train = spark.createDataFrame([(1, "int a; // x", 1, "p"), (2, "int b;", 0, "p"), (3, "int c ;", 1, "q")], "id int, text string, label int, project string")
    test = spark.createDataFrame([(11, "int a; // x", 1, "p"), (12, "int b;", 1, "p"), (13, "int  a;", 1, "q"), (14, "other", 0, "q")], "id int, text string, label int, project string")
    got = {r.level: r for r in O.leakage_report(O.hash_matches(test, train), 4).collect()}
    assert (got["exact"].duplicates, got["exact"].rate_percent, got["exact"].consistent, got["exact"].contradictory) == (2, 50.0, 1, 1)
    assert (got["normalized"].duplicates, got["normalized"].rate_percent, got["normalized"].consistent) == (3, 75.0, 2)


def test_set_similarity_join_equals_brute_force(spark):
    import itertools
    import random

    rng = random.Random(3)
    sets = {i: sorted(rng.sample([f"w{k}" for k in range(14)], rng.randint(1, 10))) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id int, items array<string>")
    for t in (0.5, 0.8):
        got = {(r.id_a, r.id_b) for r in O.set_similarity_join(df, threshold=t).collect()}
        exact = {(a, b) for a, b in itertools.combinations(sets, 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t}
        assert got == exact
        half = df.filter("id % 2 = 0")
        assert {(r.id_a, r.id_b) for r in O.set_similarity_join(half, df, t).collect()} == {p for a, b in exact for p in ((a, b), (b, a)) if p[0] % 2 == 0} | {(i, i) for i in sets if i % 2 == 0}


def test_best_donor_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    sets = {i: rng.sample(range(30), rng.randint(0, 9)) for i in range(80)} | {80: [99]}
    df = spark.createDataFrame(list(sets.items()), "id long, items array<long>").repartition(5)
    got = {r.query_id: (r.donor_id, r.jaccard) for r in O.best_donor(df.filter("id % 10 = 0"), df, keep=6).collect()}
    for q in range(0, 81, 10):
        shared = sorted(((-len({*sets[q]} & {*sets[d]}), d) for d in sets if d != q and {*sets[q]} & {*sets[d]}))[:6]
        scored = sorted((c / (len(sets[q]) + len(sets[d]) + c), c, d) for c, d in shared)
        want = (scored[0][2], round(-scored[0][0], 6)) if scored else (1 if q == 0 else 0, 0.0)
        assert got[q] == want


def test_copies_have_one_representative(spark):
    df = spark.createDataFrame([(3, [1, 2]), (1, [2, 1]), (5, [1, 2, 3]), (7, [])], "id int, items array<long>")
    assert {r.id: r.head for r in O.representatives(df).collect()} == {1: 1, 3: 1, 5: 5, 7: 7}
    assert sorted(r.id for r in O.heads_of(df).collect()) == [1, 5, 7]


def test_near_clone_by_comment_and_space(spark):
    code = "int f(int a) { int b = a + 1; int c = b * 2; return a + b + c; }"
    df = spark.createDataFrame([(1, code), (2, "/* c */ " + code.replace(" ", "  "))], "id int, c string").select("id", T.shingles(T.tokens(T.strip_comments("c")), 5).alias("items"))
    assert [tuple(r) for r in O.set_similarity_join(df).collect()] == [(1, 2, 1.0)] and O.set_similarity_join(O.heads_of(df)).count() == 0


def test_minhash_of_an_empty_set_is_zero(spark):
    s = spark.createDataFrame([([],), (["a"],)], "i array<string>").select(O.minhash("i", 4).alias("s")).collect()
    assert s[0].s == [0, 0, 0, 0] and 0 not in s[1].s


def test_label_word_flip_is_an_involution(spark):
    row = spark.createDataFrame([("Non-vulnerable, unsafe; Vulnerable, safe",)], "t string").select(T.flip_label_words("t").alias("x")).withColumn("y", T.flip_label_words(F.col("x"))).first()
    assert row.x == "Vulnerable, safe; Non-vulnerable, unsafe" and row.y == "Non-vulnerable, unsafe; Vulnerable, safe"
