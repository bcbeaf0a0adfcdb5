"""Prompt arms as Columns: graph, demonstration, label, difference and order policies over a spec, and block comparison.

A spec has id, query_code, nodes, edges, demonstrations (array of struct(function_uid, func, target)),
demonstrations_pair (vulnerable first), security_difference and h2_evidence. Rendering is a projection: specs are
crossed with the small table of arms and every block is a CASE of the arm's policies.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions import text as T

from .tables import ContractError, fitting_nodes, graph_prefix, graph_text, inside

#: Arm to graph, demo, label, diff and order policies (fixed values).
ARMS = {
    "B0": ("none", "none", "true", False, "given"),
    "B1": ("prefix", "none", "true", False, "given"),
    "B1-full": ("fill", "none", "true", False, "given"),
    "B1-H2": ("h2", "none", "true", False, "given"),
    "B1-shuf": ("shuffle", "none", "true", False, "given"),
    "B2": ("prefix", "retrieved", "true", False, "given"),
    "B2-rand": ("prefix", "random", "true", False, "given"),
    "B2-nolabel": ("prefix", "retrieved", "none", False, "given"),
    "B2-labelonly": ("prefix", "labelonly", "true", False, "given"),
    "B2-flip": ("prefix", "retrieved", "flip", False, "given"),
    "B2-rep": ("prefix", "retrieved", "true", False, "given"),
    "B3": ("prefix", "contrastive", "true", True, "given"),
    "B3-nodiff": ("prefix", "contrastive", "true", False, "given"),
    "B3-swap": ("prefix", "contrastive", "true", True, "swap"),
    "B3-flip": ("prefix", "contrastive", "flip", True, "given"),
}
FORBIDDEN = ("target", "target_label", "label", "ground_truth")
BUDGET = {"total": 8192, "target_code": 3072, "graph": 1024, "demo": 1024, "reserve": 64}
BLOCKS = ("role", "code", "question", "graph", "demonstration", "answer")
ROLE, QUESTION, ANSWER = "You review C functions for security defects.", "Is the function above vulnerable?", "Answer with 1 for vulnerable or 0 for non-vulnerable."
HEADS = {"role": ROLE, "question": QUESTION, "answer": ANSWER}


def arms_table(spark, arms: dict | None = None) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in (arms or ARMS).items()], "arm string, graph string, demo string, shown string, diff boolean, ordering string")


def _shown(target: Column) -> Column:
    flipped = F.when(F.col("shown") == "flip", 1 - target).otherwise(target)
    return F.when(flipped == 1, "Vulnerable").otherwise("Non-vulnerable")


def graph_texts(prefix: tuple[int, int] = (25, 25)) -> dict[str, Column]:
    """The graph's text under each policy that shows one."""
    shown = lambda nodes, edges: T.fit_tokens(graph_text(nodes, edges), BUDGET["graph"])
    first = graph_prefix(F.col("nodes"), F.col("edges"), *prefix)
    far = graph_prefix(F.reverse("nodes"), F.col("edges"), *prefix)
    fit = F.slice("nodes", F.lit(1), F.col("_fit"))
    return {"prefix": shown(*first), "fill": shown(fit, inside(fit, F.col("edges"))), "shuffle": shown(*far), "h2": T.fit_tokens(F.coalesce("h2_evidence", F.lit("")), BUDGET["graph"])}


def graph_block() -> Column:
    """The text of the arm's policy, of those that render made for each spec."""
    out = F.lit("")
    for policy in ("prefix", "fill", "shuffle", "h2"):
        out = F.when(F.col("graph") == policy, F.col(f"_graph_{policy}")).otherwise(out)
    return F.when((F.col("graph") == "none") | ((F.col("graph") != "h2") & F.col("_no_nodes")), "").otherwise(out)


def demo_block() -> Column:
    one, pair = F.get("demonstrations", F.lit(0)), F.when(F.col("ordering") == "swap", F.reverse("demonstrations_pair")).otherwise(F.col("demonstrations_pair"))
    donor = F.coalesce(F.col("donor"), one)
    fitted = lambda d: T.fit_tokens(F.trim(d["func"]), BUDGET["demo"])
    example = lambda d: F.concat(F.when(F.col("shown") == "none", F.lit("The following is a related example.")).otherwise(F.concat(F.lit("The following is an example, and it is "), _shown(d["target"]), F.lit("."))), F.lit("\n"), fitted(d))
    both = F.array_join(F.transform(pair, lambda d: F.concat(F.lit("The following example is "), _shown(d["target"]), F.lit(".\n"), fitted(d))), "\n\n")
    difference = F.when(F.col("shown") == "flip", T.flip_label_words("security_difference")).otherwise(F.col("security_difference"))
    tail = F.when(F.col("diff") & (F.coalesce(F.trim("security_difference"), F.lit("")) != ""), F.concat(F.lit("\n\n"), T.fit_tokens(F.concat(F.lit("Key difference: "), difference), BUDGET["demo"] // 3))).otherwise(F.lit(""))
    return (
        F.when(F.col("demo") == "retrieved", example(one))
        .when(F.col("demo") == "random", example(donor))
        .when(F.col("demo") == "labelonly", F.concat(F.lit("A function similar to the one above was labelled "), _shown(one["target"]), F.lit(".")))
        .when(F.col("demo") == "contrastive", F.concat(both, tail))
        .otherwise(F.lit(""))
    )


def render(specs: DataFrame, arms: dict | None = None) -> DataFrame:
    """id, arm, the blocks, prompt, prompt_sha256 and tokens for each spec and arm; a spec that holds a label is refused."""
    held = [c for c in specs.columns if c in FORBIDDEN]
    if held:
        raise ContractError(f"labels may not enter prompts: {held}")
    if "donor" not in specs.columns:
        specs = specs.withColumn("donor", F.get("demonstrations", F.lit(0)))
    # What doesn't depend on the arm is made once for each spec, before the arms multiply the rows.
    specs = specs.withColumn("_fit", fitting_nodes(F.col("nodes"), F.col("edges"), BUDGET["graph"] * 4))
    made = {f"_graph_{k}": text for k, text in graph_texts().items()}
    specs = specs.select("id", "demonstrations", "demonstrations_pair", "security_difference", "donor", (F.size("nodes") == 0).alias("_no_nodes"), T.fit_tokens(F.trim("query_code"), BUDGET["target_code"], "\n/* [TRUNCATED TARGET] */").alias("code_block"), *[c.alias(k) for k, c in made.items()])
    rows = specs.crossJoin(F.broadcast(arms_table(specs.sparkSession, arms)))
    rows = rows.withColumns({"role_block": F.lit(ROLE), "question_block": F.lit(QUESTION), "graph_block": graph_block(), "demonstration_block": demo_block(), "answer_block": F.lit(ANSWER)})
    present = F.filter(F.array(*[F.col(f"{b}_block") for b in BLOCKS]), lambda x: x.isNotNull() & (x != ""))
    rows = rows.withColumn("prompt", F.array_join(present, "\n\n"))
    rows = rows.withColumn("prompt_sha256", F.sha2("prompt", 256)).withColumn("tokens", T.approx_tokens("prompt"))
    return rows.select("id", "arm", *[f"{b}_block" for b in BLOCKS], "prompt", "prompt_sha256", "tokens").withColumn("over_budget", F.col("tokens") + BUDGET["reserve"] > BUDGET["total"])


def changed_blocks(rendered: DataFrame, a: str, b: str) -> DataFrame:
    """id and the names of blocks in which arms a and b differ. Only hashes of blocks are joined, and made once for both arms."""
    marks = rendered.filter(F.col("arm").isin(a, b)).select("id", "arm", *[F.sha2(f"{x}_block", 256).alias(x) for x in BLOCKS]).persist(StorageLevel.DISK_ONLY)
    side = lambda arm, n: marks.filter(F.col("arm") == arm).select("id", *[F.col(x).alias(f"{n}_{x}") for x in BLOCKS])
    differs = [F.when(~F.col(f"l_{x}").eqNullSafe(F.col(f"r_{x}")), F.lit(x)) for x in BLOCKS]
    return side(a, "l").join(side(b, "r"), "id").select("id", F.array_compact(F.array(*differs)).alias("changed"))


def mock_score(prompt) -> Column:
    """A deterministic stand-in for the external model: a score from the prompt's hash."""
    return F.conv(F.substring(F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
