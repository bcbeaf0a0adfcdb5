"""Record reshaping, identity joins, reconciliation, and fail-closed contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Suffix to condition of the wide layouts (fixed values).
CONDITIONS = {"b2": {"a": "original", "b": "label_flip", "c": "repeat_original"}, "b3": {"a": "original", "b": "order_swap", "c": "repeat_original"}}


class ContractError(ValueError):
    """A contract of a table does not hold."""


def resolve(df: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Columns renamed by the first alias present, in any case; a required one without an alias raises."""
    have = {c.lower(): c for c in df.columns}
    picked = {name: next((have[a] for a in options if a in have), None) for name, options in aliases.items()}
    missing = [name for name in required if picked.get(name) is None]
    if missing:
        raise ContractError(f"no column for {missing} among {df.columns}")
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in picked.items() if c])


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order; the others are superseded."""
    names = df.columns
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*names), F.col(order)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in names])


def word_score(raw: Column) -> Column:
    """A number, or a word for 1.0 or 0.0; NULL if neither."""
    low = F.lower(F.trim(raw.cast("string")))
    return F.when(low.isin("vuln", "vulnerable", "true"), 1.0).when(low.isin("safe", "non-vulnerable", "false"), 0.0).otherwise(low.try_cast("double"))


def expert_score(*candidates: Column) -> tuple[Column, Column]:
    """(s, valid) by the first candidate that resolves; 0.5 and false if none does."""
    s = F.coalesce(*[word_score(c) for c in candidates])
    return F.coalesce(s, F.lit(0.5)), s.isNotNull()


def check(df: DataFrame, condition: Column, message: str) -> None:
    """Raises if any row breaks the condition; NULL breaks it."""
    bad = df.filter(~F.coalesce(condition, F.lit(False))).limit(1).collect()
    if bad:
        raise ContractError(f"{message}: {bad[0].asDict()}")


def check_unique(df: DataFrame, *keys: str) -> None:
    bad = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if bad:
        raise ContractError(f"duplicate {keys}: {bad[0].asDict()}")


def unpivot_records(df: DataFrame, arm: str, extra: list[str] | None = None) -> DataFrame:
    """Wide records (id, target, pred_x, valid_x, raw_x) to (id, target, arm, condition, prediction, is_valid, raw).

    A prediction that isn't valid is NULL; raw text is never made up; duplicates, missing targets and non-binary
    predictions raise.
    """
    extra = extra or []
    check(df, F.col("target").isin(0, 1), "target must be 0 or 1")
    out = None
    for suffix, condition in CONDITIONS[arm].items():
        if f"pred_{suffix}" not in df.columns:
            continue
        pred = F.col(f"pred_{suffix}").cast("int")
        ok = F.col(f"valid_{suffix}") if f"valid_{suffix}" in df.columns else pred.isNotNull()
        raw = F.col(f"raw_resp_{suffix}") if f"raw_resp_{suffix}" in df.columns else F.lit(None).cast("string")
        rows = df.select("id", "target", *extra, F.lit(arm).alias("arm"), F.lit(condition).alias("condition"), F.when(ok, pred).alias("prediction"), ok.alias("is_valid"), raw.alias("raw"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ContractError(f"no prediction columns of arm {arm}")
    check(out, F.col("prediction").isNull() | F.col("prediction").isin(0, 1), "prediction must be 0 or 1")
    check_unique(out, "id", "arm", "condition")
    return out


def align_exactly(left: DataFrame, right: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Full-outer summary of two tables that must agree: missing, extra and conflicting rows."""
    a = left.select(key, *[F.col(c).alias(f"l_{c}") for c in same], F.lit(True).alias("in_l"))
    b = right.select(key, *[F.col(c).alias(f"r_{c}") for c in same], F.lit(True).alias("in_r"))
    both = F.col("in_l").isNotNull() & F.col("in_r").isNotNull()
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("in_r").isNull()).alias("missing"), F.count_if(F.col("in_l").isNull()).alias("extra"), F.count_if(both & differs).alias("conflicts"), F.count_if(both).alias("matched"))


def lookup_chain(df: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value of the first key that finds a row: a left join for each key, never a join on OR."""
    out = df
    for i, k in enumerate(keys):
        side = table.select(F.col(k).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")).dropDuplicates([f"_k{i}"])
        out = out.join(side, out[k] == side[f"_k{i}"], "left").drop(f"_k{i}")
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))])).drop(*[f"_v{i}" for i in range(len(keys))])


def band_widths(base: float = 0.1, most: float = 2.0) -> list[float]:
    out, w = [], base
    while w <= most:
        out.append(w)
        w *= 2
    return out


def band_join(queries: DataFrame, donors: DataFrame, size: str = "n") -> DataFrame:
    """For each query the donors whose size is in [floor(n(1-w)), ceil(n(1+w))] at the least w of 0.1, 0.2, ... that has any.

    Donors are summed by size first; the range join runs over the distinct sizes of both sides (bounded by the largest
    size), never over pairs of rows. The choice among a size's donors is seeded by the query's id.
    """
    sizes = donors.groupBy(F.col(size).alias("d_size")).agg(F.count("*").alias("n_donors"))
    wanted = queries.select(F.col(size).alias("q_size")).distinct()
    widths = F.explode(F.array(*[F.lit(w) for w in band_widths()]))
    bands = wanted.withColumn("w", widths).withColumn("lo", F.floor(F.col("q_size") * (1 - F.col("w")))).withColumn("hi", F.ceil(F.col("q_size") * (1 + F.col("w"))))
    hit = bands.join(sizes, (F.col("d_size") >= F.col("lo")) & (F.col("d_size") <= F.col("hi"))).groupBy("q_size", "w").agg(F.sum("n_donors").alias("n_donors"), F.min("d_size").alias("least"), F.max("d_size").alias("most"))
    best = hit.groupBy("q_size").agg(F.min_by(F.struct("w", "n_donors", "least", "most"), "w").alias("b"))
    return queries.join(best.select(F.col("q_size").alias(size), "b.*"), size, "left")


def interval_join(points: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """Points (key, at) with the intervals [lo, hi) of their key that hold them, by an equi-join on cells of ``width``."""
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col("at") / width)).join(cells, ["key", "_cell"]).filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).drop("_cell")


def sample_per_group(df: DataFrame, key: str, by: list[str], n: int, seed: str) -> DataFrame:
    """n rows of each group by hash of seed and id: the same rows for any partitioning."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(order, key))).filter(F.col("_r") <= n).drop("_r")


def stratified(df: DataFrame, key: str, by: str, ratio: float, seed: str) -> DataFrame:
    """max(1, floor(n ratio)) rows of each class by hash order."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    sizes = df.groupBy(by).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(ratio))).alias("_quota"))
    return df.join(sizes, by).withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(order, key))).filter(F.col("_r") <= F.col("_quota")).drop("_r", "_quota")


def proportional(df: DataFrame, key: str, by: str, n: int, seed: str) -> DataFrame:
    """n rows in proportion to the classes: quotas by largest remainder, ties by class."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 1
    sizes = sizes.withColumn("_exact", F.col("_n") * F.lit(float(n)) / F.lit(float(total))).withColumn("_base", F.floor("_exact"))
    left = n - (sizes.agg(F.sum("_base")).first()[0] or 0)
    extra = F.row_number().over(W.orderBy(F.desc(F.col("_exact") - F.col("_base")), by)) <= left
    sizes = sizes.withColumn("_quota", F.col("_base") + extra.cast("int")).select(by, "_quota")
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return df.join(sizes, by).withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(order, key))).filter(F.col("_r") <= F.col("_quota")).drop("_r", "_quota")


def positions(df: DataFrame, key: str, ranges: int = 64) -> DataFrame:
    """df with its place (from 0) in the order of a number key: ranks within ranges of the key, and the sizes of those before."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    part = F.floor((F.col(key) - F.lit(lo or 0)) * ranges / F.lit(max(1, (hi or 0) - (lo or 0) + 1)))
    df = df.withColumn("_part", part)
    ahead = df.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    return df.withColumn("_own", own).join(ahead, "_part").withColumn("position", F.col("_own") + F.col("_ahead")).drop("_part", "_own", "_ahead")


def positional_join(rows: DataFrame, manifest: DataFrame, same: dict[str, str], position: str = "position") -> DataFrame:
    """rows beside the manifest row of their position. Both sides have every position once, and the columns of ``same`` (row to
    manifest) agree, or it raises: a row is never matched by anything but its place."""
    right = manifest.select(*[F.col(c).alias(f"_m_{c}") for c in manifest.columns])
    both = rows.join(right, F.col(position) == F.col(f"_m_{position}"), "full_outer")
    wrong = F.col(position).isNull() | F.col(f"_m_{position}").isNull()
    for a, b in same.items():
        wrong = wrong | ~F.col(a).eqNullSafe(F.col(f"_m_{b}"))
    n, m, joined, bad = rows.count(), manifest.count(), *both.agg(F.count("*"), F.count_if(wrong)).first()
    if not n == m == joined or bad:
        raise ContractError(f"{bad} of {joined} positions differ between {n} rows and {m} manifest rows")
    return both.drop(f"_m_{position}", *[f"_m_{b}" for b in same.values()]).withColumnsRenamed({f"_m_{c}": c for c in manifest.columns if c not in rows.columns})


def report_readiness(graphs: DataFrame, stored: DataFrame, recomputed: DataFrame, keys: DataFrame, digits: int = 4) -> DataFrame:
    """check, n, failed: edges shown with an end outside the nodes shown, stored metrics that differ, label-conditioned reviews.

    graphs: id, nodes, edges. stored, recomputed: metric, value. keys: target_label, demo_label.
    """
    shown = F.transform(F.slice("nodes", 1, 25), lambda n: n["id"])
    dangling = F.exists(F.slice("edges", 1, 25), lambda e: ~F.array_contains(shown, e["start"]) | ~F.array_contains(shown, e["end"]))
    a = graphs.agg(F.lit("edge_outside_shown_nodes").alias("check"), F.count("*").alias("n"), F.count_if(dangling).alias("failed"))
    both = stored.join(recomputed.select("metric", F.col("value").alias("_again")), "metric", "full_outer")
    b = both.agg(F.lit("stored_metric_differs").alias("check"), F.count("*").alias("n"), F.count_if(~F.round("value", digits).eqNullSafe(F.round("_again", digits))).alias("failed"))
    c = keys.agg(F.lit("demo_label_follows_target").alias("check"), F.count("*").alias("n"), F.count_if(F.col("target_label") == F.col("demo_label")).alias("failed"))
    return a.unionByName(b).unionByName(c)


def adjudicate(first: DataFrame, second: DataFrame, full: DataFrame, revised: DataFrame) -> DataFrame:
    """id, first_choice, second_choice, choice, changed, agreed: the decision on two review sheets.

    Sheets: id, snippet, choice. full: id, func. revised: id, choice. The sheets must have the same ids and snippets (line
    ends aside), each snippet up to its cut mark must begin its function, and choices must be A, B, Equal or Neither.
    """
    norm = lambda c: F.replace(F.replace(F.col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    side = lambda df, n: df.select("id", norm("snippet").alias(f"{n}_snippet"), F.col("choice").alias(f"{n}_choice"))
    both = side(first, "first").join(side(second, "second"), "id", "full_outer").join(full.select("id", norm("func").alias("_func")), "id", "left").join(revised.select("id", F.col("choice").alias("_new")), "id", "left")
    head = F.rtrim(F.substring_index("first_snippet", "/* ... [", 1))
    choice = F.coalesce("_new", "first_choice")
    known = ("A", "B", "Equal", "Neither")
    bad = ~F.col("first_snippet").eqNullSafe(F.col("second_snippet")) | ~F.coalesce(F.startswith("_func", head), F.lit(False)) | ~F.coalesce(choice.isin(*known), F.lit(False))
    n = both.filter(bad).count()
    if n or first.select("id").distinct().count() != first.count():
        raise ContractError(f"{n} reviews differ between sheets, from their function or from the choices")
    return both.select("id", "first_choice", "second_choice", choice.alias("choice"), (choice != F.col("first_choice")).alias("changed"), (F.col("first_choice") == F.col("second_choice")).alias("agreed"))


def inside(nodes: Column, edges: Column) -> Column:
    """Edges whose ends are both among nodes. Bound by a lambda, the ids are listed once and not for each edge."""
    ids = F.array(F.transform(nodes, lambda x: x["id"]))
    return F.element_at(F.transform(ids, lambda own: F.filter(edges, lambda e: F.array_contains(own, e["start"]) & F.array_contains(own, e["end"]))), 1)


def graph_prefix(nodes: Column, edges: Column, n: int, m: int) -> tuple[Column, Column]:
    """First n nodes, then the first m edges whose ends are both kept."""
    kept = F.slice(nodes, 1, n)
    return kept, F.slice(inside(kept, edges), 1, m)


# Heads of the two parts of a graph's text, and what stands for an empty part.
NODE_HEAD = "The node information of the code snippet is as follows:"
EDGE_HEAD = "The edge information of the code snippet is as follows:"
NO_NODES, NO_EDGES = "[No Node Information Available]", "[No Edge Information Available]"
SHOWN_CODE = 40


def node_lines(nodes: Column) -> Column:
    def line(n):
        code = F.replace(F.trim(F.coalesce(n["code"], F.lit(""))), F.lit("\n"), F.lit(" "))
        shown = F.when(F.char_length(code) > SHOWN_CODE, F.concat(F.substring(code, 1, SHOWN_CODE), F.lit("..."))).otherwise(code)
        return F.concat(F.lit("Node "), n["id"], F.lit(": ("), n["type"], F.lit(")"), F.when(shown == "", "").otherwise(F.concat(F.lit(" '"), shown, F.lit("'"))))

    return F.transform(nodes, line)


def edge_lines(edges: Column) -> Column:
    return F.transform(edges, lambda e: F.concat(F.lit("Edge: Node "), e["start"], F.lit(" -> "), e["type"], F.lit(" -> Node "), e["end"]))


def graph_text(nodes: Column, edges: Column) -> Column:
    """Heads, and a line for each node and edge."""
    part = lambda lines, empty: F.when(F.size(lines) == 0, F.lit(empty)).otherwise(F.array_join(lines, "\n"))
    return F.concat_ws("\n", F.lit(NODE_HEAD), part(node_lines(nodes), NO_NODES), F.lit(EDGE_HEAD), part(edge_lines(edges), NO_EDGES))


def fitting_nodes(nodes: Column, edges: Column, budget_chars: int) -> Column:
    """How many first nodes, with the edges among them, a text of ``budget_chars`` holds; at least 1.

    Lengths of lines are taken once, and the length of a text grows with its nodes, so the count is found by halving. An
    edge comes with the later of its ends; no line of a node is shorter than 10 characters, so no more nodes than that fit.
    """
    nodes = F.slice(nodes, 1, budget_chars // 10 + 1)
    ends = lambda ids, e: F.struct(F.array_position(ids, e["start"]).alias("a"), F.array_position(ids, e["end"]).alias("b"), F.char_length(F.concat(e["start"], e["type"], e["end"])).alias("size"))
    found = F.element_at(F.transform(F.array(F.transform(nodes, lambda n: n["id"])), lambda ids: F.transform(edges, lambda e: ends(ids, e))), 1)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def count(sizes):
        n_lines, e_lines = sizes["nodes"], sizes["edges"]

        def length(k):
            near = F.aggregate(e_lines, F.lit(0), lambda a, e: a + F.when(e["at"] <= k, e["size"]).otherwise(0))
            return F.lit(len(NODE_HEAD) + len(EDGE_HEAD) + 2) + total(F.slice(n_lines, F.lit(1), k)) + F.when(near == 0, len(NO_EDGES)).otherwise(near - 1)

        most = F.greatest(F.size(n_lines), F.lit(1))
        steps = F.sequence(F.lit(1), F.lit((budget_chars // 10 + 1).bit_length() + 1))

        def halve(x, _):
            def side(mid):
                fits = F.array(length(mid) <= budget_chars)
                return F.element_at(F.transform(fits, lambda f: F.struct(F.when(f, mid).otherwise(x["lo"]).alias("lo"), F.when(f, x["hi"]).otherwise(F.greatest(mid - 1, x["lo"])).alias("hi"))), 1)

            return F.element_at(F.transform(F.array(F.floor((x["lo"] + x["hi"] + 1) / 2).cast("int")), side), 1)

        return F.aggregate(steps, F.struct(F.lit(1).alias("lo"), most.alias("hi")), halve)["lo"]

    both = F.transform(F.filter(found, lambda e: (e["a"] > 0) & (e["b"] > 0)), lambda e: F.struct(F.greatest(e["a"], e["b"]).alias("at"), (e["size"] + len("Edge: Node  ->  -> Node ") + 1).alias("size")))
    sizes = F.struct(F.transform(node_lines(nodes), lambda x: F.char_length(x) + 1).alias("nodes"), both.alias("edges"))
    # Bound by a lambda, the lengths are made once and not for each prefix.
    return F.element_at(F.transform(F.array(sizes), count), 1)
