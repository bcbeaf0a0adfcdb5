"""Skeleton graphs of C functions, line by line, as Columns: statements under a body, in the order of control flow.

Node ids are places: the function, its parameters, the body, the statements, the exit. So every id and edge follows from
positions in arrays, without a running counter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a statement's first characters name its type; declarations by their type words.
DECLARATION = r"^(?:int|char|void|long|float|double|uint\d+_t|int\d+_t|size_t|bool|struct\s+\w+|\w+_t|\w+\s*\*)\s+\w+"
HEADER_CHARS, STATEMENT_CHARS = 60, 80


def _node(i: Column, kind, code, identifier, is_cfg: bool | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(i.cast("string").alias("id"), lit(kind).alias("type"), lit(code).alias("code"), lit(identifier).alias("identifier"), lit(is_cfg).alias("is_cfg"))


def _edge(a: Column, b: Column, kind: str) -> Column:
    return F.struct(a.cast("string").alias("start"), b.cast("string").alias("end"), F.lit(kind).alias("type"), F.lit("").alias("var"))


def _statement_type(line: Column) -> Column:
    starts = lambda *words: line.rlike(r"^(?:" + "|".join(words) + r")[ (]")
    return (
        F.when(starts("if"), "IfStatement").when(starts("for"), "ForStatement").when(starts("while"), "WhileStatement").when(line.startswith("return"), "ReturnStatement")
        .when(line.rlike(DECLARATION), "IdentifierDeclStatement").when(line.contains("(") & line.contains(")") & ~line.contains("="), "CallExpression").when(line.contains("="), "AssignmentExpr").otherwise("ExpressionStatement")
    )


def _identifier(line: Column, kind: Column) -> Column:
    names = F.regexp_extract_all(line, F.lit(r"\b([a-zA-Z_]\w*)\b"), 1)
    return (
        F.when(kind == "IfStatement", F.trim(F.regexp_extract(line, r"if\s*\((.*)\)", 1))).when(kind == "IdentifierDeclStatement", F.coalesce(F.get(names, F.lit(1)), F.lit("")))
        .when(kind == "CallExpression", F.regexp_extract(line, r"(\w+)\s*\(", 1)).when(kind == "AssignmentExpr", F.regexp_extract(line, r"(\w+)\s*=", 1)).otherwise("")
    )


def skeleton(code) -> Column:
    """struct(nodes, edges) of a function's text. Blank lines, ``//`` lines and lone braces have no node."""
    code = F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit(""))
    every = F.transform(F.split(code, "\n"), lambda x: F.trim(x))
    used = lambda x: (x != "") & ~x.startswith("//")
    lines = F.filter(every, used)
    body = F.filter(F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0))), lambda x: used(x) & ~x.isin("{", "}"))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit("void function()"))
    after = F.get(F.filter(lines, lambda x: ~x.startswith("/*") & ~x.startswith("*") & ~x.endswith("*/") & (x.contains("(") | x.contains("{"))), F.lit(0))
    header = F.when(first.startswith("/*"), F.coalesce(after, first)).otherwise(first)
    inside = F.regexp_extract(header, r"\(([^)]*)\)", 1)
    params = F.filter(F.transform(F.split(inside, ","), lambda p: F.trim(p)), lambda p: p != "")
    parts = F.struct(header.alias("header"), params.alias("params"), body.alias("body"))

    def build(s):
        p, n = F.size(s["params"]), F.size(s["body"])
        named = F.regexp_extract(s["header"], r"(\w+)\s*\([^)]*\)", 1)
        root, compound, leave = F.lit(1), p + 2, p + n + 3
        last = lambda x: F.replace(F.element_at(F.split(x, r"\s+"), -1), F.lit("*"), F.lit(""))
        nodes = F.concat(
            F.array(_node(root, "FunctionDef", F.trim(F.substring(s["header"], 1, HEADER_CHARS)), F.when(named == "", "function").otherwise(named), True)),
            F.transform(s["params"], lambda x, i: _node(i + 2, "Parameter", x, last(x), False)),
            F.array(_node(compound, "CompoundStatement", "{ ... }", "", False)),
            F.transform(s["body"], lambda x, i: _node(compound + i + 1, _statement_type(x), F.trim(F.substring(x, 1, STATEMENT_CHARS)), _identifier(x, _statement_type(x)), True)),
            F.array(_node(leave, "CFGExitNode", "EXIT", "", True)),
        )
        flows = lambda i: F.when(i == 0, root).otherwise(compound + i)
        edges = F.concat(
            F.transform(s["params"], lambda x, i: _edge(root, i + 2, "IS_AST_PARENT")),
            F.array(_edge(root, compound, "IS_AST_PARENT")),
            F.flatten(F.transform(s["body"], lambda x, i: F.array(_edge(compound, compound + i + 1, "IS_AST_PARENT"), _edge(flows(i), compound + i + 1, "FLOWS_TO")))),
            F.array(_edge(flows(n), leave, "FLOWS_TO")),
        )
        return F.struct(nodes.alias("nodes"), edges.alias("edges"))

    return F.element_at(F.transform(F.array(parts), build), 1)
