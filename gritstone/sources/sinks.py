"""Writers. Every write is a Spark job commit: files appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; NaN and infinities become null."""
    finite = [F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*finite).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def canonical_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and numbers of 6 digits."""
    fixed = [F.format_string("%.6f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*fixed).write.mode("overwrite").option("header", True).csv(path)


def append_records(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).json(path)


def markdown_summary(sections: dict[str, DataFrame], most: int = 200) -> str:
    """A section with a table for each small frame; what is beyond ``most`` rows is counted."""
    show = lambda v: "n/a" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    out = []
    for title, df in sections.items():
        rows = df.limit(most + 1).collect()
        lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        lines += ["| " + " | ".join(show(x) for x in r) + " |" for r in rows[:most]]
        out.append("\n".join(lines + (["", f"{df.count() - most} more rows"] if len(rows) > most else [])))
    return "\n\n".join(out) + "\n"


def latex_table(df: DataFrame, columns: list[str], most: int = 10_000) -> str:
    """A table of a small report; one of more than ``most`` rows is refused."""
    def cell(v):
        return "N/A" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)

    held = df.select(*columns).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a report of more than {most} rows")
    rows = [" & ".join(cell(r[c]) for c in columns) + r" \\" for r in held]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(columns) + r" \\", *rows, r"\end{tabular}"])
