"""All queries of the engine, with DuckDB SQL beside each where SQL can express it."""

from __future__ import annotations

from . import analysis, evaluation, retrieval, tables, texts
from ._bind import ORACLES, QUERIES

MODULES = (evaluation, retrieval, tables, texts, analysis)
FLAGSHIP = "knn_jaccard_rerank"
__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
