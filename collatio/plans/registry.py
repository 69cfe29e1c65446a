"""Name → query and name → DuckDB SQL for the engine's own operators."""

from __future__ import annotations

from collatio.plans import align_queries, matrix_queries, text_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (matrix_queries, text_queries, align_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
