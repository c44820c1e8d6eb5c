"""Every query of the analysis operators over the given tables, with its DuckDB SQL."""

from __future__ import annotations

from panelforge.plans import basics, file_queries, model_queries, series_queries

QUERIES = basics.QUERIES | series_queries.QUERIES | model_queries.QUERIES | file_queries.QUERIES
SQL = basics.SQL | series_queries.SQL | model_queries.SQL | file_queries.SQL
