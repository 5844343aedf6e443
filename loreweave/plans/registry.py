"""Every query of the engine by name, and the SQL that checks it."""

from __future__ import annotations

from . import edit_queries, graph_queries, notes_queries, record_queries, resolve_queries, review_queries, search_queries, vault_queries

PARTS = (search_queries, graph_queries, review_queries, vault_queries, resolve_queries, edit_queries, notes_queries, record_queries)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ROWS_ONLY = (*resolve_queries.ROWS_ONLY, *record_queries.ROWS_ONLY)
SQL = {k: v for p in PARTS for k, v in p.SQL.items()}
