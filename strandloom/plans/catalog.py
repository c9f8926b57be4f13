"""All registered queries of the core, and their SQL where SQL can express them."""

from __future__ import annotations

from strandloom.plans import data_queries, edit_queries, graph_queries, match_queries, source_queries

QUERIES = {**graph_queries.QUERIES, **match_queries.QUERIES, **data_queries.QUERIES, **edit_queries.QUERIES, **source_queries.QUERIES}
ORACLE = {**graph_queries.ORACLE, **match_queries.ORACLE, **data_queries.ORACLE, **edit_queries.ORACLE, **source_queries.ORACLE}
