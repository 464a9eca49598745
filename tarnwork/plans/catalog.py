"""All queries over the library's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import assembly_queries, field_queries, layout_queries, log_queries, stat_queries, study_queries, text_queries

_MODULES = (text_queries, log_queries, layout_queries, stat_queries, field_queries, assembly_queries, study_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
