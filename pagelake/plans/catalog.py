"""Every query of the retrieval engine by name, with its DuckDB counterpart."""

from . import queries_assembly, queries_blocks, queries_runs, queries_search, queries_state

_MODULES = (queries_search, queries_state, queries_runs, queries_blocks, queries_assembly)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
