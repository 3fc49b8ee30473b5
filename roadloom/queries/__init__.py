"""The reference queries: Spark callables by name, and DuckDB SQL with the same result where SQL can say it."""

from roadloom.queries import files, graphs, scalars, shapes, structure, tables

_ALL = (scalars, tables, graphs, structure, shapes, files)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _ALL for k, v in m.ORACLE_SQL.items()}
