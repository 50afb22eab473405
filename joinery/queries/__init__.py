"""Queries over the driver's tables, and the same as DuckDB SQL."""

from joinery.queries import bounds, documents, evaluation, graphs, scalars, strings

_MODULES = (strings, graphs, bounds, documents, scalars, evaluation)


def queries() -> dict:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
