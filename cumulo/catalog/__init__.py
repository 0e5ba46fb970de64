"""Registered queries over the given tables, with check SQL where it exists."""

from cumulo.catalog import geometry, results, sets, surfaces

MODULES = (geometry, sets, results, surfaces)


def all_queries() -> dict:
    return {name: build for module in MODULES for name, build in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
