"""The registry of the library's own queries and their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = ("curatrix.plans.queries", "curatrix.plans.audio", "curatrix.plans.exports", "curatrix.plans.states", "curatrix.plans.more")


def queries() -> dict:
    """Name to query, ``(spark, sf_dir) -> DataFrame``."""
    return {k: f for m in MODULES for k, f in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {k: q for m in MODULES for k, q in importlib.import_module(m).ORACLE_SQL.items()}
