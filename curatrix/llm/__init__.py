"""Operators of a training-data pipeline. Nothing else in this library imports this subpackage."""

from __future__ import annotations

import importlib

#: The modules that hold the queries, in their order.
MODULES = ("media", "toxicity", "pii", "decontaminate", "shards", "quality", "jaccard", "lines", "secrets", "mixture", "divergence", "alignment", "urls")


def queries() -> dict:
    """Name to query, ``(spark, sf_dir) -> DataFrame``."""
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {k: q for m in MODULES for k, q in importlib.import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
