"""Registry of named queries (Spark builder + optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def register(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        OPERATORS[name] = ops
        return fn
    return deco


MODULES = ("q_pages", "q_search", "q_votes", "q_store", "q_facets", "q_misc", "q_text", "q_schema", "q_ml", "q_stream",
           "q_more", "q_match", "q_synonyms")
_LOADED: set[str] = set()


def load_all() -> None:
    """Import every plan module so that it registers its queries.

    A module that fails to import leaves the other modules' queries usable and
    stays visible: it is registered as one query that raises its error."""
    for module in MODULES:
        if module in _LOADED:
            continue
        _LOADED.add(module)
        before = set(QUERIES)
        try:
            import_module(f".{module}", __package__)
        except Exception as ex:  # noqa: BLE001 - raised again when the query is called
            for name in set(QUERIES) - before:
                QUERIES.pop(name), ORACLE.pop(name, None), OPERATORS.pop(name, None)
            QUERIES[f"unavailable_{module}"] = _raiser(module, ex)


def _raiser(module: str, error: Exception):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raise ImportError(f"plan module {module} could not be imported") from error
    return run
