"""All core queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.plans import catalogue, corpus, flow, papers, search, texts


def _all() -> dict:
    out: dict = {}
    for module in (corpus, catalogue, texts, papers, search, flow):
        out.update(module.query_map())
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
