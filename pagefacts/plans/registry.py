"""All registered queries and their oracle SQL."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagefacts.session import tune

_MODULES = ("page_queries", "tree_queries", "binding_queries", "session_queries", "package_queries", "contract_queries", "stream_queries")


def _modules() -> list:
    return [importlib.import_module(f"pagefacts.plans.{name}") for name in _MODULES]


def _tuned(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(run)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tune(spark), sf_dir)

    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _tuned(run) for module in _modules() for name, run in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: text for module in _modules() for name, text in module.ORACLES.items()}
