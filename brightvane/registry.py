"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "i08_theme_trends"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def keep(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _queries[function.__name__] = function
        if oracle is not None:
            _oracles[function.__name__] = oracle
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .plans import load

    load()
    return _queries


def oracle_sql() -> dict[str, str]:
    queries()
    return _oracles
