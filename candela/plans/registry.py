"""

Each query reads the driver tables of ``sf_dir`` (FIXTURES.md mappings) and
returns a DataFrame; ``ORACLES`` holds the matching DuckDB SQL. Modules of
each family register themselves through ``register``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every family module so all keys are registered."""
    from candela.plans import (  # noqa: F401
        q_sources, q_features, q_snapshot, q_backtest, q_correlation, q_forecast,
        q_alerts, q_ledger, q_wallet, q_scoring, q_reports, q_text, q_streaming, q_analyst)
