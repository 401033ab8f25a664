"""All registered queries."""

from __future__ import annotations

import importlib
from functools import wraps

from ledgerloom.plans.registry import ORACLES, QUERIES, Query
from ledgerloom.session import prepare

MODULES = ("fact_queries", "evaluation_queries", "document_queries", "history_queries", "log_queries", "streaming_queries")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"ledgerloom.plans.{module}")


def _prepared(function: Query) -> Query:
    @wraps(function)
    def run(spark, sf_dir):
        return function(prepare(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    _load()
    return {name: _prepared(function) for name, function in QUERIES.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
