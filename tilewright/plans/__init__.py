"""Queries over the star-schema tables, one for each operator or group of operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tilewright.plans import convolution, detection, metrics

MODULES = (detection, metrics, convolution)


def all_queries() -> dict[str, Callable]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
