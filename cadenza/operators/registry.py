"""Names of operators and the functions that apply them to a stage."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column

from cadenza.plans.stage import Stage

Operator = Callable[..., Column]
OPERATORS: dict[str, Operator] = {}

#: Operators that write rows of the stage (``residuals_by_month``) while a query is built.
WRITING = ("intangible_residual",)


def operator(fn: Operator) -> Operator:
    """Register a function (stage, *columns, **parameters) -> column under its own name."""
    OPERATORS[fn.__name__.rstrip("_")] = fn
    return fn


def apply(name: str, stage: Stage, *args: Column, **params: Any) -> Column:
    if name not in OPERATORS:
        raise KeyError(f"unknown operator {name}")
    return OPERATORS[name](stage, *args, **params)
