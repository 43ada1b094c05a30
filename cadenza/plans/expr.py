"""Expression trees over entity-month panels: constructors, a small formula language, and interning.

A formula is written like ordinary arithmetic: ``A.at`` is a column of dataset A, ``x[t-12]`` a calendar lag,
``IU.meanest.where(fpi=1)`` a filtered column, ``op(x, y, k=3)`` an operator, and names refer to shared formulas.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import blake2b
from typing import Any


@dataclass(frozen=True)
class Expr:
    """A node: ``kind`` is var (dataset, column, filter), const (value) or op (name, arguments, parameters)."""

    kind: str
    name: str = ""
    args: tuple[Expr, ...] = ()
    params: tuple[tuple[str, Any], ...] = ()
    value: Any = field(default=None)

    @cached_property
    def key(self) -> str:
        """Structural hash: equal trees have equal keys."""
        parts = [self.kind, self.name, repr(self.params), repr(self.value), *(a.key for a in self.args)]
        return blake2b("\x1f".join(parts).encode(), digest_size=12).hexdigest()

    def nodes(self) -> dict[str, Expr]:
        """Distinct nodes below and including this one, arguments first."""
        found: dict[str, Expr] = {}
        stack = [(self, False)]
        while stack:
            node, ready = stack.pop()
            if node.key in found:
                continue
            if ready:
                found[node.key] = node
            else:
                stack.append((node, True))
                stack += [(a, False) for a in reversed(node.args)]
        return found

    @cached_property
    def reach(self) -> int:
        """Months after an input row for which this tree may have values."""
        own = 0
        p = dict(self.params)
        if self.name in ("lag", "delta", "time_lagged_value"):
            own = int(p.get("n", p.get("months", 0)))
        elif "lags" in p:
            own = max(p["lags"])
        elif "window_months" in p:
            own = int(p["window_months"]) - 1
        elif self.name in _REACH:
            own = _REACH[self.name]
        return own + max((a.reach for a in self.args), default=0)


# Months by which these operators look back.
_REACH = {
    "earnings_consistency": 72, "seasonal_surprise_zscore": 60, "weighted_lagged_rank_growth": 72, "total_accruals_signal": 12, "gr_ltnoa": 12, "hire_growth": 12,
    "surprise_rd_indicator": 12, "bmdec_signal": 17, "industry_weighted_momentum": 5, "firm_age_momentum": 5, "momentum_reversal_signal": 36, "momentum_volume_signal": 6,
    "share_volume_signal": 2, "intangible_residual": 60, "piotroski_score": 12, "netpayout_yield_signal": 6, "payout_yield_signal": 6, "exchange_switch_indicator": 12,
    "ffill": 600, "market_equity_matched_to_datadate": 600, "rolling_trend_slope_scaled": 600,
}


def V(dataset: str, column: str, **where: Any) -> Expr:
    return Expr("var", f"{dataset}.{column}", params=tuple(sorted(where.items())))


def C(value: float) -> Expr:
    return Expr("const", value=float(value))


def O(name: str, *args: Expr, **params: Any) -> Expr:
    frozen = tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in params.items()))
    return Expr("op", name, tuple(args), frozen)


def lag(x: Expr, n: int) -> Expr:
    return O("lag", x, n=n)


_ARITHMETIC: dict[type, str] = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div"}


class _Reader:
    def __init__(self, shared: Mapping[str, Expr], datasets: Mapping[str, str]):
        self.shared, self.datasets = shared, datasets

    def read(self, node: ast.expr) -> Expr:
        handler: Callable[[Any], Expr] = getattr(self, f"on_{type(node).__name__}")
        return handler(node)

    def on_Constant(self, node: ast.Constant) -> Expr:
        return C(node.value)

    def on_Name(self, node: ast.Name) -> Expr:
        return self.shared[node.id]

    def on_UnaryOp(self, node: ast.UnaryOp) -> Expr:
        if isinstance(node.operand, ast.Constant):
            return C(-node.operand.value)
        return O("mul", C(-1), self.read(node.operand))

    def on_BinOp(self, node: ast.BinOp) -> Expr:
        if isinstance(node.op, ast.Pow):
            return O("pow", self.read(node.left), power=ast.literal_eval(node.right))
        return O(_ARITHMETIC[type(node.op)], self.read(node.left), self.read(node.right))

    def on_Attribute(self, node: ast.Attribute) -> Expr:
        return V(self.datasets.get(node.value.id, node.value.id), node.attr)

    def on_Subscript(self, node: ast.Subscript) -> Expr:
        """x[t - n]"""
        return lag(self.read(node.value), ast.literal_eval(node.slice.right))

    def on_Call(self, node: ast.Call) -> Expr:
        params = {k.arg: ast.literal_eval(k.value) for k in node.keywords if not isinstance(k.value, ast.Attribute | ast.Call | ast.Name)}
        named = [k.value for k in node.keywords if isinstance(k.value, ast.Attribute | ast.Call | ast.Name)]
        if isinstance(node.func, ast.Attribute) and node.func.attr == "where":
            leaf = self.on_Attribute(node.func.value)
            return Expr("var", leaf.name, params=tuple(sorted(params.items())))
        args = list(map(self.read, [*node.args, *named]))
        if node.func.id == "average":
            return O("div", O("add", *args), C(len(args)))
        return O(node.func.id, *args, **params)


def parse(formula: str, shared: Mapping[str, Expr] | None = None, datasets: Mapping[str, str] | None = None) -> Expr:
    return _Reader(shared or {}, datasets or {}).read(ast.parse(formula.strip(), mode="eval").body)


def distinct_nodes(trees: Mapping[str, Expr]) -> tuple[int, int]:
    """Number of node instances and of distinct nodes of a set of trees."""
    count = lambda x: 1 + sum(map(count, x.args))
    merged: dict[str, Expr] = {}
    for x in trees.values():
        merged |= x.nodes()
    return sum(map(count, trees.values())), len(merged)
