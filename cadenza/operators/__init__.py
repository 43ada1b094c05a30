"""Operators by name."""

from cadenza.operators import crosssection, daily, elementwise, masks, relational, timeaxis
from cadenza.operators.registry import OPERATORS, WRITING, apply

__all__ = ["OPERATORS", "WRITING", "apply", "crosssection", "daily", "elementwise", "masks", "relational", "timeaxis"]
