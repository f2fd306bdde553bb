"""Constant tables as single SQL expressions: one call instead of one for each value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(x: str | int) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant_map(table: dict[str, str] | dict[str, int]) -> Column:
    """A map of constants; Spark folds it into one literal."""
    return F.expr("map(" + ", ".join(_literal(v) for pair in table.items() for v in pair) + ")")


def look_up(table: dict[str, str] | dict[str, int], x: Column) -> Column:
    """Value of a constant table; null if x is not in it."""
    return F.try_element_at(constant_map(table), x)
