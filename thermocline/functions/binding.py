"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written and evaluated once.

    Spark repeats an expression wherever it is used and again in filters it pushes through a
    projection, so expressions that are used several times would grow quickly.
    """
    return F.get(F.transform(F.array(value), body), 0)
