"""Values computed once within an expression.

Spark inlines a column wherever it is used, so an expression that uses a costly part five times computes it five times,
and nested ones multiply. A lambda's variable is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the value, which is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(body: Callable[[Column], Column], **values: Column) -> Column:
    """`body` of a struct of the values."""
    return let(F.struct(*(v.alias(k) for k, v in values.items())), body)
