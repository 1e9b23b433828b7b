"""Values that an expression uses more than once, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row.

    An expression that stands twice in a column, or once inside a lambda, is computed twice, or for every element;
    the optimizer also moves columns into the expressions that use them. The one element of an array stays bound.
    """
    return F.element_at(F.transform(F.array(value), use), 1)
