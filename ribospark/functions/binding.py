"""Evaluate a column once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row.

    Inside a lambda an outer expression would be computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)
