"""Evaluate a costly expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` evaluated once per row.

    The optimiser copies a column's expression to every place that mentions it;
    as the variable of a one-element array it stays a single evaluation.
    """
    return F.transform(F.array(value), body)[0]
