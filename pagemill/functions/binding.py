"""Evaluating an expression once where it is used several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value`` computed once per row.

    The optimizer inlines plain columns into the lambdas that use them, where
    they are evaluated per element; a lambda variable is not inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
