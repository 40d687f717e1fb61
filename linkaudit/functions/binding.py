"""Evaluate an expression once and use its value many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the body loops over it.

    Inside the lambda of an array function a plain expression would be computed per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
