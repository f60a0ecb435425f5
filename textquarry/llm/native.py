"""Column helpers for operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once a row even where the body uses it inside a loop over an array."""
    return F.element_at(F.transform(F.array(value), body), 1)
