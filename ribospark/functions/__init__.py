"""Column functions: expressions that stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A plain column expression that a lambda mentions is evaluated anew for every element; bound this way it isn't.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
