"""Column functions that steps share."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_as_null(column: Any) -> Column:
    """NaN becomes null, as frames from pandas use it for "missing"."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def absolute_error(a: Any, b: Any) -> Column:
    return F.abs(F.col(a) - F.col(b))


def tag(value: Any) -> Column:
    """The constant column of a parameter's value."""
    from stepwell.operators.concat import literal

    return literal(value)
