"""Arrow UDFs that may be declared before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_udf(returns: str) -> Callable:
    """As ``pandas_udf``, but the UDF is made when it is first applied to columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def on(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return on

    return wrap


def array_udf(returns: str) -> Callable:
    """As ``arrow_udf``, made when it is first applied to columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def on(*columns) -> Column:
            return F.arrow_udf(f, returns)(*columns)

        return on

    return wrap
