"""Arrow-batched column functions that are made when first used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Decorator like ``pandas_udf`` for module-level functions; workers may import the module too."""

    def put(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return put
