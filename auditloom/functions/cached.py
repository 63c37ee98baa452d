"""Reuse of Column expressions.

Building a large expression takes many small calls into the JVM. Columns over named inputs do not depend
on a DataFrame, so each is built once per Spark context.
"""

import functools
from collections.abc import Callable

from pyspark import SparkContext


def per_context(build: Callable) -> Callable:
    """Cache what `build` returns for hashable arguments, as long as the Spark context lives."""
    store: dict = {}

    @functools.wraps(build)
    def cached(*args):
        context = SparkContext._active_spark_context
        if context is None:
            return build(*args)
        if store.get("context") is not context:
            store.clear()
            store["context"] = context
        if args not in store:
            store[args] = build(*args)
        return store[args]

    return cached
