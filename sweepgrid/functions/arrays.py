"""Lines of a grid as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense(pairs: str, n: Column) -> Column:
    """Pairs (i, v) as an array of n values by position; what is absent is 0."""
    full = F.transform(F.sort_array(pairs), lambda x: x["v"])
    places = F.map_from_entries(pairs)
    filled = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(places, i), F.lit(0.0)))
    return F.when(F.size(pairs) == n, full).when(n > 0, filled).otherwise(F.array().cast("array<double>"))


def lines(stack: DataFrame, axis: str, others: Sequence[str], n: Column | None = None) -> DataFrame:
    """stack (others, axis, v) as one row (others, line) for each line along the axis.

    n: how many values a line has; as far as its last one goes unless given.
    """
    pairs = stack.groupBy(*others).agg(F.collect_list(F.struct(F.col(axis).alias("i"), F.col("v").cast("double").alias("v"))).alias("px"))
    return pairs.select(*others, dense("px", F.array_max(F.col("px.i")) + 1 if n is None else n).alias("line"))
