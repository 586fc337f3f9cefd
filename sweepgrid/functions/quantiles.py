"""Exact percentiles and ranks of columns that no single task could hold."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import SETTINGS_ROWS, cut

#: Rows that one aggregate may hold; above, the range around the percentile is narrowed first.
DIRECT = 1_000_000
BUCKETS = 1024


def exact_percentile(df: DataFrame, value: str, q: float, freq: str | None = None, direct: int = DIRECT) -> float | None:
    """The percentile (0 to 1) of a column, linear between ranks, nulls left out; None without values.

    freq: a column with the number of times a row counts. Each pass counts the rows of 1,024 equal
    steps of the range in which the percentile lies and goes on in the step that holds it, so that
    counts are all that is shuffled; what is left at the end fits the built-in aggregate.
    """
    v, w = F.col(value).cast("double"), (F.col(freq) if freq else F.lit(1)).cast("long")
    rows = df.select(v.alias("v"), w.alias("w")).where("v IS NOT NULL AND w > 0")
    got = rows.agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not got["n"]:
        return None
    place, below, inside, lo, hi, many = q * (got["n"] - 1), 0, got["n"], got["lo"], got["hi"], got["rows"]
    while many > direct and lo < hi:
        step = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit((hi - lo) / BUCKETS)), F.lit(BUCKETS - 1))
        counts = rows.where(F.col("v").between(lo, hi)).groupBy(step.alias("b")).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        at, first = below, None
        for c in counts:
            if first is None and at + c["n"] > math.floor(place):
                first, low, new_rows = at, c["lo"], 0
            if first is not None:
                high, new_rows = c["hi"], new_rows + c["rows"]
                if at + c["n"] > math.ceil(place):
                    break
            at += c["n"]
        inside = at + c["n"] - first
        if new_rows == many:  # nothing is narrowed any more: a few values hold all rows
            break
        below, lo, hi, many = first, low, high, new_rows
    if lo == hi:
        return float(lo)
    share = (place - below) / max(inside - 1, 1)
    return float(rows.where(F.col("v").between(lo, hi)).agg(F.percentile("v", min(max(share, 0.0), 1.0), F.col("w"))).first()[0])


#: Passes after which narrowing ends, if so many rows share a few values that it gets no further.
PASSES = 12


def percentiles_by(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str], freq: str | None = None, direct: int = DIRECT) -> DataFrame:
    """One row (by, p: the percentiles in the order of at) for each group that has a value; linear between ranks, nulls left out.

    The ranges of all groups are narrowed together: a pass counts the rows of 1,024 equal steps of each range that still
    holds more than direct rows, and keeps the steps around the percentile. Only counts and ranges are
    shuffled, partial sums first; no task holds a group. What is left of a range is put in order by its distinct values.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    v, w = F.col(value).cast("double"), (F.col(freq) if freq else F.lit(1)).cast("long")
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), v.alias("v"), w.alias("w")).where("v IS NOT NULL AND w > 0")
    found = rows.groupBy(*keys).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at)]))
    state = found.withColumn("s", wanted).select(*keys, "s.i", (F.col("s.q") * (F.col("n") - 1)).alias("place"), F.lit(0).cast("long").alias("below"), "lo", "hi", "rows")
    state = cut(state)

    def inside(ranges: DataFrame) -> DataFrame:
        named = ranges.select(*(F.col(k).alias(f"{k}r") for k in keys), "i", "place", "below", "lo", "hi")
        named = F.broadcast(named) if named.limit(SETTINGS_ROWS + 1).count() <= SETTINGS_ROWS else named
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}r"))
        return rows.join(named, on).where("v >= lo AND v <= hi").drop(*(f"{k}r" for k in keys))

    for _ in range(PASSES):
        wide = (F.col("rows") > direct) & (F.col("lo") < F.col("hi"))
        if state.where(wide).isEmpty():
            break
        step = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / BUCKETS)), F.lit(BUCKETS - 1))
        counts = inside(state.where(wide)).withColumn("b", step).groupBy(*keys, "i", "place", "below", "b").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # As many rows of a range as steps, so that its sums run in one task.
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "i").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("n"))
        kept = counts.where((F.col("upto") > F.floor("place")) & (F.col("start") <= F.ceil("place")))
        narrowed = kept.groupBy(*keys, "i", "place").agg(F.min("start").alias("below"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"))
        state = cut(state.where(~wide).unionByName(narrowed.select(state.columns)))
    left = inside(state).groupBy(*keys, "i", "place", "below", "v").agg(F.sum("w").alias("w"))
    upto = F.col("below") + F.sum("w").over(Window.partitionBy(*keys, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = left.withColumn("upto", upto).groupBy(*keys, "i", "place").agg(F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v"))).alias("b"))
    share = F.col("place") - F.floor("place")
    each = ends.select(*keys, "i", (F.col("a") + share * (F.col("b") - F.col("a"))).alias("p"))
    listed = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "p"))).alias("p"))
    return listed.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), F.transform("p", lambda x: x["p"]).alias("p"))


def ranked(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with its rank (from 1) in an order of all rows, as a long. Only counts of ranges of the order pass one task."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = cut(df.withColumns({f"__key{i}": c for i, c in enumerate(keys)}).repartitionByRange(*(f"__key{i}" for i in range(len(keys)))).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy(*(f"__key{i}" for i in range(len(keys))))
    numbered = ranges.withColumn(out, F.row_number().over(within)).join(F.broadcast(starts), "__part")
    return numbered.withColumn(out, F.col(out) + F.col("__start")).drop("__part", "__start", *(f"__key{i}" for i in range(len(keys))))
