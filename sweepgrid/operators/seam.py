"""Frames around the sweep: correlation, repair, closure, cut, blend and angles.

A polar stack is a long table (k, r, p, v): frame, depth row, angle column, value. Where a function takes
``by``, the table may hold many scans, told apart by these columns, which all results carry; settings may then be columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_even, num
from ..functions.scans import increasing
from ..functions.session import beside


def corr_of_sums(n: Column, a: Column, b: Column, ab: Column, aa: Column, bb: Column) -> Column:
    """Pearson correlation from sums; 0 where a side does not vary."""
    va, vb = F.greatest(aa - a * a / n, F.lit(0.0)), F.greatest(bb - b * b / n, F.lit(0.0))
    return (ab - a * b / n) / (F.sqrt(va * vb) + F.lit(1e-12))


def corr_agg(a: Column, b: Column) -> Column:
    """The same as an aggregate over rows that hold both values; partial sums merge before any shuffle."""
    a, b = a.cast("double"), b.cast("double")
    return corr_of_sums(F.count(a).cast("double"), F.sum(a), F.sum(b), F.sum(a * b), F.sum(a * a), F.sum(b * b))


def adjacent_corr(polar: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(k, corr): each frame with the one before it. One shuffle, by pixel; sums by frame are merged from partials."""
    pixel = Window.partitionBy(*by, "r", "p").orderBy("k")
    pairs = polar.withColumn("before", F.lag("v").over(pixel)).where(F.col("before").isNotNull())
    return pairs.groupBy(*by, "k").agg(corr_agg(F.col("before"), F.col("v")).alias("corr"))


def end_corr(polar: DataFrame) -> DataFrame:
    """One row (first_k, last_k, corr): the last frame against the first."""
    ends = polar.agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"))
    rows = polar.join(F.broadcast(ends)).where("k = first_k OR k = last_k")
    both = rows.groupBy("first_k", "last_k", "r", "p").agg(F.max(F.when(F.col("k") == F.col("last_k"), F.col("v"))).alias("a"), F.max(F.when(F.col("k") == F.col("first_k"), F.col("v"))).alias("b"))
    return both.groupBy("first_k", "last_k").agg(corr_agg(F.col("a"), F.col("b")).alias("corr"))


def outlier_frame(polar: DataFrame, threshold: float = 0.90) -> DataFrame:
    """At most one row (k, badness): the inner frame least like its worse neighbour, if below threshold."""
    corr = adjacent_corr(polar)
    after = corr.select((F.col("k") - 1).alias("k"), F.col("corr").alias("next"))
    inner = corr.join(after, "k").select("k", F.least("corr", "next").alias("badness"))
    return inner.agg(F.min(F.struct("badness", "k")).alias("w")).where(F.col("w.badness") < threshold).select("w.k", "w.badness")


def repair_outlier(polar: DataFrame, threshold: float = 0.90) -> DataFrame:
    """The single worst inner frame replaced by the mean of its neighbours."""
    worst = outlier_frame(polar, threshold).select(F.col("k").alias("worst"))
    pixel = Window.partitionBy("r", "p").orderBy("k")
    rows = polar.withColumns({"before": F.lag("v").over(pixel), "after": F.lead("v").over(pixel)}).join(F.broadcast(worst), how="left")
    return rows.select("k", "r", "p", F.when(F.col("k") == F.col("worst"), (F.col("before") + F.col("after")) * 0.5).otherwise(F.col("v")).alias("v"))


def close_duplicate(polar: DataFrame, threshold: float = 0.99, drop: bool = True, always: bool = False) -> DataFrame:
    """If last and first frame agree, both become their mean, and the last goes if drop is set.

    always: the older order, which averages first and tests afterwards.
    """
    ends = end_corr(polar)
    pixel = Window.partitionBy("r", "p").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = (F.first("v").over(pixel) + F.last("v").over(pixel)) * 0.5
    rows = polar.withColumn("mean", mean).join(F.broadcast(ends))
    edge = (F.col("k") == F.col("first_k")) | (F.col("k") == F.col("last_k"))
    if always:
        same = F.lit(True)
        gone = F.lit(True)  # equal ends correlate fully, unless they are constant
    else:
        same = gone = F.col("corr") > threshold
    out = rows.withColumn("v", F.when(edge & same, F.col("mean")).otherwise(F.col("v")))
    if drop:
        out = out.where(~(gone & (F.col("k") == F.col("last_k")) & (F.col("last_k") > F.col("first_k"))))
    return out.select("k", "r", "p", "v")


def depth_roi(dr_mm: float | Column, rows: int | Column, lo: float = 15.0, hi: float = 35.0) -> tuple[Column, Column]:
    """Depth range in mm as rows [r0, r1)."""
    n = num(rows)
    r0 = F.least(F.greatest(half_even(F.lit(lo) / num(dr_mm)), F.lit(0.0)), n - 1)
    r1 = F.least(F.greatest(half_even(F.lit(hi) / num(dr_mm)), r0 + 1), n)
    return r0.cast("int"), r1.cast("int")


def best_cut(polar: DataFrame, r0: int | Column = 0, r1: int | Column = 1 << 30, stride: int = 4, margin: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """One row a scan (cut, score): the frame most like the one before it, away from the ends; (0, -1) below six frames."""
    r0, r1 = (x if isinstance(x, Column) else F.lit(x) for x in (r0, r1))
    frames = polar.groupBy(*by).agg((F.max("k") + 1).alias("n"))
    corr = adjacent_corr(polar.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("p") % stride == 0)), by)
    inner = (F.col("n") >= 6) & (F.col("k") >= margin) & (F.col("k") <= F.col("n") - margin)
    for c in by:
        corr = corr.withColumnRenamed(c, f"__{c}")
        inner = inner & (F.col(c) == F.col(f"__{c}"))
    scored = frames.join(corr, inner, "left")
    best = scored.groupBy(*by, "n").agg(F.max(F.struct(F.col("corr"), (-F.col("k")).alias("minus"))).alias("b"))
    return best.select(*by, F.coalesce(-F.col("b.minus"), F.lit(0)).cast("int").alias("cut"), F.coalesce("b.corr", F.lit(-1.0)).alias("score"))


def roll_frames(df: DataFrame, cut: int | Column, n: int | Column) -> DataFrame:
    """Frames renumbered so that frame cut comes first."""
    cut, n = (x if isinstance(x, Column) else F.lit(x) for x in (cut, n))
    return df.withColumn("k", F.pmod(F.col("k") - cut, n).cast("int"))


def detrend_closure(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(k, dr, dphi) -> with dr_corr, dphi_corr (the line from first to last drift taken off) and the extra shifts."""
    order = Window.partitionBy(*by).orderBy("k")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(whole)
    t = (F.row_number().over(order) - 1) / F.greatest(n - 1, F.lit(1))
    out = sweep
    for c in ("dr", "dphi"):
        first, last = F.first(c).over(whole), F.last(c).over(whole)
        out = out.withColumn(f"{c}_corr", F.col(c) - (first + (last - first) * t))
        out = out.withColumn(f"{c}_extra", F.col(f"{c}_corr") - F.col(c))
    return out


def blend_closure(polar: DataFrame, width: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Raised-cosine blend of the first and last width frames; unchanged if they would meet."""
    n = polar.groupBy(*by).agg((F.max("k") + 1).alias("n"))
    rows = beside(polar.select(*by, "k", "r", "p", "v"), n, by)
    ok = F.col("n") > 2 * width
    slot = F.when(ok & (F.col("k") < width), F.col("k")).when(ok & (F.col("k") >= F.col("n") - width), F.col("k") - F.col("n") + width)
    pair = Window.partitionBy(*by, "slot", "r", "p").orderBy("k")
    rows = rows.withColumn("slot", slot)
    mates = rows.where("slot IS NOT NULL").withColumn("other", F.coalesce(F.lag("v").over(pair), F.lead("v").over(pair)))
    w = 0.5 - 0.5 * F.cos(F.lit(math.pi) * F.col("slot") / width)
    done = mates.select(*by, "k", "r", "p", ((1.0 - w) * F.col("v") + w * F.col("other")).alias("v"))
    return done.unionByName(rows.where("slot IS NULL").select(*by, "k", "r", "p", F.col("v").cast("double").alias("v")))


def unwrap_phase(df: DataFrame, angle: str, order: list[str], by: list[str], out: str) -> DataFrame:
    """Adds out: the angle with jumps of more than pi taken as wraps (a jump of just +pi stays)."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = F.col(angle) - F.lag(angle).over(w)
    wrapped = F.pmod(d + F.pi(), 2 * F.pi()) - F.pi()
    wrapped = F.when((wrapped == -F.pi()) & (d > 0), F.pi()).otherwise(wrapped)
    fix = F.when(F.abs(d) < F.pi(), 0.0).otherwise(wrapped - d)
    sums = F.sum(F.coalesce("__fix", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__fix", fix).withColumn(out, F.col(angle) + sums).drop("__fix")


def rescale_span(df: DataFrame, col: str, order: list[str], by: list[str], span: float, out: str) -> DataFrame:
    """Adds out: col moved to start at 0 and stretched to span; uniform steps where it does not vary."""
    every = Window.partitionBy(*by)
    lo, hi = F.min(col).over(every), F.max(col).over(every)
    uniform = F.lit(span) * (F.row_number().over(every.orderBy(*order)) - 1) / F.count(F.lit(1)).over(every)
    return df.withColumn(out, F.when(hi - lo < 1e-6, uniform).otherwise((F.col(col) - lo) * F.lit(span) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))))


def strictly_increasing(values: Column, eps: float = 1e-6) -> Column:
    """An array of doubles in which each value that does not exceed the one before it becomes that plus eps."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.when((F.size(acc) > 0) & (x <= last), last + F.lit(eps)).otherwise(x)))

    return F.aggregate(values, F.array().cast("array<double>"), lambda a, x: F.when(F.size(a) == 0, F.array(x)).otherwise(step(a, x)))


def _stretched(sweep: DataFrame, dphi_per_px: float | Column, span: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, k, t): uniform angles less the rounded drift, moved to 0 and stretched to span."""
    n = Window.partitionBy(*by)
    base = F.col("span") * F.col("k") / F.count(F.lit(1)).over(n) - half_even(F.col("dphi")) * F.col("per_px")
    named = sweep.select(*by, "k", "dphi", num(dphi_per_px).alias("per_px"), num(span).alias("span"))
    moved = named.select(*by, "k", "span", base.alias("t")).withColumn("t", F.col("t") - F.min("t").over(n))
    return moved.withColumn("t", F.col("t") * F.col("span") / F.greatest(F.max("t").over(n), F.lit(1e-6)))


def knot_arrays(sweep: DataFrame, dphi_per_px: float | Column, span: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """(k, dphi) -> one row a scan with knots: uniform angles less the rounded drift, moved to 0, stretched to span and made increasing.

    The fold over frames needs them together: one row per frame of one scan.
    """
    moved = _stretched(sweep, dphi_per_px, span, by)
    listed = moved.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("ts"))
    return listed.select(*by, strictly_increasing(F.col("ts")).alias("knots"))


def rebuild_knots(sweep: DataFrame, dphi_per_px: float, span: float) -> DataFrame:
    """The same of one scan as rows (k, theta); the fold reads rows, as one that grows an array copies it for each frame."""
    rows = increasing(_stretched(sweep, dphi_per_px, span), "t", [], ["k"], "theta", "at")
    return rows.select(F.col("at").cast("int").alias("k"), "theta")
