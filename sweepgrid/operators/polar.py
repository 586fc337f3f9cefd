"""From image pixels (k, y, x, v) to the polar stack (k, r, p, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import linspace
from . import seam


def brightness(b, g, r):
    """The one grey rule, for columns and for arrays alike, before it is cut to whole numbers; channels as the image source gives them, blue first."""
    return (299 * b + 587 * g + 114 * r + 500) / 1000


def gray(b: Column, g: Column, r: Column) -> Column:
    """Brightness of three channels."""
    return F.floor(brightness(b, g, r)).cast("int")


def sampling_grid(spark: SparkSession, apex: tuple[float, float], phi0: float, phi1: float, r_max_pix: float, cols: int) -> DataFrame:
    """(r, p, sx, sy): where each polar cell lies in the image. Depth rows step by R / (R - 1) pixels."""
    rows = math.ceil(r_max_pix)
    cell = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("p"))
    rho, phi = linspace(F.col("r"), 0.0, float(rows), rows), linspace(F.col("p"), phi0, phi1, cols)
    return cell.select("r", "p", (F.lit(float(apex[0])) + rho * F.cos(phi)).alias("sx"), (F.lit(float(apex[1])) + rho * F.sin(phi)).alias("sy"))


def bilinear(pixels: DataFrame, grid: DataFrame) -> DataFrame:
    """(k, r, p, v): four weighted pixels each; one outside the image counts 0.

    The grid goes to the pixels: each sample's corners meet all frames in one join on (y, x).
    """
    corners = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (0, 1) for b in (0, 1)])
    rows = grid.withColumns({"x0": F.floor("sx"), "y0": F.floor("sy"), "c": F.explode(corners)})
    fx, fy = F.col("sx") - F.col("x0"), F.col("sy") - F.col("y0")
    w = F.when(F.col("c.dx") == 1, fx).otherwise(1.0 - fx) * F.when(F.col("c.dy") == 1, fy).otherwise(1.0 - fy)
    taps = rows.select("r", "p", (F.col("x0") + F.col("c.dx")).cast("int").alias("x"), (F.col("y0") + F.col("c.dy")).cast("int").alias("y"), w.alias("w"))
    met = taps.join(pixels, ["y", "x"]).groupBy("k", "r", "p").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    frames = pixels.select("k").distinct()
    return grid.select("r", "p").crossJoin(frames).join(met, ["k", "r", "p"], "left").select("k", "r", "p", F.coalesce("v", F.lit(0.0)).alias("v"))


def nearest_mask(mask: DataFrame, grid: DataFrame) -> DataFrame:
    """(r, p) of the cells whose nearest pixel is on (mask: x, y)."""
    at = grid.select("r", "p", F.bround("sx", 0).cast("int").alias("x"), F.bround("sy", 0).cast("int").alias("y"))
    return at.join(mask.select("x", "y").distinct(), ["x", "y"], "left_semi").select("r", "p")


def wedge(grid: DataFrame, apex: tuple[float, float], phi0: float, phi1: float, r_max_pix: float, width: int, height: int) -> DataFrame:
    """(r, p) of the cells inside the fan and the image, for scans without a mask. Pixels on the rim may fall either way."""
    dx, dy = F.col("sx") - apex[0], F.col("sy") - apex[1]
    angle = F.atan2(dy, dx)
    inside = (F.hypot(dx, dy) <= r_max_pix) & (angle >= phi0 - 1e-9) & (angle <= phi1 + 1e-9)
    return grid.where(inside & F.col("sx").between(0, width - 1) & F.col("sy").between(0, height - 1)).select("r", "p")


def mask_multiply(polar: DataFrame, on: DataFrame) -> DataFrame:
    """Values where the mask is on, 0 elsewhere."""
    marked = polar.join(on.withColumn("on", F.lit(1)), ["r", "p"], "left")
    return marked.select("k", "r", "p", F.when(F.col("on") == 1, F.col("v")).otherwise(0.0).alias("v"))


def unwrap(pixels: DataFrame, grid: DataFrame, on: DataFrame | None, drop_duplicate: bool = True, older: bool = False) -> DataFrame:
    """Polar stack of frames: sampled, masked, its worst frame repaired and its doubled end closed.

    older: no repair, and ends are always averaged.
    """
    stack = bilinear(pixels, grid)
    if on is not None:
        stack = mask_multiply(stack, on)
    if older:
        return seam.close_duplicate(stack, drop=drop_duplicate, always=True)
    return seam.close_duplicate(seam.repair_outlier(stack), drop=drop_duplicate)
