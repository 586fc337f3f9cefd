"""Statistics, windows and filters over sparse volumes (ix, iy, iz, v); absent voxels are 0."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentile, percentiles_by
from ..functions.scalars import affine, clip, half_even, symmetric_eigenvalues
from ..functions.session import beside, cut
from . import blocks

AXES = ("ix", "iy", "iz")


def with_zero_row(values: DataFrame, total: int, value: str = "v") -> DataFrame:
    """(v, n): the values once each and one row for all absent zeros."""
    have = values.agg(F.count(F.lit(1)).alias("have"))
    zeros = have.select(F.lit(0.0).alias("v"), (F.lit(total) - F.col("have")).alias("n")).where("n > 0")
    return values.select(F.col(value).cast("double").alias("v"), F.lit(1).cast("long").alias("n")).unionByName(zeros)


def dense_percentiles(voxels: DataFrame, total: int, at: Sequence[float]) -> DataFrame:
    """One row p_<q>: exact percentiles over all cells of the volume, zeros outside the fan included."""
    rows = cut(with_zero_row(voxels, total))  # read for each percentile
    got = {f"p_{str(q).replace('.', '_')}": exact_percentile(rows, "v", q / 100.0, "n") for q in at}
    return voxels.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in got.items()))


def x_signal_argmax(voxels: DataFrame) -> DataFrame:
    """One row (ix, total): the slice with the largest sum, the first among equals."""
    sums = voxels.groupBy("ix").agg(F.sum("v").alias("total"))
    return sums.agg(F.max(F.struct("total", (-F.col("ix")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("ix"), F.col("b.total").alias("total"))


def covariance(points: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n and the six covariances (one less in the denominator) xx, yy, zz, xy, xz, yz."""
    x, y, z = cols
    pairs = {"xx": (x, x), "yy": (y, y), "zz": (z, z), "xy": (x, y), "xz": (x, z), "yz": (y, z)}
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(a, b).alias(k) for k, (a, b) in pairs.items()])


def eigen(cov: DataFrame) -> DataFrame:
    """Adds e1 >= e2 >= e3."""
    top, mid, low = symmetric_eigenvalues(*(F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")))
    return cov.withColumns({"e1": top, "e2": mid, "e3": low})


def axis_ratio(voxels: DataFrame, total: int, share: float = 0.6, least: int = 500, by: Sequence[str] = ()) -> DataFrame:
    """ratio = sqrt(largest / smallest eigenvalue) of the places of voxels above a percentile of the whole volume; 1 below
    least voxels or without extent. by: several volumes at once, all of the same total."""
    keys = list(by)
    if keys:
        counts = voxels.groupBy(*keys).agg(F.count(F.lit(1)).alias("have"))
        zeros = counts.select(*keys, F.lit(0.0).alias("v"), (F.lit(total) - F.col("have")).alias("n")).where("n > 0")
        rows = voxels.select(*keys, F.col("v").cast("double"), F.lit(1).cast("long").alias("n")).unionByName(zeros)
        cut_at = percentiles_by(cut(rows), "v", [share], keys, "n").select(*keys, F.col("p")[0].alias("t"))
        above = voxels.join(cut_at, keys).where("v > t")
    else:
        above = voxels.where(F.col("v") > F.lit(exact_percentile(cut(with_zero_row(voxels, total)), "v", share, "n")))
    e = eigen(covariance(above.select(*keys, *(F.col(a).cast("double") for a in AXES)), AXES, keys))
    return e.select(*keys, F.when((F.col("n") < least) | (F.col("e3") <= 0), 1.0).otherwise(F.sqrt(F.col("e1") / F.col("e3"))).alias("ratio"))


def min_max_quantize(df: DataFrame, value: str, bits: int, auto_window: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Adds q: the value in 8 or 16 bits by the range of all finite values (of each slice with by), truncated."""
    top = 255.0 if bits == 8 else 65535.0
    v = F.col(value).cast("double")
    finite = ~(F.isnan(v) | (F.abs(v) == float("inf")))
    if not auto_window:
        return df.withColumn("q", (clip(F.when(finite, v).otherwise(0.0), 0.0, 1.0) * top).cast("int"))
    # Extremes merge before the shuffle and come back as a row a slice.
    rows = beside(df, df.groupBy(*by).agg(F.min(F.when(finite, v)).alias("__lo"), F.max(F.when(finite, v)).alias("__hi")), by)
    if not by:
        none = F.raise_error(F.lit("no finite value to quantize")).cast("double")
        rows = rows.withColumn("__lo", F.coalesce("__lo", none))
    hi = F.when(F.col("__hi") <= F.col("__lo"), F.col("__lo") + 1.0).otherwise(F.col("__hi"))
    scaled = clip((v - F.col("__lo")) / (hi - F.col("__lo")), 0.0, 1.0) * top
    return rows.withColumn("q", F.when(finite & F.col("__lo").isNotNull(), scaled).otherwise(0.0).cast("int")).drop("__lo", "__hi")


def robust_rescale(df: DataFrame, value: str, low: float = 1.0, high: float = 99.7, bits: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Adds q: percentiles of the positive values as the window, clipped and rounded half to even."""
    v = F.col(value).cast("double")
    positive = F.when(v > 0, v)
    got = percentiles_by(df.select(*by, positive.alias("__v")), "__v", [low / 100.0, high / 100.0], by)
    stats = got.select(*by, F.col("p")[0].alias("__lo"), F.col("p")[1].alias("__hi"))
    if not by:  # without a positive value there is no window
        stats = stats.agg(F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"))
    rows = df.join(stats, list(by), "left") if by else df.join(F.broadcast(stats))
    span = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-9))
    q = half_even(clip((v - F.col("__lo")) / span, 0.0, 1.0) * (255.0 if bits == 8 else 65535.0))
    return rows.withColumn("q", F.coalesce(q, F.lit(0.0)).cast("int")).drop("__lo", "__hi")


def slices(voxels: DataFrame, axis: int, index: Sequence[int], shape: Sequence[int]) -> DataFrame:
    """The voxels of some slices; an axis or index out of range raises."""
    if axis not in (0, 1, 2):
        raise ValueError(f"axis {axis}")
    bad = [i for i in index if not 0 <= i < shape[axis]]
    if bad:
        raise ValueError(f"slices {bad} of {shape[axis]}")
    return voxels.where(F.col(AXES[axis]).isin(*index))


def ras_bounds(voxels: DataFrame, matrix: Sequence[Sequence[float]], above: float = 0.0) -> DataFrame:
    """One row x0, x1, y0, y1, z0, z1 of voxels above a value, in space."""
    xyz = [affine(row, *(F.col(a).cast("double") for a in AXES)) for row in matrix[:3]]
    rows = voxels.where(F.col("v") > above).select(*(e.alias(n) for e, n in zip(xyz, "xyz", strict=True)))
    return rows.agg(*[f(n).alias(f"{n}{k}") for n in "xyz" for f, k in ((F.min, 0), (F.max, 1))])


def roi_box(bounds: DataFrame, margin: float = 3.0, side: float = 2.0) -> DataFrame:
    """Box centre (cx, cy, cz) and lengths (lx, ly, lz) around the bounds; along x it starts margin behind the front."""
    lx = F.col("x1") - F.col("x0") + margin + 4.0
    out = bounds.select(lx.alias("lx"), *((F.col(f"{a}1") - F.col(f"{a}0") + 2 * side).alias(f"l{a}") for a in "yz"), "x0", *(((F.col(f"{a}0") + F.col(f"{a}1")) / 2).alias(f"c{a}") for a in "yz"))
    return out.select((F.col("x0") + margin + F.col("lx") / 2).alias("cx"), "cy", "cz", "lx", "ly", "lz")


def crop(voxels: DataFrame, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """Voxels of an index box, both ends included, renumbered from 0."""
    kept = voxels.where(" AND ".join(f"{a} BETWEEN {x} AND {y}" for a, x, y in zip(AXES, lo, hi, strict=True)))
    return kept.withColumns({a: F.col(a) - x for a, x in zip(AXES, lo, strict=True)})


def dense_cells(spark, shape: Sequence[int]) -> DataFrame:
    nx, ny, nz = shape
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i / (ny * nz)).cast("int").alias("ix"), ((i / nz).cast("long") % ny).cast("int").alias("iy"), (i % nz).cast("int").alias("iz"))


def median_filter(voxels: DataFrame, shape: Sequence[int], radius: int = 1) -> DataFrame:
    """Median over a cube around each cell, the border repeated; dense result."""
    if radius == 0:
        return blocks.unpack(blocks.pack(voxels, shape), shape)
    return blocks.unpack(blocks.stencil(blocks.pack(voxels, shape), shape, radius, lambda a: blocks.medians(a, radius)), shape)


def binary_closing(cells: DataFrame, shape: Sequence[int], radius: int = 1) -> DataFrame:
    """Cells of the closing of a set by a cube; outside is off for the dilation and on for the erosion."""
    on = blocks.pack(cells.select(*AXES, F.lit(1.0).alias("v")), shape)
    if radius:
        for best in (np.max, np.min):
            on = blocks.stencil(on, shape, radius, lambda a, best=best: blocks.running(a, radius, best))
    return blocks.unpack(on, shape).where("v > 0").select(*AXES)


def apply_mask(voxels: DataFrame, cells: DataFrame) -> DataFrame:
    return voxels.join(cells, list(AXES), "left_semi")


def gradient_magnitude(voxels: DataFrame, shape: Sequence[int], spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Length of the central-difference gradient at each cell, the border repeated; dense result."""
    spacing = tuple(spacing)
    return blocks.unpack(blocks.stencil(blocks.pack(voxels, shape), shape, 1, lambda a: blocks.gradient_length(a, spacing)), shape)


def quality(voxels: DataFrame, shape: Sequence[int], spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One row: mean, std, snr of positive voxels, mean gradient length over the volume, coverage in percent."""
    total = shape[0] * shape[1] * shape[2]
    pos = voxels.where("v > 0").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count(F.lit(1)).alias("n"))
    grad = gradient_magnitude(voxels, shape, spacing).agg(F.avg("v").alias("gradient"))
    both = pos.join(grad)
    return both.select("mean", "std", (F.col("mean") / F.nullif(F.col("std"), F.lit(0.0))).alias("snr"), "gradient", (F.lit(100.0) * F.col("n") / total).alias("coverage"))


def curvature_diffusion(voxels: DataFrame, shape: Sequence[int], rounds: int = 5, conductance: float = 2.0, step: float = 0.01) -> DataFrame:
    """Edge-preserving smoothing: flow by curvature, slowed where the gradient is large against its mean (after Whitaker
    and Xue 2001, on unit spacing). Each round is one exchange of halos; lineage is cut by a checkpoint."""
    return blocks.diffused(voxels, shape, rounds, conductance, step) if rounds else voxels


def linear_resample(voxels: DataFrame, shape: Sequence[int], spacing: Sequence[float], new: Sequence[float]) -> DataFrame:
    """The volume at another spacing, size max(1, round(n * old / new)), linear, 0 outside; cells with a value only."""
    size = [max(1, int(n * o / s + 0.5)) for n, o, s in zip(shape, spacing, new, strict=True)]
    rows = dense_cells(voxels.sparkSession, size)
    at = {a: F.col(a) * F.lit(s / o) for a, s, o in zip(AXES, new, spacing, strict=True)}
    inside = F.lit(True)
    for a, n in zip(AXES, shape, strict=True):
        inside = inside & (at[a] <= n - 1)
    corners = F.array(*[F.struct(*(F.lit(d).alias(a) for a, d in zip(AXES, o, strict=True))) for o in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]])
    rows = rows.where(inside).withColumn("c", F.explode(corners))
    w = F.lit(1.0)
    for a in AXES:
        f = at[a] - F.floor(at[a])
        w = w * F.when(F.col(f"c.{a}") == 1, f).otherwise(1.0 - f)
    sent = rows.select(*(F.col(a).alias(f"c{a}") for a in AXES), *((F.floor(at[a]) + F.col(f"c.{a}")).cast("int").alias(a) for a in AXES), w.alias("w")).where("w <> 0")
    met = sent.join(voxels.select(*AXES, "v"), list(AXES))
    return met.groupBy(*(F.col(f"c{a}").alias(a) for a in AXES)).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def sampled_slice_counts(cells: DataFrame, axis: str, n: int, samples: int = 20) -> DataFrame:
    """(i, n): voxels in at most `samples` evenly spaced slices along an axis."""
    step = max(1, n // samples)
    return cells.where(F.col(axis) % step == 0).groupBy(F.col(axis).alias("i")).agg(F.count(F.lit(1)).alias("n"))


def window_counts(cells: DataFrame, candidates: DataFrame, radius: int = 5) -> DataFrame:
    """(cid, n): voxels in a cube around each candidate (cid, ix, iy, iz).

    Both sides meet in cells as wide as the cube, of which it touches eight at most; a cell holds no more voxels than fit in it.
    """
    wide = 2 * radius + 1
    place = lambda a: F.floor(a / wide).cast("long")
    sent = candidates.select("cid", *(F.col(a).alias(f"c{a}") for a in AXES))
    for a in AXES:
        sent = sent.withColumn(f"b{a}", F.explode(F.array_distinct(F.array(place(F.col(f"c{a}") - radius), place(F.col(f"c{a}") + radius)))))
    met = cells.select(*AXES, *(place(F.col(a)).alias(f"b{a}") for a in AXES)).join(sent, [f"b{a}" for a in AXES])
    met = met.where(" AND ".join(f"abs({a} - c{a}) <= {radius}" for a in AXES))
    got = met.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return candidates.select("cid").join(got, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))


