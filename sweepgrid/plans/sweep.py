"""The sweep pipeline: frames or a polar stack to a volume, and its older variants."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut
from ..functions.scalars import linspace
from ..operators import geometry, recon, registration, seam
from ..operators import polar as po
from ..operators.recon import Fan


@dataclass(frozen=True)
class SweepOptions:
    """Settings of a run; the defaults are those of the newer pipeline."""

    depth_mm: float = 48.0
    voxel_mm: float = 0.20
    sigma_theta_deg: float = 0.0
    theta_span_deg: float = 360.0
    interp_order: int = 1
    #: Depth planes that a task makes at most.
    slab_size: int = 48
    registration: bool = True
    drop_duplicate: bool = True
    best_cut: bool = True
    blend_frames: int = 5
    older: bool = False
    apex_search: bool = True
    #: Off: values outside the mask stay as they are.
    use_mask: bool = True
    #: A stack with a known answer (theta, phi, radial, ones) in the place of the frames'.
    phantom: str | None = None
    #: Where the mask on the polar grid is written, for a look at it.
    mask_dump: str | None = None


@dataclass
class Sweep:
    """What a run made: voxels (ix, iy, iz, v), the frames' angles, the cut and the volume's side."""

    voxels: DataFrame
    knots: list[float]
    cut: int
    n: int
    polar: DataFrame = field(repr=False, default=None)


def reconstruct(spark: SparkSession, stack: DataFrame, fan: Fan, options: SweepOptions) -> Sweep:
    """A volume from an unwrapped stack (k, r, p, v).

    Only one row per frame (drifts, angles) ever reaches the driver. The stack is checkpointed after
    each step that is read twice.
    """
    o, span = options, math.radians(options.theta_span_deg)
    if o.older:
        return _reconstruct_older(spark, *registered_older(stack, fan, o.registration), fan, o)
    now = cut(stack.select("k", "r", "p", F.col("v").cast("double").alias("v")))
    n = now.agg(F.max("k") + 1).first()[0]
    drift = [(k, 0.0, 0.0) for k in range(n)]
    if o.registration:
        shifts = cut(registration.estimate_shifts(now, fan.rows, fan.cols, n // 2))
        now = cut(registration.apply_shifts(now, shifts, fan.rows, fan.cols))
        drift = sorted(tuple(r) for r in shifts.select("k", "dr", "dphi").collect())
    at = 0
    if o.best_cut:
        r0, r1 = seam.depth_roi(fan.dr_mm, fan.rows)
        at = seam.best_cut(now, r0, r1).first()["cut"]
        now = seam.roll_frames(now, at, n)
        drift = [((k - at) % n, a, b) for k, a, b in drift]
    sweep = spark.createDataFrame(sorted(drift), "k int, dr double, dphi double")
    if o.registration:
        fixed = cut(seam.detrend_closure(sweep))
        extra = fixed.select("k", F.col("dr_extra").alias("dr"), F.col("dphi_extra").alias("dphi"))
        now = registration.apply_shifts(now, extra, fan.rows, fan.cols)
        sweep = fixed.select("k", F.col("dphi_corr").alias("dphi"))
    knots = [r["theta"] for r in seam.rebuild_knots(sweep.select("k", "dphi"), fan.dphi, span).orderBy("k").collect()]
    if o.blend_frames > 0:
        now = seam.blend_closure(now, o.blend_frames)
    now = cut(now)
    voxels = recon.resample(spark, now, fan, n, o.voxel_mm, knots, o.interp_order, o.sigma_theta_deg, o.theta_span_deg, slab=o.slab_size)
    return Sweep(voxels, knots, at, recon.axis_count(fan.depth_mm, o.voxel_mm), now)


def registered_older(stack: DataFrame, fan: Fan, register: bool) -> tuple[DataFrame, int]:
    """The stack as the older pipeline resamples it, written once, and its frames."""
    now = cut(stack.select("k", "r", "p", F.col("v").cast("double").alias("v")))
    n = now.agg(F.max("k") + 1).first()[0]
    return (cut(registration.register_older(now, fan.cols, n // 2)) if register else now), n


def _reconstruct_older(spark: SparkSession, now: DataFrame, n: int, fan: Fan, o: SweepOptions) -> Sweep:
    cells = recon.older_positions(recon.valid_cells(spark, fan, o.voxel_mm), fan, n)
    sigma = o.sigma_theta_deg * n / 360.0
    smooth = recon.gaussian_theta(now, n, sigma) if sigma > 0 else now
    keys = ["ix", "iy", "iz"]
    voxels = recon.trilinear(cells, smooth, keys) if o.interp_order == 1 else recon.spline_sample(cells, smooth, (fan.rows, fan.cols, n), keys, o.interp_order)
    span = math.radians(o.theta_span_deg)
    return Sweep(voxels, [span * k / n for k in range(n)], 0, recon.axis_count(fan.depth_mm, o.voxel_mm), now)


def search_apex(spark: SparkSession, pixels: DataFrame, calib: dict, mask: DataFrame | None = None, reach: int = 2, depths: tuple[float, ...] = (12, 24, 36)) -> dict:
    """calib with the apex moved by up to reach pixels to where the middle frame's depth rows vary least; as it is if no place is valid.

    All places are sampled at once: each has a few depth rows, which are rows of one grid.
    """
    width = 2 * reach + 1
    rows, cols = math.ceil(calib["r_max_pix"]), int(calib["rows_eff"])
    at = [(float(d), round(d / calib["dr"])) for d in depths]
    at = [(d, r) for d, r in at if r < rows]
    if not at:
        return calib
    step = lambda r: r * rows / (rows - 1) if rows > 1 else 0.0  # noqa: E731  as `sampling_grid` spaces depth rows
    cell = spark.range(width * width * len(at) * cols).select((F.col("id") % cols).cast("int").alias("p"), F.expr(f"cast(id div {cols} as int)").alias("r"))
    place, depth = F.expr(f"r div {len(at)}"), F.col("r") % len(at)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (depth + 1).cast("int"))
    named = cell.select("r", "p", (F.floor(place / width) - reach).cast("int").alias("dx"), (F.pmod(place, F.lit(width)) - reach).cast("int").alias("dy"), pick([d for d, _ in at]).alias("r_mm"), pick([float(step(r)) for _, r in at]).alias("rho"))
    phi = linspace(F.col("p"), calib["phi0"], calib["phi1"], cols)
    named = named.withColumns({"ax": F.lit(float(calib["apex_x"])) + F.col("dx"), "ay": F.lit(float(calib["apex_y"])) + F.col("dy")})
    grid = cut(named.withColumns({"sx": F.col("ax") + F.col("rho") * F.cos(phi), "sy": F.col("ay") + F.col("rho") * F.sin(phi)}))
    middle = pixels.agg(F.expr("(max(k) + 1) div 2").alias("m"))
    frame = pixels.join(F.broadcast(middle), F.col("k") == F.col("m")).drop("m")
    on = po.nearest_mask(mask, grid) if mask is not None else po.wedge(grid, (F.col("ax"), F.col("ay")), calib["phi0"], calib["phi1"], calib["r_max_pix"], calib["image_width"], calib["image_height"])
    values = po.mask_multiply(po.bilinear(frame, grid.select("r", "p", "sx", "sy")), on)
    rated = geometry.depth_variance(values.join(grid.select("r", "p", "dx", "dy", "r_mm"), ["r", "p"]), depths)
    best = geometry.pick_offset(rated).first()
    return calib if best is None else calib | {"apex_x": calib["apex_x"] + best["dx"], "apex_y": calib["apex_y"] + best["dy"]}


def unwrapped_with_mask(spark: SparkSession, pixels: DataFrame, calib: dict, options: SweepOptions, mask: DataFrame | None = None) -> tuple[DataFrame, Fan, DataFrame]:
    """The polar stack of frame pixels (k, y, x, v), its apex refined, its fan, and the mask on the polar grid."""
    if options.apex_search and not options.older:
        calib = search_apex(spark, pixels, calib, mask)
    apex, reach = (calib["apex_x"], calib["apex_y"]), calib["r_max_pix"]
    grid = cut(po.sampling_grid(spark, apex, calib["phi0"], calib["phi1"], reach, calib["rows_eff"]))
    on = po.nearest_mask(mask, grid) if mask is not None else po.wedge(grid, apex, calib["phi0"], calib["phi1"], reach, calib["image_width"], calib["image_height"])
    if options.mask_dump:
        on.write.mode("overwrite").parquet(options.mask_dump)
    fan = Fan(calib["depth"], calib["phi0"], calib["phi1"], math.ceil(reach), calib["rows_eff"], reach)
    if options.phantom:
        n = pixels.agg(F.max("k") + 1).first()[0]
        return recon.phantom_stack(spark, options.phantom, fan.rows, fan.cols, n), fan, on
    return po.unwrap(pixels, grid, on if options.use_mask else None, options.drop_duplicate, options.older), fan, on


def unwrapped(spark: SparkSession, pixels: DataFrame, calib: dict, options: SweepOptions, mask: DataFrame | None = None) -> tuple[DataFrame, Fan]:
    """The same without the mask."""
    return unwrapped_with_mask(spark, pixels, calib, options, mask)[:2]


def from_frames(spark: SparkSession, pixels: DataFrame, calib: dict, options: SweepOptions, mask: DataFrame | None = None) -> Sweep:
    """A volume from frame pixels (k, y, x, v) and a geometry record (one row of geometry.geometry as a dict)."""
    return reconstruct(spark, *unwrapped(spark, pixels, calib, options, mask), options)


def raw_and_smooth(spark: SparkSession, stack: DataFrame, fan: Fan, raw: SweepOptions, smooth: SweepOptions | None = None) -> tuple[Sweep, Sweep]:
    """Two volumes on one grid from one registered stack; a volume is computed when it is read."""
    smooth = smooth or replace(raw, sigma_theta_deg=1.0, interp_order=3)
    now, n = registered_older(stack, fan, raw.registration)
    return _reconstruct_older(spark, now, n, fan, raw), _reconstruct_older(spark, now, n, fan, smooth)
