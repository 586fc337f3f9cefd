"""Many scans in one plan: parameters are a table joined by scan, and every step works by scan.

Nothing of a scan reaches the driver: frame counts, drifts, cuts and knots stay in tables. A volume is the one that its
scan gives alone (`sweep.reconstruct`), and the number of jobs does not depend on how many scans there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import beside, cut
from ..operators import recon, registration, seam, tiles
from .sweep import SweepOptions

BY = ("scan_id",)
KEYS = ("ix", "iy", "iz")


@dataclass
class Scans:
    """What a run made: voxels (scan_id, ix, iy, iz, v), and one row a scan: n, cut, score, knots and the settings."""

    voxels: DataFrame
    scans: DataFrame
    polar: DataFrame = field(repr=False, default=None)


def settings(scans: DataFrame, o: SweepOptions) -> DataFrame:
    """scans (scan_id, rows, cols, phi0, phi1 and, if there, depth, voxel_mm, r_max_pix) with all settings as columns."""
    given = lambda c, otherwise: F.coalesce(F.col(c), otherwise) if c in scans.columns else otherwise
    out = scans.select(*BY, F.col("rows").cast("int").alias("rows"), F.col("cols").cast("int").alias("cols"), F.col("phi0").cast("double").alias("phi0"), F.col("phi1").cast("double").alias("phi1"),
                       given("depth", F.lit(o.depth_mm)).cast("double").alias("depth"), given("voxel_mm", F.lit(o.voxel_mm)).cast("double").alias("voxel_mm"), given("r_max_pix", F.col("rows")).cast("double").alias("r_max_pix"))
    return out.withColumns({"dr": F.col("depth") / F.col("r_max_pix"), "per_px": (F.col("phi1") - F.col("phi0")) / F.greatest(F.col("cols") - 1, F.lit(1))})


def reconstruct(stack: DataFrame, scans: DataFrame, options: SweepOptions) -> Scans:
    """Volumes of all scans of a stack (scan_id, k, r, p, v); scans: one row of settings for each.

    A scan without settings, or without frames, gives no volume. Interpolation orders 0 and 1.
    """
    o, span = options, math.radians(options.theta_span_deg)
    if o.interp_order > 1 or o.older:
        raise ValueError("many scans in one plan take the newer rules and interpolation orders 0 and 1")
    known = settings(scans, o)
    now = stack.select(*BY, "k", "r", "p", F.col("v").cast("double").alias("v")).join(known.select(*BY), list(BY), "left_semi")
    now = cut(now)
    known = cut(known.join(now.groupBy(*BY).agg((F.max("k") + 1).cast("int").alias("n")), list(BY)))
    some = lambda df, *cols: beside(df, known.select(*BY, *cols), BY)

    sweep = now.select(*BY, "k").distinct().select(*BY, "k", F.lit(0.0).alias("dr"), F.lit(0.0).alias("dphi"))
    if o.registration:
        sweep = cut(registration.estimate_shifts(some(now, "rows", "cols", "n"), F.col("rows"), F.col("cols"), F.floor(F.col("n") / 2), by=BY))
        now = cut(registration.apply_shifts(some(now, "rows", "cols"), sweep, F.col("rows"), F.col("cols"), by=BY))
    cuts = known.select(*BY, F.lit(0).alias("cut"), F.lit(-1.0).alias("score"))
    if o.best_cut:
        cuts = cut(seam.best_cut(some(now, "dr", "rows"), *seam.depth_roi(F.col("dr"), F.col("rows")), by=BY))
        turned = known.select(*BY, "n").join(cuts.select(*BY, "cut"), list(BY))
        roll = lambda df: seam.roll_frames(beside(df, turned, BY), F.col("cut"), F.col("n")).drop("cut", "n")
        now, sweep = roll(now), roll(sweep)
    if o.registration:
        fixed = cut(seam.detrend_closure(sweep, BY))
        extra = fixed.select(*BY, "k", F.col("dr_extra").alias("dr"), F.col("dphi_extra").alias("dphi"))
        now = registration.apply_shifts(some(now, "rows", "cols"), extra, F.col("rows"), F.col("cols"), by=BY)
        sweep = fixed.select(*BY, "k", F.col("dphi_corr").alias("dphi"))
    knots = seam.knot_arrays(some(sweep.select(*BY, "k", "dphi"), "per_px"), F.col("per_px"), span, BY)
    if o.blend_frames > 0:
        now = seam.blend_closure(now, o.blend_frames, BY)
    now = cut(now)
    known = cut(known.join(knots, list(BY)).join(cuts, list(BY)))

    padded = recon.pad_theta(some(now, "n"), F.col("n"), 1)
    if o.sigma_theta_deg > 0:
        wide = F.col("n") + 2
        padded = recon.gaussian_theta(padded, wide, o.sigma_theta_deg * (wide - 1) / max(o.theta_span_deg, 1e-3), BY)
    samples = recon.scan_positions(recon.scan_cells(known, BY, ["rows", "cols", "dr", "phi0", "per_px", "knots"]))
    sample = tiles.linear if o.interp_order == 1 else recon.nearest
    return Scans(sample(samples, padded, list(KEYS), BY), known, now)
