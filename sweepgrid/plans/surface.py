"""Chains over volumes and surfaces: preprocessing, posterior metrics, phantom metrics."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ijk_to_ras
from ..functions.session import cut
from ..operators import graph, mesh, volume
from ..operators import pointcloud as pc


@dataclass(frozen=True)
class PrepOptions:
    """Settings of the preprocessing chain."""

    spacing_mm: float = 0.20
    margin_mm: float = 3.0
    side_mm: float = 2.0
    diffusion_rounds: int = 5
    conductance: float = 2.0
    diffusion_step: float = 0.01
    median_radius: int = 1
    percentiles: tuple[float, float] = (1.0, 99.7)
    bits: int = 8


def preprocess(voxels: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float], origin: tuple[float, float, float], options: PrepOptions | None = None) -> tuple[DataFrame, tuple[int, int, int], DataFrame]:
    """Crop, resample, denoise, normalise, mask: (voxels with q, shape, quality row)."""
    o = options or PrepOptions()
    matrix = ijk_to_ras(spacing, origin)
    box = volume.roi_box(volume.ras_bounds(voxels, matrix), o.margin_mm, o.side_mm).first()
    lo, hi = [], []
    for i, a in enumerate("xyz"):
        ends = sorted((box[f"c{a}"] + s * box[f"l{a}"] / 2 - matrix[i][3]) / matrix[i][i] for s in (-1, 1))
        lo.append(max(0, round(ends[0])))
        hi.append(min(shape[i] - 1, round(ends[1])))
    size = tuple(h - x + 1 for x, h in zip(lo, hi, strict=True))
    cropped = cut(volume.crop(voxels, lo, hi))
    new = (o.spacing_mm,) * 3
    fine = tuple(max(1, int(n * s / o.spacing_mm + 0.5)) for n, s in zip(size, spacing, strict=True))
    resampled = cut(volume.linear_resample(cropped, size, spacing, new))
    smooth = volume.curvature_diffusion(resampled, fine, o.diffusion_rounds, o.conductance, o.diffusion_step)
    calm = cut(volume.median_filter(smooth, fine, o.median_radius).where("v <> 0"))
    scaled = cut(volume.robust_rescale(calm, "v", *o.percentiles, bits=o.bits).where("q > 0"))
    body = graph.largest_component(scaled, list(volume.AXES), list(fine), False)
    closed = volume.binary_closing(body, fine)
    out = cut(volume.apply_mask(scaled, closed))
    return out, fine, volume.quality(out.select(*volume.AXES, F.col("q").cast("double").alias("v")), fine, new)


@dataclass(frozen=True)
class PosteriorOptions:
    """Settings of the posterior metrics; older() gives those of the earlier version."""

    interior: bool = True
    mode: str = "area"
    area_mm2: float = 250.0
    angle_deg: float = 45.0
    plane_mm: float = 3.0
    geodesic_mm: float = 10.0
    trim: float = 0.10
    trim_rounds: int = 3
    prior_cone_deg: float = 35.0
    refine_cone_deg: float = 20.0
    radius_limit_mm: float = 10.0
    smooth_rounds: int = 15
    pass_band: float = 0.1
    least_vertices: int = 100

    @classmethod
    def older(cls) -> PosteriorOptions:
        return cls(area_mm2=220.0, angle_deg=46.0, trim=0.18, smooth_rounds=0, radius_limit_mm=float("inf"))


def posterior_metrics(vertices: DataFrame, faces: DataFrame, options: PosteriorOptions | None = None, apex: tuple[float, float, float] | None = None) -> dict[str, Any]:
    """Best-fit sphere, apex, patch and curvature of a closed surface, as one record.

    The driver holds single figures only: spheres, the apex and the patch radius.
    """
    o = options or PosteriorOptions()
    if o.smooth_rounds:
        vertices = mesh.windowed_sinc(faces, vertices, o.smooth_rounds, o.pass_band)
    v = cut(vertices.select("vid", "x", "y", "z"))
    sphere = pc.robust_sphere(v, o.trim, o.trim_rounds)
    center = sphere[:3]
    rated = cut(pc.residuals(v, sphere))
    side = pc.sign_mask(rated, o.interior)
    if apex is not None:
        mode = "manual"
        d = pc.unit_direction(center, apex)
    else:
        far = mesh.farthest_from_boundary(faces, v, side, pc.pseudo_boundary(v, center)).first()
        if far is not None and far["vid"] is not None:
            mode = "boundary_distance"
            top = v.where(F.col("vid") == far["vid"]).first()
            d = pc.unit_direction(center, (top["x"], top["y"], top["z"]))
        else:
            mode = "prior"
            d = pc.posterior_direction(rated, center, o.prior_cone_deg, o.interior)
    best = pc.extreme(pc.in_cone_or_all(rated, center, d, o.refine_cone_deg), "resid", o.interior).first()["vid"]
    at = v.where(F.col("vid") == best).first()
    apex = (at["x"], at["y"], at["z"])
    d = pc.unit_direction(center, apex)
    if o.mode in ("area", "geodesic"):
        dist = cut(mesh.geodesic(faces, v, v.where(F.col("vid") == best)))
        reach = mesh.radius_for_area(mesh.area_by_radius(faces, v, dist), o.area_mm2) if o.mode == "area" else o.geodesic_mm
        patch = rated.join(dist.where(F.col("d") <= reach), "vid", "left_semi").join(side, "vid", "left_semi")
    else:
        patch = pc.angle_cap(rated, center, d, o.angle_deg) if o.mode == "angle" else pc.plane_cap(rated, apex, d, o.plane_mm)
    patch = cut(pc.within_radius(patch, apex, o.radius_limit_mm))
    if patch.count() < o.least_vertices:
        raise ValueError(f"the patch has fewer than {o.least_vertices} vertices")
    refit = pc.robust_sphere(patch, min(o.trim, 0.12), o.trim_rounds)
    rest = pc.residual_summary(pc.residuals(patch, refit), o.interior).first()
    h = mesh.mean_curvature(faces, v)
    curved = pc.trimmed_curvature(v.join(h, "vid").join(patch.select("vid", F.lit(True).alias("inside")), "vid", "left"), F.coalesce("inside", F.lit(False))).first()
    return {
        "patch": o.mode, "apex_mode": mode, "patch_area_mm2": mesh.patch_area(faces, v, patch).first()["area"], "R_mm": refit[3],
        "apex_depth_mm": rest["apex_depth_mm"], "rms_resid_mm": rest["rms_resid_mm"], "quad_metrics": pc.quadric(v, apex, refit[:3]),
        "disc_R_equiv_patch_mm": curved["r_equiv"], "disc_H_trimmed_mean_abs_invmm": curved["mean_abs_h"], "apex_point_ras": apex,
    }


def phantom_metrics(points: DataFrame, apex: tuple[float, float, float], truth_distance: float = 30.0, truth_radius: float = 7.2, tolerance: float = 0.05, least: int = 200) -> DataFrame:
    """One row per segment (seg, x, y, z): distance of its centre from the apex, radii, band, principal spread, errors.

    A segment with fewer points than least raises when the row is read.
    """
    stats = pc.radius_stats(points, tolerance)
    centre = pc.centroids(points).drop("n")
    spread = pc.pca(points).select("seg", "e1", "e2", "e3")
    out = stats.join(centre, "seg").join(spread, "seg")
    enough = F.when(F.col("n") >= least, True).otherwise(F.raise_error(F.concat(F.lit("too few points in "), F.col("seg"))).cast("boolean"))
    out = out.where(enough).withColumn("distance_mm", pc.distance([F.lit(float(a)) for a in apex], ("cx", "cy", "cz")))
    return out.withColumns({
        "distance_err_pct": pc.percent_error(F.col("distance_mm"), F.lit(truth_distance)), "radius_err_pct": pc.percent_error(F.col("mean_r"), F.lit(truth_radius)),
        "pca_ratio": F.sqrt(F.try_divide(F.col("e1"), F.col("e3"))),
    })


def detect_apex(labels: DataFrame, candidates: DataFrame, shape: tuple[int, int, int], radius: int = 5, samples: int = 20) -> tuple[int, int, int] | None:
    """Candidate with the fewest voxels around it, but some; else the middle of the fullest sampled slice of the first axis
    that holds any."""
    some = volume.window_counts(labels, candidates, radius).where("n > 0").agg(F.min(F.struct("n", "cid")).alias("b")).first()["b"]
    if some is not None:
        c = candidates.where(F.col("cid") == some["cid"]).first()
        return c["ix"], c["iy"], c["iz"]
    for axis, n in zip(volume.AXES, shape, strict=True):
        best = volume.sampled_slice_counts(labels, axis, n, samples).agg(F.max(F.struct(F.col("n"), (-F.col("i")).alias("m"))).alias("b")).first()["b"]
        if best is not None:
            return tuple(-best["m"] if a == axis else m // 2 for a, m in zip(volume.AXES, shape, strict=True))
    return None
