"""Surfaces as clouds of points (seg, vid, x, y, z): radii, spheres, caps and apexes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curves import along_curve
from ..functions.quantiles import exact_percentile, ranked
from ..functions.scalars import clip, norm, num
from ..functions.session import SETTINGS_ROWS, beside, cut
from .volume import covariance, eigen

XYZ = ("x", "y", "z")


def centroids(points: DataFrame, by: Sequence[str] = ("seg",)) -> DataFrame:
    """by, cx, cy, cz, n."""
    return points.groupBy(*by).agg(*[F.avg(a).alias(f"c{a}") for a in XYZ], F.count(F.lit(1)).alias("n"))


def distance(center: Sequence[Column | float], cols: Sequence[str] = XYZ) -> Column:
    return norm([F.col(a) - num(c) for a, c in zip(cols, center, strict=True)])


def subsample(points: DataFrame, every: int) -> DataFrame:
    """Every n-th vertex by number: what the surface metrics offer as a speed setting."""
    return points.where(F.col("vid") % every == 0)


def radius_stats(points: DataFrame, tolerance: float = 0.05, by: Sequence[str] = ("seg",)) -> DataFrame:
    """by, n, mean_r, std_r (0 for one point), min_r, max_r, band_pct: share of points within tolerance of the mean radius.

    Centres and means are written, counted and broadcast while the segments are few, so points stay where they are read.
    """
    centred = beside(points, cut(centroids(points, by).drop("n")), by)
    radii = centred.select(*by, distance([F.col("cx"), F.col("cy"), F.col("cz")]).alias("d"))
    stats = radii.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_r"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("std_r"), F.min("d").alias("min_r"), F.max("d").alias("max_r")
    )
    stats = cut(stats)
    within = beside(radii, stats.select(*by, "mean_r"), by)
    inside = F.col("d").between(F.col("mean_r") * (1 - tolerance), F.col("mean_r") * (1 + tolerance))
    band = within.groupBy(*by).agg((F.avg(inside.cast("int")) * 100.0).alias("band_pct"))
    return stats.join(band, list(by))


def pca(points: DataFrame, by: Sequence[str] = ("seg",)) -> DataFrame:
    """by, n, the covariances and their eigenvalues e1 >= e2 >= e3."""
    return eigen(covariance(points, XYZ, by))


def principal_axis(points: DataFrame) -> tuple[float, float, float]:
    """Unit vector of the largest spread, its largest component positive (six sums reach the driver)."""
    c = covariance(points, XYZ).first()
    m = np.array([[c["xx"], c["xy"], c["xz"]], [c["xy"], c["yy"], c["yz"]], [c["xz"], c["yz"], c["zz"]]])
    v = np.linalg.eigh(m)[1][:, -1]
    v = v if v[np.abs(v).argmax()] > 0 else -v
    return tuple(map(float, v))


def percent_error(value: Column, truth: Column) -> Column:
    """Null where the truth is null; raises nothing where it is 0 (null too)."""
    return F.try_divide(value - truth, truth) * 100.0


def missing_names(wanted: DataFrame, have: DataFrame, name: str) -> DataFrame:
    return wanted.select(name).distinct().join(have.select(name).distinct(), name, "left_anti")


def require_names(wanted: DataFrame, have: DataFrame, name: str) -> DataFrame:
    """wanted joined to have; a row without a match raises when it is read."""
    met = wanted.join(have.withColumn("__has", F.lit(True)), name, "left")
    return met.where(F.when(F.col("__has").isNull(), F.raise_error(F.concat(F.lit("missing: "), F.col(name))).cast("boolean")).otherwise(True)).drop("__has")


def sphere_sums(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sums of the normal equations of [2x 2y 2z 1] [c d] = x2 + y2 + z2."""
    x, y, z = (F.col(a) for a in XYZ)
    q = x * x + y * y + z * z
    terms = {"n": F.lit(1.0), "sx": x, "sy": y, "sz": z, "sxx": x * x, "syy": y * y, "szz": z * z, "sxy": x * y, "sxz": x * z, "syz": y * z, "sq": q, "sxq": x * q, "syq": y * q, "szq": z * q}
    return points.groupBy(*by).agg(*[F.sum(e).alias(k) for k, e in terms.items()])


def solve_sphere(s: dict) -> tuple[float, float, float, float]:
    """Centre and radius from those sums."""
    a = np.array([[4 * s["sxx"], 4 * s["sxy"], 4 * s["sxz"], 2 * s["sx"]], [4 * s["sxy"], 4 * s["syy"], 4 * s["syz"], 2 * s["sy"]], [4 * s["sxz"], 4 * s["syz"], 4 * s["szz"], 2 * s["sz"]], [2 * s["sx"], 2 * s["sy"], 2 * s["sz"], s["n"]]])
    x = np.linalg.lstsq(a, np.array([2 * s["sxq"], 2 * s["syq"], 2 * s["szq"], s["sq"]]), rcond=None)[0]
    return float(x[0]), float(x[1]), float(x[2]), float(np.sqrt(x[3] + x[:3] @ x[:3]))


def robust_sphere(points: DataFrame, trim: float = 0.10, rounds: int = 3, least: int = 100) -> tuple[float, float, float, float]:
    """Sphere through points, refitted without the share of them that lies farthest from it, round by round.

    Fourteen sums reach the driver in each round. The threshold of a round is found as an exact
    percentile rank, ties by vertex number, so that the count kept is exact too.
    """
    now = points.select("vid", *XYZ)
    for _ in range(rounds):
        s = sphere_sums(now).first().asDict()
        *c, r = solve_sphere(s)
        n = int(s["n"])
        keep = min(n, max(int((1 - trim) * n), least))
        scored = now.withColumn("e", F.abs(distance(c) - F.lit(r)))
        # All values at or below the keep-th smallest; equal ones beyond the count go by number.
        limit = exact_percentile(scored, "e", (keep - 1) / max(n - 1, 1))
        near = 1e-12 * max(1.0, limit)  # the percentile of a rank may be off by rounding
        below = scored.where(F.col("e") < limit - near)
        tied = scored.where(F.abs(F.col("e") - limit) <= near)
        wanted = keep - below.count()
        if tied.count() > wanted:
            tied = ranked(tied, ["vid"], "i").where(F.col("i") <= wanted).drop("i")
        now = cut(below.unionByName(tied).drop("e"))
    return solve_sphere(sphere_sums(now).first().asDict())


def residuals(points: DataFrame, sphere: Sequence[float]) -> DataFrame:
    """Adds resid: distance from the centre less the radius."""
    return points.withColumn("resid", distance(sphere[:3]) - F.lit(float(sphere[3])))


def unit_direction(center: Sequence[float], to: Sequence[float]) -> tuple[float, float, float]:
    d = np.asarray(to, float) - np.asarray(center, float)
    return tuple(map(float, d / np.linalg.norm(d)))


def cos_angle(center: Sequence[float], direction: Sequence[float]) -> Column:
    """Cosine of the angle at the centre between a point and a direction; 0 at the centre itself."""
    along = sum(((F.col(a) - F.lit(float(c))) * F.lit(float(d)) for a, c, d in zip(XYZ, center, direction, strict=True)), F.lit(0.0))
    far = distance(center)
    return clip(F.when(far > 0, along / F.when(far > 0, far).otherwise(1.0)).otherwise(0.0), -1.0, 1.0)


def angle_cap(points: DataFrame, center: Sequence[float], direction: Sequence[float], degrees: float) -> DataFrame:
    return points.where(F.degrees(F.acos(cos_angle(center, direction))) <= degrees)


def plane_cap(points: DataFrame, apex: Sequence[float], direction: Sequence[float], depth: float) -> DataFrame:
    """Points beyond the plane that lies depth behind the apex."""
    origin = [a - depth * d for a, d in zip(apex, direction, strict=True)]
    return points.where(sum(((F.col(a) - F.lit(float(o))) * F.lit(float(d)) for a, o, d in zip(XYZ, origin, direction, strict=True)), F.lit(0.0)) >= 0)


def within_radius(points: DataFrame, apex: Sequence[float], most: float) -> DataFrame:
    return points.where(distance(apex) <= most)


def cap_angle(depth: Column | float, radius: Column | float) -> Column:
    """Angle (degrees) of the cap of a depth; its inverse is cap_depth."""
    return F.degrees(F.acos(clip(1.0 - num(depth) / num(radius), -1.0, 1.0)))


def cap_depth(degrees: Column | float, radius: Column | float) -> Column:
    return num(radius) * (1.0 - F.cos(F.radians(num(degrees))))


def in_cone_or_all(points: DataFrame, center: Sequence[float], direction: Sequence[float], degrees: float) -> DataFrame:
    """Points in a cone around a direction; all of them if none is."""
    inside = cos_angle(center, direction) >= float(np.cos(np.radians(degrees)))
    rows = points.withColumn("__in", inside)
    some = rows.agg(F.max(F.col("__in").cast("int")).alias("__any"))
    return rows.join(F.broadcast(some)).where((F.col("__any") == 0) | F.col("__in")).drop("__in", "__any")


def extreme(points: DataFrame, value: str, lowest: bool, by: Sequence[str] = ()) -> DataFrame:
    """The point with the extreme value, the first by number among equals: by, vid, value."""
    if lowest:
        got = points.groupBy(*by).agg(F.min(F.struct(value, "vid")).alias("b"))
        return got.select(*by, "b.vid", F.col(f"b.{value}").alias(value))
    got = points.groupBy(*by).agg(F.max(F.struct(F.col(value), (-F.col("vid")).alias("m"))).alias("b"))
    return got.select(*by, (-F.col("b.m")).alias("vid"), F.col(f"b.{value}").alias(value))


#: Children of a node of the tree of boxes that nearest points are sought in.
FAN = 64


def nearest_vertex(points: DataFrame, fiducials: DataFrame, fan: int = FAN) -> DataFrame:
    """(name, vid, d): the vertex nearest to each fiducial (name, unique; fx, fy, fz), the first by number among equals.

    Points without a place or number are left out, as are fiducials without one; without points there are no rows.
    A tree of tight boxes is packed along a space-filling curve, fan points to a leaf and fan nodes to a node, so it is balanced
    however points crowd; one place is one point. All fiducials go down together, a join a level, and leave a box behind
    when another one surely holds a nearer point. So there may be as many fiducials as points.
    """
    there = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in XYZ)
    spots = points.where(f"vid IS NOT NULL AND {there}").groupBy(*(F.col(c).cast("double").alias(c) for c in XYZ)).agg(F.min("vid").alias("vid"))
    placed = cut(along_curve(cut(spots), XYZ, fan, "node"))
    level = placed.groupBy("node").agg(*(f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))))
    levels, sizes = [cut(level)], [-(-placed.count() // fan)]
    while sizes[-1] > 1:
        up = levels[-1].withColumn("node", F.floor(F.col("node") / fan).cast("long"))
        levels.append(cut(up.groupBy("node").agg(*(f(f"{n}{c}").alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))))))
        sizes.append(-(-sizes[-1] // fan))
    where = " AND ".join(f"f{c} IS NOT NULL AND NOT isnan(f{c})" for c in XYZ)
    at = fiducials.where(f"name IS NOT NULL AND {where}").select("name", *(F.col(f"f{c}").cast("double").alias(f"f{c}") for c in XYZ), F.lit(0).cast("long").alias("node"))
    for boxes, n in list(zip(levels, sizes, strict=True))[-2::-1]:
        kids = boxes.withColumn("up", F.floor(F.col("node") / fan).cast("long"))
        # High up all fiducials meet the same few boxes.
        met = at.withColumnRenamed("node", "up").join(F.broadcast(kids) if n <= SETTINGS_ROWS else kids, "up")
        near = [F.greatest(F.col(f"lo{c}") - F.col(f"f{c}"), F.col(f"f{c}") - F.col(f"hi{c}"), F.lit(0.0)) for c in XYZ]
        far = [F.greatest(F.abs(F.col(f"lo{c}") - F.col(f"f{c}")), F.abs(F.col(f"f{c}") - F.col(f"hi{c}"))) for c in XYZ]
        met = met.withColumns({"__near": norm(near), "__far": norm(far)})
        sure = met.groupBy("name").agg(F.min("__far").alias("__sure"))
        at = cut(met.join(sure, "name").where(F.col("__near") <= F.col("__sure") * (1 + 1e-9)).select("name", *(f"f{c}" for c in XYZ), "node"))
    d = norm([F.col(a) - F.col(f"f{a}") for a in XYZ])
    return extreme(at.join(placed, "node").select("name", "vid", d.alias("d")), "d", True, ["name"])


def pseudo_boundary(points: DataFrame, center: Sequence[float], percentile: float = 0.95) -> DataFrame:
    """Points whose radius is at the percentile or above."""
    rows = points.withColumn("radius", distance(center))
    limit = exact_percentile(rows, "radius", percentile)
    return rows.where(F.col("radius") >= F.lit(limit))


def sign_mask(points: DataFrame, interior: bool) -> DataFrame:
    return points.where(F.col("resid") <= 1e-6) if interior else points.where(F.col("resid") >= -1e-6)


def fill_nonfinite(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Values that are not finite become the largest finite one plus 1, or 0 without any."""
    v = F.col(col).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    top = df.groupBy(*by).agg(F.coalesce(F.max(F.when(finite, v)) + 1.0, F.lit(0.0)).alias("__top"))
    rows = beside(df, top, by)
    return rows.withColumn(col, F.when(finite, v).otherwise(F.col("__top"))).drop("__top")


def posterior_direction(points: DataFrame, center: Sequence[float], cone_degrees: float = 35.0, interior: bool = True) -> tuple[float, float, float]:
    """The end of the principal axis whose cone has the more extreme median residual (needs resid)."""
    axis = principal_axis(points)
    worst = float("inf") if interior else float("-inf")
    found = [exact_percentile(points.where(cos_angle(center, [s * a for a in axis]) >= float(np.cos(np.radians(cone_degrees)))), "resid", 0.5) for s in (1, -1)]
    plus, minus = (worst if m is None else m for m in found)
    first = plus <= minus if interior else plus >= minus
    return tuple(a if first else -a for a in axis)


def residual_summary(points: DataFrame, interior: bool = True) -> DataFrame:
    """One row: rms and apex depth of resid."""
    depth = -F.min("resid") if interior else F.max("resid")
    return points.agg(F.sqrt(F.avg(F.col("resid") ** 2)).alias("rms_resid_mm"), depth.alias("apex_depth_mm"))


def trimmed_curvature(points: DataFrame, patch: Column, h: str = "h", surface_q: float = 0.98, patch_q: float = 0.90) -> DataFrame:
    """One row: median, median abs, mean abs of curvature over a patch and 1 / median, without the largest values of the
    surface and then of the patch; zeros and infinity where nothing is left."""
    rows = points.withColumns({"__a": F.abs(F.col(h)), "__p": patch})
    kept = rows.where(F.col("__p") & (F.col("__a") <= F.lit(exact_percentile(rows, "__a", surface_q))))
    last = kept.where(F.col("__a") <= F.lit(exact_percentile(kept, "__a", patch_q)))
    middle = [F.lit(exact_percentile(last, c, 0.5)).cast("double").alias(n) for c, n in ((h, "m"), ("__a", "ma"))]
    got = last.agg(F.avg("__a").alias("aa"), F.count(F.lit(1)).alias("n")).select("*", *middle)
    return got.select(
        F.coalesce("m", F.lit(0.0)).alias("median_h"), F.coalesce("ma", F.lit(0.0)).alias("median_abs_h"), F.coalesce("aa", F.lit(0.0)).alias("mean_abs_h"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("m")), F.lit(float("inf"))).alias("r_equiv"), "n",
    )


def local_frame(apex: Sequence[float], center: Sequence[float]) -> np.ndarray:
    """Rows t1, t2, n: n from the centre to the apex, t1 along x (y where n is nearly x)."""
    n = np.asarray(apex, float) - np.asarray(center, float)
    n /= np.linalg.norm(n)
    t1 = np.array([1.0, 0, 0]) if abs(n[0]) <= 0.9 else np.array([0, 1.0, 0])
    t1 -= (t1 @ n) * n
    t1 /= np.linalg.norm(t1)
    return np.array([t1, np.cross(n, t1), n])


def quadric(points: DataFrame, apex: Sequence[float], center: Sequence[float], radius: float = 4.0, trim: float = 0.35, least: int = 30) -> dict[str, float]:
    """Curvatures at the apex from z = ax2 + by2 + cxy + dx + ey + f around it, refitted once without the worst points.

    Only the neighbourhood is worked on; 28 sums reach the driver for each fit.
    """
    t1, t2, n = local_frame(apex, center)
    rel = [F.col(a) - F.lit(float(p)) for a, p in zip(XYZ, apex, strict=True)]
    along = lambda v: sum((r * F.lit(float(x)) for r, x in zip(rel, v, strict=True)), F.lit(0.0))
    local = points.select("vid", along(t1).alias("x"), along(t2).alias("y"), along(n).alias("z")).withColumn("r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))
    near = local.where(F.col("r") <= radius)
    if near.count() < least:
        near = local.orderBy("r", "vid").limit(least)
    near = cut(near)

    def fit(rows: DataFrame) -> tuple[np.ndarray, int]:
        x, y, z = F.col("x"), F.col("y"), F.col("z")
        terms = [x * x, y * y, x * y, x, y, F.lit(1.0), z]
        sums = rows.agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}{j}") for i in range(7) for j in range(i, 7) if i < 6], F.count(F.lit(1)).alias("n")).first()
        m = np.array([[sums[f"s{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
        return np.linalg.lstsq(m, np.array([sums[f"s{i}6"] for i in range(6)]), rcond=None)[0], sums["n"]

    k, count = fit(near)
    if count > 20:
        x, y = F.col("x"), F.col("y")
        model = F.lit(k[0]) * x * x + F.lit(k[1]) * y * y + F.lit(k[2]) * x * y + F.lit(k[3]) * x + F.lit(k[4]) * y + F.lit(k[5])
        keep = max(int((1 - trim) * count), 20)
        k, count = fit(near.withColumn("e", F.abs(F.col("z") - model)).orderBy("e", "vid").limit(keep))
    e = np.linalg.eigvalsh(np.array([[2 * k[0], k[2]], [k[2], 2 * k[1]]]))
    k1, k2 = float(e[1]), float(e[0])
    r = lambda c: 1 / c if abs(c) > 1e-9 else float("inf")
    span = abs(k1) + abs(k2)
    return {"k1": k1, "k2": k2, "H": (k1 + k2) / 2, "K": k1 * k2, "R1": r(k1), "R2": r(k2), "anisotropy": abs(k1 - k2) / span if span else 0.0, "n": int(count)}
