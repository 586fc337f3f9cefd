"""Scan geometry: from a calibration record or a mask to fan bounds and scales."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentile
from ..functions.scalars import ang_norm, line_intersection, num
from ..functions.session import cut, few
from .graph import grid_components, largest_component

#: Device figures that hold where a scan says nothing else.
FAN_DEGREES, DEPTH_MM = 52.0, 48.0


def geometry(calib: DataFrame, older: bool = False, sos_scale: float = 1.0) -> DataFrame:
    """Adds rows_eff, depth, phi0, phi1, fan, dphi, dr to records (image_height, r_max_pix, depth_mm, n_rows_mask, phi0_mask, phi1_mask).

    Mask bounds are put in order and, if they start below 0, moved to start there (older: kept).
    Without them the fan is [0, 52 degrees] (older: centred on 0). A depth of 0 counts as not given.
    """
    given = F.col("phi0_mask").isNotNull() & F.col("phi1_mask").isNotNull()
    lo, hi = F.least("phi0_mask", "phi1_mask"), F.greatest("phi0_mask", "phi1_mask")
    move = F.lit(0.0) if older else F.when(lo < 0, -lo).otherwise(0.0)
    fan = math.radians(FAN_DEGREES)
    start, end = (-fan / 2, fan / 2) if older else (0.0, fan)
    out = calib.withColumns({
        "rows_eff": F.coalesce(F.nullif(F.col("n_rows_mask"), F.lit(0)), F.col("image_height")),
        "depth": F.coalesce(F.nullif(F.col("depth_mm").cast("double"), F.lit(0.0)), F.lit(DEPTH_MM)) * F.lit(sos_scale),
        "phi0": F.when(given, lo + move).otherwise(F.lit(start)), "phi1": F.when(given, hi + move).otherwise(F.lit(end)),
    })
    out = out.withColumn("fan", F.col("phi1") - F.col("phi0"))
    return out.withColumns({"dphi": F.when(F.col("rows_eff") > 1, F.col("fan") / (F.col("rows_eff") - 1)).otherwise(F.col("fan")), "dr": F.col("depth") / F.col("r_max_pix")})


def default_calibration(frames: DataFrame) -> DataFrame:
    """The record of scans without a mask: apex at the left edge's middle, the whole width as depth."""
    first = frames.groupBy("scan_id").agg(F.min_by(F.struct("height", "width"), "frame_idx").alias("s"))
    h, w = F.col("s.height"), F.col("s.width")
    return first.select(
        "scan_id", F.lit(0.0).alias("apex_x"), (h / 2).alias("apex_y"), F.greatest(w - 1, F.lit(1)).cast("double").alias("r_max_pix"), h.alias("image_height"), w.alias("image_width"),
        h.alias("n_rows_mask"), F.lit(None).cast("double").alias("phi0_mask"), F.lit(None).cast("double").alias("phi1_mask"), F.lit(None).cast("double").alias("depth_mm"),
    )


def lateral_resolution(geom: DataFrame, depths: DataFrame) -> DataFrame:
    """(…, r_mm, chord_mm, lateral_mm): arc over the fan and of one angle step at each depth."""
    return geom.join(few(depths)).withColumns({"arc_mm": F.col("r_mm") * F.col("fan"), "lateral_mm": F.col("r_mm") * F.col("dphi")})


def row_arc_error(mask: DataFrame, apex: tuple[float, float], phi_mid: float, dphi: float, dr_mm: float, height: int, depths: tuple[float, ...] = (10, 20, 30, 40)) -> DataFrame:
    """(r_mm, err): arc length of the mask's row at each depth, expected against measured. Both are the same product,
    so the error is 0 but for rounding; kept as a check of the row that is met."""
    spark = mask.sparkSession
    rows = spark.createDataFrame([(float(r), min(max(int(round(apex[1] + r / dr_mm * math.sin(phi_mid))), 0), height - 1)) for r in depths], "r_mm double, y int")
    span = mask.join(F.broadcast(rows), "y").groupBy("r_mm").agg((F.max("x") - F.min("x") + 1).alias("n"), F.count(F.lit(1)).alias("c")).where("c >= 2")
    want, have = F.col("r_mm") * (F.col("n") * num(dphi)), F.col("n") * (F.col("r_mm") * num(dphi))
    return span.select("r_mm", F.coalesce(F.try_divide(have - want, want), F.lit(0.0)).alias("err"))


def mask_rows(mask: DataFrame) -> DataFrame:
    """One row: image rows with mask, the left edge, and the apex guess from the five columns there (mask: x, y)."""
    edge = Window.partitionBy()
    cols = mask.groupBy("x").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).withColumn("xmin", F.min("x").over(edge))
    seed = cols.where("x < xmin + 5").agg(F.min("xmin").cast("double").alias("seed_x"), F.avg(0.5 * (F.col("lo") + F.col("hi"))).alias("seed_y"))
    return mask.agg(F.countDistinct("y").alias("n_rows_mask")).join(seed)


def outer_contours(mask: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y, label, area): the outer border of each connected set of cells (x, y), diagonals joined, and the area that it encloses.

    A border cell has one of its four neighbours outside. Holes and what lies in them belong to the set around
    them. The area is that of the polygon through the border's cell centres: of four centres in a square it holds the
    whole square, of three a half. The label is the first cell in scan order.
    """
    # A frame of empty cells around the image makes all that is outside one set.
    wide, high = width + 2, height + 2
    on = mask.where(f"x >= 0 AND x < {width} AND y >= 0 AND y < {height}").select((F.col("x") + 1).cast("long").alias("x"), (F.col("y") + 1).cast("long").alias("y")).distinct()
    all_cells = mask.sparkSession.range(wide * high).select((F.col("id") % wide).alias("x"), F.expr(f"id div {wide}").alias("y"))
    empty = all_cells.join(on, ["x", "y"], "left_anti")
    outside = cut(grid_components(empty, ["y", "x"], [high, wide], False).where("label = 0").select("x", "y"))
    filled = cut(grid_components(all_cells.join(outside, ["x", "y"], "left_anti"), ["y", "x"], [high, wide], True))
    corners = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (-1, 0), (0, -1), (-1, -1))])
    squares = filled.select("label", "x", "y", F.explode(corners).alias("d")).groupBy("label", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    areas = squares.groupBy("label").agg(F.sum(F.when(F.col("n") == 4, 1.0).when(F.col("n") == 3, 0.5).otherwise(0.0)).alias("area"))
    sides = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = outside.select("x", "y", F.explode(sides).alias("d")).select((F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).distinct()
    rim = filled.join(near, ["x", "y"], "left_semi").join(areas, "label")
    first = F.expr(f"(label div {wide} - 1) * {width} + label % {wide} - 1")
    return rim.select((F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), first.alias("label"), "area")


def main_contour(mask: DataFrame, width: int, height: int) -> DataFrame:
    """(x, y): the outer contour with the largest area, the first in scan order among equals."""
    each = cut(outer_contours(mask, width, height))
    best = each.agg(F.max_by("label", F.struct("area", -F.col("label"))).alias("label"))
    return each.join(F.broadcast(best), "label").select("x", "y")


def line_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """by, px, py, vx, vy, n: the line of total least squares, direction with vx >= 0."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = points.groupBy(*by).agg(F.avg(x).alias("px"), F.avg(y).alias("py"), F.covar_pop(x, x).alias("sxx"), F.covar_pop(y, y).alias("syy"), F.covar_pop(x, y).alias("sxy"), F.count(F.lit(1)).alias("n"))
    t = 0.5 * F.atan2(2.0 * F.col("sxy"), F.col("sxx") - F.col("syy"))
    return sums.select(*by, "px", "py", F.cos(t).alias("vx"), F.sin(t).alias("vy"), "n")


def calibrate(mask: DataFrame, width: int, height: int) -> DataFrame:
    """One calibration record from the on-pixels (x, y) of a cone mask: largest component, edge lines, apex, fan, depth."""
    body = cut(largest_component(mask.select("y", "x"), ["y", "x"], [height, width], True))
    seed = mask_rows(body)
    rim = main_contour(body, width, height).join(F.broadcast(seed)).withColumn("phi", F.atan2(F.col("y") - F.col("seed_y"), F.col("x") - F.col("seed_x")))
    rim = cut(rim)
    lo, hi = (exact_percentile(rim, "phi", q) for q in (0.02, 0.98))

    def edges(tol: float) -> DataFrame:
        sides = F.array(F.when(F.abs(F.col("phi") - lo) < tol, "a"), F.when(F.abs(F.col("phi") - hi) < tol, "b"))
        return rim.select("x", "y", F.explode(F.array_compact(sides)).alias("side"))

    tol = math.radians(2.5)
    counts = {r["side"]: r["count"] for r in edges(tol).groupBy("side").count().collect()}
    if min(counts.get("a", 0), counts.get("b", 0)) < 30:
        tol = math.radians(4.0)
    lines = line_fit(edges(tol), ["side"])
    pair = lines.agg(*[F.max(F.when(F.col("side") == s, F.struct("px", "py", "vx", "vy"))).alias(s) for s in "ab"])
    l1, l2 = ([F.col(f"{s}.{c}") for c in ("px", "py", "vx", "vy")] for s in "ab")
    ang1, ang2 = (ang_norm(F.atan2(line[3], line[2])) for line in (l1, l2))
    p0, p1 = F.least(ang1, ang2), F.greatest(ang1, ang2)
    apex = pair.select(line_intersection(l1, l2).alias("apex"), F.when(p1 - p0 > math.pi, p1).otherwise(p0).alias("phi0_mask"), F.when(p1 - p0 > math.pi, p0 + 2 * math.pi).otherwise(p1).alias("phi1_mask"))
    apex = apex.withColumn("apex", F.coalesce("apex", F.raise_error(F.lit("edge lines are nearly parallel")).cast("struct<x:double,y:double>")))
    apex = cut(apex)
    far = body.join(F.broadcast(apex)).select(F.hypot(F.col("x") - F.col("apex.x"), F.col("y") - F.col("apex.y")).alias("far"))
    return apex.withColumn("r_max_pix", F.lit(exact_percentile(far, "far", 0.995))).join(seed.select("n_rows_mask")).select(
        F.col("apex.x").alias("apex_x"), F.col("apex.y").alias("apex_y"), "r_max_pix", F.lit(height).alias("image_height"), F.lit(width).alias("image_width"),
        "phi0_mask", "phi1_mask", "n_rows_mask", F.degrees(F.col("phi1_mask") - F.col("phi0_mask")).alias("mask_fan_angle_deg"),
    )


def pick_offset(scored: DataFrame) -> DataFrame:
    """One row (dx, dy, var): the first offset, dx before dy, with the least variance; none if no offset is valid."""
    return scored.where("var IS NOT NULL").agg(F.min(F.struct("var", "dx", "dy")).alias("b")).where("b IS NOT NULL").select("b.dx", "b.dy", "b.var")


def depth_variance(rows: DataFrame, depths: tuple[float, ...] = (12, 24, 36), least: int = 6) -> DataFrame:
    """(dx, dy, var) from sampled depth rows (dx, dy, r_mm, p, v): population variance of the depths whose gradient has least
    columns or more above half its maximum; null below two depths."""
    w = Window.partitionBy("dx", "dy", "r_mm").orderBy("p")
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    grad = F.abs(F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2.0))
    each = rows.where(F.col("r_mm").isin(*map(float, depths))).withColumn("g", grad)
    top = each.withColumn("top", F.max("g").over(Window.partitionBy("dx", "dy", "r_mm")))
    ok = top.groupBy("dx", "dy", "r_mm").agg(F.sum((F.col("g") > F.when(F.col("top") > 0, 0.5 * F.col("top")).otherwise(0.0)).cast("int")).alias("n"))
    used = F.when(F.col("n") >= least, F.col("r_mm"))
    return ok.groupBy("dx", "dy").agg(F.when(F.count(used) >= 2, F.var_pop(used)).alias("var"))


