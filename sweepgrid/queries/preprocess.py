"""Geometry, masks, sampling of images, and the whole chains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, polar, recon
from . import query
from .carriers import POLAR, frames, read, rnd
from .carriers import polar as stack_of


def _calibs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration record of each part: some without depth, rows or bounds."""
    i, n = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select(
        i.alias("i"), F.lit(512).alias("image_height"), (n + 400.0).alias("r_max_pix"), F.when(i % 4 == 0, None).otherwise(F.lit(0.5) * (n % 40)).alias("depth_mm"),
        F.when(i % 5 == 0, None).otherwise((n + 200).cast("int")).alias("n_rows_mask"),
        F.when(i % 3 == 0, None).otherwise(0.02 * n - 0.5).alias("phi0_mask"), F.when(i % 3 == 0, None).otherwise(0.7 - 0.03 * n).alias("phi1_mask"),
    )


CALIBS = """cal AS (SELECT p_partkey AS i, p_size + CAST(400 AS DOUBLE) AS r_max_pix, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) * (p_size % 40) END AS depth_mm, CASE WHEN p_partkey % 5 = 0 THEN 512 ELSE p_size + 200 END AS rows_eff,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(0.02 AS DOUBLE) * p_size - 0.5 END AS a, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 0.7 - CAST(0.03 AS DOUBLE) * p_size END AS b FROM part),
geo AS (SELECT i, CAST(rows_eff AS INT) AS rows_eff, coalesce(nullif(depth_mm, 0), 48.0) AS depth, CASE WHEN a IS NULL OR least(a, b) < 0 THEN 0 ELSE least(a, b) END AS phi0,
  CASE WHEN a IS NULL THEN radians(CAST(52 AS DOUBLE)) WHEN least(a, b) < 0 THEN greatest(a, b) - least(a, b) ELSE greatest(a, b) END AS phi1, r_max_pix FROM cal)"""


@query(f"WITH {CALIBS} SELECT i, rows_eff, round(CAST(depth AS DOUBLE), 6) AS depth, round(CAST(phi0 AS DOUBLE), 6) + 0.0 AS phi0, round(CAST(phi1 AS DOUBLE), 6) + 0.0 AS phi1, round(CAST((phi1 - phi0) / (rows_eff - 1) AS DOUBLE), 9) + 0.0 AS dphi, round(CAST(depth / r_max_pix AS DOUBLE), 9) AS dr FROM geo")
def geometry_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometry.geometry(_calibs(spark, sf_dir))
    return g.select("i", "rows_eff", *(rnd(c).alias(c) for c in ("depth", "phi0", "phi1")), rnd("dphi", 9).alias("dphi"), rnd("dr", 9).alias("dr"))


@query(f"""WITH {CALIBS} SELECT i, round(CAST(CASE WHEN a IS NULL THEN -radians(CAST(26 AS DOUBLE)) ELSE least(a, b) END AS DOUBLE), 6) + 0.0 AS phi0,
round(CAST(CASE WHEN a IS NULL THEN radians(CAST(26 AS DOUBLE)) ELSE greatest(a, b) END AS DOUBLE), 6) + 0.0 AS phi1 FROM cal""")
def v2_geometry_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geometry.geometry(_calibs(spark, sf_dir), older=True)
    return g.select("i", rnd("phi0").alias("phi0"), rnd("phi1").alias("phi1"))


@query(f"WITH {CALIBS} SELECT i, CAST(d AS DOUBLE) AS r_mm, round(CAST(d * (phi1 - phi0) AS DOUBLE), 6) + 0.0 AS arc_mm, round(CAST(d * (phi1 - phi0) / (rows_eff - 1) AS DOUBLE), 9) + 0.0 AS lateral_mm FROM geo, (VALUES (10.0), (20.0), (30.0), (40.0)) v(d)")
def lateral_resolution_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    depths = spark.range(1, 5).select((F.col("id") * 10.0).alias("r_mm"))
    got = geometry.lateral_resolution(geometry.geometry(_calibs(spark, sf_dir)), depths)
    return got.select("i", "r_mm", rnd("arc_mm").alias("arc_mm"), rnd("lateral_mm", 9).alias("lateral_mm"))


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stack as images of 64 x 16 pixels."""
    return stack_of(spark, sf_dir).select("k", F.col("r").alias("y"), F.col("p").alias("x"), "v")


#: A grid of 30 rows and 20 angles about (4, 2), most of it inside the images.
SAMPLED = "g AS (SELECT CAST(r AS INT) AS r, CAST(p AS INT) AS p, 4.0 + (30.0 * r / 29) * cos(0.1 + 0.8 * p / 19) AS sx, 2.0 + (30.0 * r / 29) * sin(0.1 + 0.8 * p / 19) AS sy FROM range(30) a(r), range(20) b(p))"


@query(f"""WITH {POLAR}, px AS (SELECT k, r AS y, p AS x, v FROM pol), {SAMPLED},
t AS (SELECT r, p, CAST(floor(sx) AS INT) + a AS x, CAST(floor(sy) AS INT) + b AS y, (CASE a WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE b WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w FROM g, range(2) c(a), range(2) d(b)),
m AS (SELECT k, r, p, sum(w * v) AS v FROM t JOIN px USING (x, y) GROUP BY 1, 2, 3)
SELECT f.k, g.r, g.p, round(CAST(coalesce(v, 0) AS DOUBLE), 5) + 0.0 AS v FROM g CROSS JOIN (SELECT DISTINCT k FROM px) f LEFT JOIN m ON m.k = f.k AND m.r = g.r AND m.p = g.p""")
def polar_grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = polar.sampling_grid(spark, (4.0, 2.0), 0.1, 0.9, 30.0, 20)
    return polar.bilinear(_image(spark, sf_dir), grid).select("k", "r", "p", rnd("v", 5).alias("v"))


@query(f"""WITH {POLAR}, mk AS (SELECT p AS x, r AS y FROM pol GROUP BY p, r HAVING max(v) > 0.2), {SAMPLED}
SELECT g.r, g.p FROM g JOIN mk ON mk.x = round_even(CAST(sx AS DOUBLE), 0) AND mk.y = round_even(CAST(sy AS DOUBLE), 0)""")
def mask_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask holds the pixels that are bright in some frame."""
    grid = polar.sampling_grid(spark, (4.0, 2.0), 0.1, 0.9, 30.0, 20)
    bright = _image(spark, sf_dir).groupBy("x", "y").agg(F.max("v").alias("v")).where("v > 0.2")
    return polar.nearest_mask(bright.select("x", "y"), grid)


@query("SELECT l_orderkey, l_linenumber, CAST((299 * (l_partkey % 256) + 587 * (l_suppkey % 256) + 114 * (l_orderkey % 256) + 500) // 1000 AS INT) AS gray FROM lineitem")
def gray_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, g, r = (F.col(c) % 256 for c in ("l_partkey", "l_suppkey", "l_orderkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", polar.gray(b, g, r).alias("gray"))


W, H, R, FAN = 260, 256, 220.0, 26.0
CONE = f"cone AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM range({W}) a(x), range({H}) b(y) WHERE x >= 20 AND sqrt((x - 20.0) ** 2 + (y - 128.0) ** 2) <= {R} AND abs(y - 128.0) <= (x - 20.0) * tan(radians(CAST({FAN} AS DOUBLE))))"


def _cone(spark: SparkSession) -> DataFrame:
    px = spark.range(W * H).select((F.col("id") % W).cast("int").alias("x"), F.expr(f"cast(id div {W} as int)").alias("y"))
    return px.where(f"x >= 20 AND sqrt(pow(x - 20.0D, 2) + pow(y - 128.0D, 2)) <= {R} AND abs(y - 128.0D) <= (x - 20.0D) * {math.tan(math.radians(FAN))!r}D")


#: The bright pixels of one tall image of all vectors.
BRIGHT = "cone AS (SELECT p AS x, k * 16 + r AS y FROM pol WHERE v > 0.15 AND p >= 3)"


def _bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack_of(spark, sf_dir).where("v > 0.15 AND p >= 3").select(F.col("p").alias("x"), (F.col("k") * 16 + F.col("r")).alias("y"))


@query(f"""WITH {POLAR}, {BRIGHT}, c AS (SELECT x, min(y) AS lo, max(y) AS hi FROM cone GROUP BY x), m AS (SELECT min(x) AS x0 FROM cone)
SELECT (SELECT count(DISTINCT y) FROM cone) AS n_rows_mask, CAST(any_value(x0) AS DOUBLE) AS seed_x, round(avg(0.5 * (lo + hi)), 6) AS seed_y FROM c, m WHERE x < x0 + 5""")
def mask_rows_apex_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.mask_rows(_bright(spark, sf_dir)).select("n_rows_mask", "seed_x", rnd("seed_y").alias("seed_y"))


@query("""WITH p AS (SELECT l_returnflag AS side, CAST(l_quantity AS DOUBLE) AS x, l_quantity * (CASE l_returnflag WHEN 'A' THEN 0.3 WHEN 'N' THEN -0.5 ELSE 0.1 END) + l_discount AS y FROM lineitem),
s AS (SELECT side, avg(x) AS px, avg(y) AS py, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t, count(*) AS n FROM p GROUP BY side)
SELECT side, round(px, 6) AS px, round(py, 6) + 0.0 AS py, round(cos(t), 6) AS vx, round(sin(t), 6) + 0.0 AS vy, n FROM s""")
def tls_line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope = F.when(F.col("l_returnflag") == "A", 0.3).when(F.col("l_returnflag") == "N", -0.5).otherwise(0.1)
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_quantity").alias("x"), (F.col("l_quantity") * slope + F.col("l_discount")).alias("y"))
    return geometry.line_fit(rows, ["side"]).select("side", *(rnd(c).alias(c) for c in ("px", "py", "vx", "vy")), "n")


@query()
def mask_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cone with a detached blob: the record should name apex (20, 128), +-26 degrees and radius 220."""
    blob = _cone(spark).sparkSession.range(30).select((F.col("id") % 6).cast("int").alias("x"), F.expr("cast(id div 6 as int)").alias("y"))
    got = geometry.calibrate(_cone(spark).unionByName(blob), W, H)
    return got.select(*(rnd(c, 3).alias(c) for c in ("apex_x", "apex_y", "r_max_pix", "phi0_mask", "phi1_mask", "mask_fan_angle_deg")), "n_rows_mask", "image_height", "image_width")


@query(f"WITH {POLAR}, {BRIGHT}, s AS (SELECT y, max(x) - min(x) + 1 AS n FROM cone GROUP BY y HAVING count(*) >= 2) SELECT CAST(d AS DOUBLE) AS r_mm, CAST(0 AS DOUBLE) AS err FROM s JOIN (VALUES (10, 151), (20, 174), (30, 197), (40, 220)) v(d, y) USING (y)")
def row_arc_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = geometry.row_arc_error(_bright(spark, sf_dir), (20.0, 128.0), math.asin(0.5022), 0.0036, 48.0 / R, H)
    return got.select("r_mm", rnd("err").alias("err"))


@query(f"""WITH {POLAR}, d AS (SELECT k AS dx, r % 3 AS dy, 12.0 * (r // 3 + 1) AS r_mm, p, v FROM pol),
g AS (SELECT dx, dy, r_mm, abs(CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END) AS g FROM d WINDOW w AS (PARTITION BY dx, dy, r_mm ORDER BY p)),
t AS (SELECT *, max(g) OVER (PARTITION BY dx, dy, r_mm) AS top FROM g),
ok AS (SELECT dx, dy, r_mm, count(*) FILTER (g > CASE WHEN top > 0 THEN 0.5 * top ELSE 0 END) AS n FROM t WHERE r_mm IN (12, 24, 36) GROUP BY 1, 2, 3)
SELECT dx, CAST(dy AS INT) AS dy, CASE WHEN count(*) FILTER (n >= 24) >= 2 THEN round(var_pop(CAST(r_mm AS DOUBLE)) FILTER (n >= 24), 6) END AS var FROM ok GROUP BY 1, 2""")
def depth_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame three times over as a place of the apex; rows of six depths, of which the operator takes three."""
    rows = stack_of(spark, sf_dir).select(F.col("k").alias("dx"), (F.col("r") % 3).alias("dy"), (12.0 * (F.expr("r div 3") + 1)).alias("r_mm"), "p", "v")
    return geometry.depth_variance(rows, least=24).select("dx", "dy", rnd("var").alias("var"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey % 9 AS dx, l_partkey % 5 AS dy, l_quantity AS r FROM lineitem), s AS (SELECT dx, dy, CASE WHEN count(*) >= 2 THEN round(var_pop(r), 6) END AS var FROM d GROUP BY dx, dy)
SELECT dx, dy, var FROM s WHERE var IS NOT NULL ORDER BY var, dx, dy LIMIT 1""")
def apex_micro_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the offsets with the least variance."""
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 9).alias("dx"), (F.col("l_partkey") % 5).alias("dy"), F.col("l_quantity").alias("r")).distinct()
    scored = rows.groupBy("dx", "dy").agg(F.when(F.count(F.lit(1)) >= 2, rnd(F.var_pop("r"))).alias("var"))
    return geometry.pick_offset(scored).select("dx", "dy", "var")


@query("""WITH sc AS (SELECT vec_id // 128 AS scan_id, 14.0 + 2 * (min(label) % 4) AS depth FROM embeddings GROUP BY 1), sd AS (SELECT *, CAST(depth AS INT) AS side FROM sc),
ax AS (SELECT scan_id, depth, CAST(i AS INT) AS i, CAST(CAST(-depth + 2 * depth * i / (side - 1) AS FLOAT) AS DOUBLE) AS x FROM sd, range(32) t(i) WHERE i < side),
c AS (SELECT a.i AS ix, a.x AS x, sqrt(b.x ** 2 + c.x ** 2) AS rho, a.depth FROM ax a JOIN ax b USING (scan_id) JOIN ax c USING (scan_id))
SELECT CAST(min(ix // 4) AS BIGINT) AS first_slab, CAST(max(ix // 4) AS BIGINT) AS last_slab, count(*) AS n_valid FROM c WHERE sqrt(x ** 2 + rho ** 2) <= depth AND atan2(rho, x) BETWEEN 0 AND radians(CAST(52 AS DOUBLE))""")
def valid_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slabs of the cells of all scans: 128 vectors make one, whose smallest label sets its depth."""
    by = F.floor(F.col("vec_id") / 128).alias("scan_id")
    scans = read(spark, sf_dir, "embeddings").groupBy(by).agg((14.0 + 2 * (F.min("label") % 4)).alias("depth"))
    named = scans.select("scan_id", "depth", F.lit(0.0).alias("phi0"), F.lit(math.radians(52.0)).alias("phi1"), F.lit(2.0).alias("voxel_mm"))
    return recon.slab_bounds(recon.scan_cells(named, ["scan_id"], []), 4)


@query()
def spline_resample_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = stack_of(spark, sf_dir)
    fan = recon.Fan(20.0, 0.0, math.radians(52.0), 16, 64)
    return recon.resample(spark, stack, fan, frames(stack), 2.0, order=3, sigma_deg=6.0).select("ix", "iy", "iz", rnd("v", 4).alias("v"))


@query()
def full_sweep_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.sweep import SweepOptions, reconstruct

    stack = stack_of(spark, sf_dir)
    got = reconstruct(spark, stack, recon.Fan(20.0, 0.0, math.radians(52.0), 16, 64), SweepOptions(voxel_mm=2.0))
    return got.voxels.select("ix", "iy", "iz", rnd("v", 4).alias("v"))


def _pixel_sweep(spark: SparkSession, sf_dir: str, older: bool) -> DataFrame:
    """The whole chain from pixels: rows of a frame's stack read as the rows of an image of 64 x 16 pixels, without a mask."""
    from ..plans.sweep import SweepOptions, from_frames

    pixels = stack_of(spark, sf_dir).select("k", F.col("r").alias("y"), F.col("p").alias("x"), F.abs("v").alias("v"))
    first = spark.createDataFrame([("scan", 0, 16, 64)], "scan_id string, frame_idx int, height int, width int")
    calib = geometry.default_calibration(first).withColumn("depth_mm", F.lit(20.0))
    record = geometry.geometry(calib, older=older).first().asDict()
    got = from_frames(spark, pixels, record, SweepOptions(depth_mm=20.0, voxel_mm=2.0, older=older))
    return got.voxels.select("ix", "iy", "iz", rnd("v", 4).alias("v"))


@query()
def sweep_from_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel_sweep(spark, sf_dir, False)


@query()
def v2_sweep_from_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixel_sweep(spark, sf_dir, True)
