"""Variants, records and whole chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalars import affine
from ..functions.session import shared_dir
from ..operators import geometry, recon, registration
from ..operators import pointcloud as pc
from ..plans import qc, surface
from ..sources import records
from . import query
from .carriers import CLOUD, COLS, FAN, POLAR, cells_sql, cloud, frames, polar, read, rnd
from .mesh import sphere_of
from .volume import BLOCK, _block, _shape

V2 = f"""{POLAR}, {cells_sql(20.0, 2.0)}, nf AS (SELECT max(k) + 1 AS n FROM pol),
pos AS (SELECT ix, iy, iz, r_mm / 1.25 AS ri, phi / (radians(CAST(52 AS DOUBLE)) / 63) AS pi_, least(greatest(psi * ((n - 1) / (2 * pi())), 0), n - 1 - 1e-3) AS ki FROM cells, nf),
cor AS (SELECT ix, iy, iz, CAST(floor(ri) AS INT) + a AS r, CAST(floor(pi_) AS INT) + b AS p, CAST(floor(ki) AS INT) + c AS k,
  (CASE a WHEN 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE b WHEN 1 THEN pi_ - floor(pi_) ELSE 1 - (pi_ - floor(pi_)) END) * (CASE c WHEN 1 THEN ki - floor(ki) ELSE 1 - (ki - floor(ki)) END) AS w
  FROM pos, range(2) t1(a), range(2) t2(b), range(2) t3(c))"""


@query(f"WITH {V2} SELECT ix, iy, iz, round(sum(w * coalesce(v, 0)), 5) + 0.0 AS v FROM cor LEFT JOIN pol USING (r, p, k) GROUP BY 1, 2, 3")
def v2_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule: even angles, no padding, 0 outside the stack."""
    stack = polar(spark, sf_dir)
    cells = recon.older_positions(recon.valid_cells(spark, FAN, 2.0), FAN, frames(stack))
    return recon.trilinear(cells, stack, ["ix", "iy", "iz"]).select("ix", "iy", "iz", rnd("v", 5).alias("v"))


@query(f"""WITH {POLAR}, prof AS (SELECT k, p, sum(v) AS s FROM pol GROUP BY k, p), c AS (SELECT k, p, s - avg(s) OVER (PARTITION BY k) AS s FROM prof),
x AS (SELECT m.k AS k, a.p - m.p AS lag, sum(a.s * m.s) AS cc FROM c a JOIN c m ON a.k = 15 GROUP BY 1, 2), sh AS (SELECT k, arg_max(lag, cc) AS sh FROM x GROUP BY k)
SELECT k, r, CAST((p + sh + 640) % 64 AS INT) AS p, round(v, 6) + 0.0 AS v FROM pol JOIN sh USING (k)""")
def v2_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.register_older(polar(spark, sf_dir), COLS, 15).select("k", "r", "p", rnd("v").alias("v"))


@query(f"""WITH {POLAR}, n AS (SELECT max(k) + 1 AS n FROM pol) SELECT CAST(k + 2 AS INT) AS k, r, p, round(v, 6) + 0.0 AS v FROM pol
UNION ALL SELECT CAST(k - n + 2 AS INT), r, p, round(v, 6) + 0.0 FROM pol, n WHERE k >= n - 2 UNION ALL SELECT CAST(k + n + 2 AS INT), r, p, round(v, 6) + 0.0 FROM pol, n WHERE k < 2""")
def theta_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    return recon.pad_theta(stack, frames(stack), 2).select("k", "r", "p", rnd("v").alias("v"))


@query(f"WITH {POLAR}, p AS (SELECT k, p, sum(v) AS s FROM pol GROUP BY k, p) SELECT k, p, round(s, 6) + 0.0 AS s FROM p")
def depth_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.profile(polar(spark, sf_dir)).select("k", "p", rnd("s").alias("s"))


@query("""SELECT p_partkey AS n_rows_mask, p_size + CAST(0.25 AS DOUBLE) AS apex_x, CAST(p_retailprice AS DOUBLE) AS r_max_pix, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / CAST(64 AS DOUBLE) END AS phi0_mask,
substr(sha1(p_name || CAST(p_partkey AS VARCHAR)), 1, 2) AS mask_sha1_12 FROM part""")
def record_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration records written as JSON, by their masks' hashes, and read back."""
    size = F.col("p_size").cast("double")
    made = read(spark, sf_dir, "part").select(
        F.array(size + 0.25, size).alias("apex_xy"), F.col("p_retailprice").cast("double").alias("r_max_pix"), F.lit(512).alias("image_height"), F.lit(640).alias("image_width"), F.when(F.col("p_size") % 3 != 0, size / 64).alias("phi0_mask"), F.lit(1.0).alias("phi1_mask"),
        F.col("p_partkey").cast("int").alias("n_rows_mask"), F.lit(52.0).alias("mask_fan_angle_deg"), F.col("p_name").alias("mask_file"), F.substring(F.sha1(F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary")), 1, 2).alias("mask_sha1_12"),
    )
    path = f"{shared_dir(spark)}/calibrations-{uuid.uuid4().hex}"
    records.write_calibration(made, path)
    got = records.calibration_record(spark, path)
    return got.select(F.col("n_rows_mask").cast("long").alias("n_rows_mask"), F.col("apex_xy")[0].alias("apex_x"), "r_max_pix", "phi0_mask", "mask_sha1_12")


@query("""SELECT s_nationkey AS scan_id, count(*) || ' frames, ' || max(s_suppkey) || ' x ' || max(s_suppkey % 100) || ', values ' || printf('%.1f', floor(min(s_acctbal))) || ' to ' || printf('%.1f', floor(max(s_acctbal))) AS summary FROM supplier GROUP BY 1""")
def stack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return records.stack_summary(s.select(F.col("s_nationkey").alias("scan_id"), F.col("s_suppkey").alias("height"), (F.col("s_suppkey") % 100).alias("width"), F.floor("s_acctbal").cast("double").alias("lo"), F.floor("s_acctbal").cast("double").alias("hi")))


@query("""WITH f AS (SELECT c_nationkey AS scan_id, arg_min(c_custkey, c_custkey) AS h, arg_min(c_custkey % 300, c_custkey) AS w FROM customer GROUP BY 1)
SELECT scan_id, CAST(0 AS DOUBLE) AS apex_x, h / 2.0 AS apex_y, CAST(greatest(w - 1, 1) AS DOUBLE) AS r_max_pix, h AS n_rows_mask FROM f""")
def default_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scan_id"), F.col("c_custkey").alias("frame_idx"), F.col("c_custkey").alias("height"), (F.col("c_custkey") % 300).alias("width"))
    return geometry.default_calibration(c).select("scan_id", "apex_x", "apex_y", "r_max_pix", "n_rows_mask")


@query("SELECT p_partkey, p_name AS name FROM part WHERE p_name LIKE '%e%'")
def nodes_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.containing(read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), "e")


@query("SELECT n_nationkey, n_name AS name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation WHERE starts_with(n_name, (SELECT substr(min(n_name), 1, 2) FROM nation)))")
def node_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    start = nodes.agg(F.substring(F.min("name"), 1, 2)).first()[0]
    return records.pick_by_name(nodes, start)


@query("SELECT n_nationkey, n_name AS name FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)")
def node_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_by_name(read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")), "no such node")


@query(f"WITH {CLOUD} SELECT vid, round(0.8 * x - 0.6 * y + 4, 6) + 0.0 AS x, round(0.6 * x + 0.8 * y - 2, 6) + 0.0 AS y, round(z + 1, 6) + 0.0 AS z FROM pts")
def world_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of a segment moved by its parent transform."""
    m = [[0.8, -0.6, 0.0, 4.0], [0.6, 0.8, 0.0, -2.0], [0.0, 0.0, 1.0, 1.0]]
    return cloud(spark, sf_dir).select("vid", *(rnd(affine(row, F.col("x"), F.col("y"), F.col("z"))).alias(n) for row, n in zip(m, "xyz", strict=True)))


@query(f"""WITH {CLOUD}, c AS (SELECT seg, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY seg),
d AS (SELECT c.*, sqrt((cx - 10.0) ** 2 + (cy - 5.0) ** 2 + (cz - 20.0) ** 2) AS dist FROM c), r AS (SELECT seg, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS r FROM pts JOIN c USING (seg) GROUP BY seg)
SELECT seg, round(dist, 6) AS distance_mm, round((dist - 30.0) / 30.0 * 100, 5) + 0.0 AS distance_err_pct, round((r - 7.2) / 7.2 * 100, 5) + 0.0 AS radius_err_pct FROM d JOIN r USING (seg)""")
def phantom_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = surface.phantom_metrics(cloud(spark, sf_dir), (10.0, 5.0, 20.0))
    return got.select("seg", rnd("distance_mm").alias("distance_mm"), rnd("distance_err_pct", 5).alias("distance_err_pct"), rnd("radius_err_pct", 5).alias("radius_err_pct"))


@query("""WITH t AS (SELECT s_suppkey, s_acctbal AS mean_r, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal / 100 END AS radius_err_pct FROM supplier)
SELECT s_suppkey, printf('%.2f', mean_r) AS mean_r, CASE WHEN radius_err_pct IS NULL THEN 'N/A' ELSE printf('%.2f', radius_err_pct) END AS radius_err_pct FROM t""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("mean_r"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal") / 100).alias("radius_err_pct"))
    return records.report_text(s)


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE round(s_acctbal) END AS FLOAT) AS radius_err_pct FROM supplier")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.round("s_acctbal")).alias("radius_err_pct"))
    return records.report_table(s)


@query()
def posterior_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slightly rough sphere of radius 12, by its angle cap."""
    v, f = sphere_of(spark, sf_dir)
    got = surface.posterior_metrics(v, f, surface.PosteriorOptions(mode="angle", smooth_rounds=0, radius_limit_mm=100.0))
    keep = ("patch", "apex_mode", "patch_area_mm2", "R_mm", "rms_resid_mm", "disc_R_equiv_patch_mm")
    return spark.range(1).select(*(F.lit(got[k]).alias(k) if isinstance(got[k], str) else rnd(F.lit(float(got[k])), 3).alias(k) for k in keep))


@query()
def posterior_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the same sphere, with its 16 columns."""
    v, f = sphere_of(spark, sf_dir)
    o = surface.PosteriorOptions(mode="angle", smooth_rounds=0, radius_limit_mm=100.0)
    got = records.posterior_report(spark, surface.posterior_metrics(v, f, o), o.mode, o.geodesic_mm, o.angle_deg, o.plane_mm)
    return got.select(*(rnd(c, 3).alias(c) if kind == "double" else F.col(c) for c, kind in got.dtypes))


@query()
def v2_posterior_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = sphere_of(spark, sf_dir)
    got = surface.posterior_metrics(v, f, surface.PosteriorOptions.older(), apex=(1.0, 2.0, 15.0))
    return spark.range(1).select(*(rnd(F.lit(float(got[k])), 3).alias(k) for k in ("patch_area_mm2", "R_mm", "rms_resid_mm")))


@query()
def preprocess_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _, _ = surface.preprocess(_block(spark, sf_dir), _shape(spark, sf_dir), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), surface.PrepOptions(spacing_mm=0.9, diffusion_rounds=1))
    return got.select("ix", "iy", "iz", "q")


@query()
def qc_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections and slices as PNG: their sizes in bytes and hashes."""
    stack = polar(spark, sf_dir)
    voxels = recon.resample(spark, stack, FAN, frames(stack), 2.0)
    n = recon.axis_count(FAN.depth_mm, 2.0)
    return qc.encoded(qc.pictures(voxels, n), n).select("picture", F.length("png").alias("n_bytes"), F.sha1("png").alias("sha1"))


@query()
def segmentation_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    return qc.segment_spans(stack, frames(stack) // 2, 8, 24.0 * FAN.dphi).select(rnd("threshold_mm", 5).alias("threshold_mm"), rnd("edge_mm", 5).alias("edge_mm"))


@query()
def slice_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_slices(_block(spark, sf_dir), f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}", "block", "iz", _shape(spark, sf_dir))


@query(f"WITH {BLOCK} SELECT 'block' AS vol_id, ix, iy, iz, v FROM blk WHERE v <> 0")
def nrrd_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume written as NRRD and read back; the folder must be one that all workers see as a file path."""
    from ..sources.nrrd import read_nrrd, write_nrrd

    path = f"{shared_dir(spark)}/nrrd-{uuid.uuid4().hex}".removeprefix("file:").replace("//", "/")
    write_nrrd(_block(spark, sf_dir), path, _shape(spark, sf_dir), 1.0, vol_id="block")
    return read_nrrd(spark, path).select("vol_id", "ix", "iy", "iz", "v")


@query()
def raw_and_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.sweep import SweepOptions
    from ..plans.sweep import raw_and_smooth as both

    raw, smooth = both(spark, polar(spark, sf_dir), FAN, SweepOptions(voxel_mm=2.0))
    parts = [s.voxels.select(F.lit(n).alias("branch"), "ix", "iy", "iz", rnd("v", 4).alias("v")) for n, s in (("raw", raw), ("smooth", smooth))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {CLOUD} SELECT vid, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM pts WHERE vid % 10 = 0")
def point_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator that keeps every tenth point."""
    return pc.subsample(cloud(spark, sf_dir), 10).select("vid", *(rnd(c).alias(c) for c in "xyz"))


@query(f"WITH {CLOUD} SELECT vid, 'cap_' || printf('%.0f', floor(x)) || 'deg' AS cap, 'geodesic_' || printf('%.1f', floor(x) / 2) || 'mm' AS geodesic FROM pts")
def patch_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.floor("x").cast("double")
    return cloud(spark, sf_dir).select("vid", names.patch_label("angle", size).alias("cap"), names.patch_label("geodesic", size / 2).alias("geodesic"))
