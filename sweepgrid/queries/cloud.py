"""Point clouds: lineitem by return flag as segments of a surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pointcloud as pc
from . import query
from .carriers import CLOUD, cloud, frames, polar, read, rnd

CENTER, DIRECTION, APEX = (25.0, 5.0, 30.0), (0.6, 0.0, 0.8), (40.0, 5.0, 50.0)
COS = "(CASE WHEN d > 0 THEN ((x - 25.0) * 0.6 + (z - 30.0) * 0.8) / d ELSE 0 END)"
FAR = f"{CLOUD}, f AS (SELECT *, sqrt((x - 25.0) ** 2 + (y - 5.0) ** 2 + (z - 30.0) ** 2) AS d FROM pts)"
ROUND = lambda df, keys, digits=6: df.select(*keys, *(rnd(c, digits).alias(c) for c in df.columns if c not in keys))


@query(f"""WITH {CLOUD}, c AS (SELECT seg, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY seg),
r AS (SELECT seg, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d FROM pts JOIN c USING (seg)),
s AS (SELECT seg, count(*) AS n, avg(d) AS mean_r, coalesce(stddev_samp(d), 0) AS std_r, min(d) AS min_r, max(d) AS max_r FROM r GROUP BY seg)
SELECT seg, any_value(n) AS n, round(any_value(mean_r), 6) AS mean_r, round(any_value(std_r), 6) AS std_r, round(any_value(min_r), 6) AS min_r, round(any_value(max_r), 6) AS max_r,
  round(avg(CASE WHEN d BETWEEN mean_r * 0.95 AND mean_r * 1.05 THEN 100.0 ELSE 0 END), 6) AS band_pct FROM r JOIN s USING (seg) GROUP BY seg""")
def segment_radius_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUND(pc.radius_stats(cloud(spark, sf_dir)), ["seg", "n"])


@query(f"""WITH {CLOUD}, c AS (SELECT seg, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY seg),
r AS (SELECT seg, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d FROM pts JOIN c USING (seg)), m AS (SELECT seg, avg(d) AS m FROM r GROUP BY seg)
SELECT seg, round(avg(CASE WHEN d BETWEEN m * 0.8 AND m * 1.2 THEN 100.0 ELSE 0 END), 6) AS band_pct FROM r JOIN m USING (seg) GROUP BY seg""")
def sphere_band_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pc.radius_stats(cloud(spark, sf_dir), 0.2).select("seg", rnd("band_pct").alias("band_pct"))


@query(f"""WITH {CLOUD} SELECT seg, count(*) AS n, round(covar_samp(x, x), 5) + 0.0 AS xx, round(covar_samp(y, y), 5) + 0.0 AS yy, round(covar_samp(z, z), 5) + 0.0 AS zz,
round(covar_samp(x, y), 5) + 0.0 AS xy, round(covar_samp(x, z), 5) + 0.0 AS xz, round(covar_samp(y, z), 5) + 0.0 AS yz FROM pts GROUP BY seg""")
def segment_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUND(pc.pca(cloud(spark, sf_dir)).drop("e1", "e2", "e3"), ["seg", "n"], 5)


@query(f"""WITH {CLOUD}, c AS (SELECT seg, covar_samp(x, x) AS a, covar_samp(y, y) AS b, covar_samp(z, z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM pts GROUP BY seg)
SELECT seg, round(a + b + c, 4) AS trace, round((a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 1e4, 4) + 0.0 AS det, true AS ordered FROM c""")
def segment_eigen_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues by what SQL can state of them: their sum, product and order."""
    e = pc.pca(cloud(spark, sf_dir))
    return e.select("seg", rnd(F.col("e1") + F.col("e2") + F.col("e3"), 4).alias("trace"), rnd(F.col("e1") * F.col("e2") * F.col("e3") / 1e4, 4).alias("det"), ((F.col("e1") >= F.col("e2")) & (F.col("e2") >= F.col("e3"))).alias("ordered"))


@query("""WITH t AS (SELECT p_partkey, p_retailprice AS v, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 50.0 END AS gt FROM part)
SELECT p_partkey, round(CASE WHEN gt = 0 THEN NULL ELSE (v - gt) / gt * 100 END, 6) + 0.0 AS err FROM t""")
def pct_error_vs_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 11 == 0, 0.0).otherwise(F.col("p_size") * 50.0)
    return read(spark, sf_dir, "part").select("p_partkey", rnd(pc.percent_error(F.col("p_retailprice"), truth)).alias("err"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    have = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"))
    return pc.missing_names(wanted, have, "name")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved to ids; one that is missing would raise."""
    ids = read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return pc.require_names(read(spark, sf_dir, "nation"), ids, "n_regionkey").select("n_nationkey", "n_name", "r_name")


SUMS = "CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x * x) AS sxx, sum(y * y) AS syy, sum(z * z) AS szz, sum(x * y) AS sxy, sum(x * z) AS sxz, sum(y * z) AS syz, sum(q) AS sq, sum(x * q) AS sxq, sum(y * q) AS syq, sum(z * q) AS szq"
NAMES = ["n", "sx", "sy", "sz", "sxx", "syy", "szz", "sxy", "sxz", "syz", "sq", "sxq", "syq", "szq"]


@query(f"WITH {CLOUD}, s AS (SELECT seg, {SUMS} FROM (SELECT *, x * x + y * y + z * z AS q FROM pts) GROUP BY seg) SELECT seg, " + ", ".join(f"round({c} / n, 4) + 0.0 AS {c}" for c in NAMES) + " FROM s")
def sphere_fit_normal_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pc.sphere_sums(cloud(spark, sf_dir), ["seg"])
    return s.select("seg", *(rnd(F.col(c) / F.col("n"), 4).alias(c) for c in NAMES))


@query()
def robust_sphere_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z, r = pc.robust_sphere(cloud(spark, sf_dir))
    return spark.range(1).select(*(rnd(F.lit(v), 4).alias(n) for n, v in (("cx", x), ("cy", y), ("cz", z), ("radius", r))))


@query(f"WITH {FAR} SELECT vid FROM f WHERE degrees(acos(least(greatest({COS}, -1), 1))) <= 30")
def cone_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pc.angle_cap(cloud(spark, sf_dir), CENTER, DIRECTION, 30.0).select("vid")


@query(f"WITH {CLOUD} SELECT vid FROM pts WHERE (x - (40.0 - 3.0 * 0.6)) * 0.6 + (y - 5.0) * 0.0 + (z - (50.0 - 3.0 * 0.8)) * 0.8 >= 0")
def plane_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pc.plane_cap(cloud(spark, sf_dir), APEX, DIRECTION, 3.0).select("vid")


@query(f"WITH {CLOUD} SELECT vid FROM pts WHERE sqrt((x - 40.0) ** 2 + (y - 5.0) ** 2 + (z - 50.0) ** 2) <= 10")
def apex_radius_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pc.within_radius(cloud(spark, sf_dir), APEX, 10.0).select("vid")


@query(f"WITH {FAR} SELECT vid, round(d, 6) AS radius FROM f WHERE d >= (SELECT quantile_cont(d, 0.95) FROM f)")
def pseudo_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pc.pseudo_boundary(cloud(spark, sf_dir), CENTER).select("vid", rnd("radius").alias("radius"))


@query(f"WITH {FAR}, c AS (SELECT vid, d - 20.0 AS resid FROM f WHERE least(greatest({COS}, -1), 1) >= cos(radians(CAST(20 AS DOUBLE)))) SELECT vid, round(resid, 6) + 0.0 AS resid FROM c ORDER BY resid, vid LIMIT 1")
def apex_in_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    cone = pc.in_cone_or_all(pc.residuals(cloud(spark, sf_dir), (*CENTER, 20.0)), CENTER, DIRECTION, 20.0)
    return pc.extreme(cone, "resid", True).select("vid", rnd("resid").alias("resid"))


@query(f"WITH {FAR} SELECT vid FROM f WHERE d - 20.0 <= 1e-6")
def interior_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pc.sign_mask(pc.residuals(cloud(spark, sf_dir), (*CENTER, 20.0)), True).select("vid")


@query(f"WITH {FAR} SELECT round(sqrt(avg((d - 20.0) ** 2)), 6) AS rms_resid_mm, round(-min(d - 20.0), 6) AS apex_depth_mm FROM f")
def residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUND(pc.residual_summary(pc.residuals(cloud(spark, sf_dir), (*CENTER, 20.0))), [])


@query(f"""WITH {CLOUD}, q AS (SELECT 'f' || i AS name, i * 9.0 AS fx, CAST(i AS DOUBLE) AS fy, 10.0 + i * 7 AS fz FROM range(5) t(i)),
d AS (SELECT name, vid, sqrt((x - fx) ** 2 + (y - fy) ** 2 + (z - fz) ** 2) AS d FROM pts, q), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, vid) AS i FROM d)
SELECT name, vid, round(d, 6) AS d FROM r WHERE i = 1""")
def nearest_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    fid = spark.range(5).select(F.concat(F.lit("f"), i).alias("name"), (i * 9.0).alias("fx"), i.cast("double").alias("fy"), (10.0 + i * 7).alias("fz"))
    return pc.nearest_vertex(cloud(spark, sf_dir), fid).select("name", "vid", rnd("d").alias("d"))


@query(f"""WITH {FAR}, h AS (SELECT vid, seg, (d - 20.0) / 100 AS h FROM f), k AS (SELECT h FROM h WHERE seg = 'R' AND abs(h) <= (SELECT quantile_cont(abs(h), 0.98) FROM h)),
l AS (SELECT h FROM k WHERE abs(h) <= (SELECT quantile_cont(abs(h), 0.9) FROM k))
SELECT round(median(h), 6) + 0.0 AS median_h, round(median(abs(h)), 6) + 0.0 AS median_abs_h, round(avg(abs(h)), 6) + 0.0 AS mean_abs_h, round(1 / median(h), 3) + 0.0 AS r_equiv, count(*) AS n FROM l""")
def trimmed_curvature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pc.residuals(cloud(spark, sf_dir), (*CENTER, 20.0)).withColumn("h", F.col("resid") / 100)
    got = pc.trimmed_curvature(rows, F.col("seg") == "R")
    return got.select(rnd("median_h").alias("median_h"), rnd("median_abs_h").alias("median_abs_h"), rnd("mean_abs_h").alias("mean_abs_h"), rnd("r_equiv", 3).alias("r_equiv"), "n")


@query("SELECT p_partkey, round(degrees(acos(least(greatest(1 - (p_size / 10.0) / 12.0, -1), 1))), 6) AS deg, round(12.0 * (1 - cos(radians(CAST(p_size AS DOUBLE)))), 6) + 0.0 AS depth FROM part")
def cap_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", rnd(pc.cap_angle(size / 10.0, 12.0)).alias("deg"), rnd(pc.cap_depth(size, 12.0)).alias("depth"))


@query("""WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 OR event_id % 11 = 3 OR event_id % 13 = 5 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(coalesce(v, max(v) OVER (PARTITION BY event_type) + 1, 0), 6) + 0.0 AS v FROM v""")
def scalar_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values some of which are no number, or infinite to either side."""
    i = F.col("event_id")
    v = F.when(i % 9 == 0, float("nan")).when(i % 11 == 3, float("inf")).when(i % 13 == 5, float("-inf")).otherwise(F.col("value"))
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", v.alias("v"))
    return pc.fill_nonfinite(rows, "v", ["event_type"]).select("event_id", rnd("v").alias("v"))


@query(f"WITH {FAR} SELECT vid, round(d, 6) AS center_distance, round(d - 20.0, 6) + 0.0 AS resid FROM f")
def v2_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pc.residuals(cloud(spark, sf_dir), (*CENTER, 20.0))
    return rows.select("vid", rnd(pc.distance(CENTER)).alias("center_distance"), rnd("resid").alias("resid"))


@query()
def posterior_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pc.posterior_direction(pc.residuals(cloud(spark, sf_dir), (*CENTER, 20.0)), CENTER)
    return spark.range(1).select(*(rnd(F.lit(v), 5).alias(n) for n, v in zip("xyz", d, strict=True)))


@query()
def quadric_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap z = 0.05 x2 + 0.02 y2 over all vectors' places, a little rough: curvatures of about 0.1 and 0.04 by rights."""
    stack = polar(spark, sf_dir)
    at = stack.where("p = 0").select((F.col("k") * 16 + F.col("r")).cast("long").alias("vid"), ((F.col("k") - F.lit(frames(stack) // 2)) * F.lit(8.0 / frames(stack))).alias("x"), ((F.col("r") - 8) * 0.5).alias("y"), "v")
    rows = at.select("vid", "x", "y", (0.05 * F.col("x") ** 2 + 0.02 * F.col("y") ** 2 + 0.001 * F.col("v")).alias("z"))
    got = pc.quadric(rows, (0.0, 0.0, 0.0), (0.0, 0.0, -10.0))
    return spark.range(1).select(*(rnd(F.lit(float(v)), 6).alias(k.lower() + "_" if k in ("K",) else k) for k, v in got.items()))


