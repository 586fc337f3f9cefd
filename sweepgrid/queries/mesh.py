"""Meshes: a height field and a sphere, made alike in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh
from . import query
from .carriers import POLAR, ROWS, frames, polar, rnd

M = ROWS
#: A height field over all vectors: frame i, row j, and the mean of the row's values, stretched, as its height.
GRID = f"""{POLAR}, vtx AS (SELECT CAST(k * {M} + r AS BIGINT) AS vid, CAST(k AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y, 40 * avg(v) AS z FROM pol GROUP BY k, r),
cell AS (SELECT k AS i, j, h FROM (SELECT DISTINCT k FROM pol), range({M - 1}) t2(j), range(2) t3(h) WHERE k < (SELECT max(k) FROM pol)),
fac AS (SELECT (i * {M - 1} + j) * 2 + h AS fid, CASE h WHEN 0 THEN i * {M} + j ELSE i * {M} + j + 1 END AS v0, (i + 1) * {M} + j AS v1,
  CASE h WHEN 0 THEN i * {M} + j + 1 ELSE (i + 1) * {M} + j + 1 END AS v2 FROM cell)"""
EDGE = """ed AS (SELECT s AS src, d AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS w FROM (
  SELECT v0 AS s, v1 AS d FROM fac UNION ALL SELECT v1, v2 FROM fac UNION ALL SELECT v2, v0 FROM fac UNION ALL SELECT v1, v0 FROM fac UNION ALL SELECT v2, v1 FROM fac UNION ALL SELECT v0, v2 FROM fac)
  JOIN vtx a ON a.vid = s JOIN vtx b ON b.vid = d)"""
AREA = """fa AS (SELECT fid, v0, v1, v2, 0.5 * sqrt(((b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y)) ** 2 + ((b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z)) ** 2 + ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) ** 2) AS area
  FROM fac JOIN vtx a ON a.vid = v0 JOIN vtx b ON b.vid = v1 JOIN vtx c ON c.vid = v2)"""
RIM = "rim AS (SELECT DISTINCT unnest([a, b]) AS vid FROM (SELECT a, b FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM ed) GROUP BY a, b HAVING count(*) = 2))"


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stack = polar(spark, sf_dir)
    v = stack.groupBy("k", "r").agg((40 * F.avg("v")).alias("z")).select((F.col("k") * M + F.col("r")).cast("long").alias("vid"), F.col("k").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "z")
    h = F.col("id") % 2
    cell = spark.range((frames(stack) - 1) * (M - 1) * 2).select(F.col("id").alias("fid"), F.expr(f"(id div 2) div {M - 1}").alias("i"), F.expr(f"(id div 2) % {M - 1}").alias("j"), h.alias("h"))
    at = lambda di, dj: (F.col("i") + di) * M + F.col("j") + dj
    faces = cell.select("fid", F.when(F.col("h") == 0, at(0, 0)).otherwise(at(0, 1)).alias("v0"), at(1, 0).alias("v1"), F.when(F.col("h") == 0, at(0, 1)).otherwise(at(1, 1)).alias("v2"))
    return v, faces


def _sphere(spark: SparkSession, rings: int = 24, parts: int = 48, r: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """A UV sphere around (1, 2, 3)."""
    n = (rings - 1) * parts
    t, p = (F.expr(f"id div {parts}") + 1) * (math.pi / rings), (F.col("id") % parts) * (2 * math.pi / parts)
    v = spark.range(n).select(F.col("id").alias("vid"), (1 + r * F.sin(t) * F.cos(p)).alias("x"), (2 + r * F.sin(t) * F.sin(p)).alias("y"), (3 + r * F.cos(t)).alias("z"))
    v = v.unionByName(spark.createDataFrame([(n, 1.0, 2.0, 3.0 + r), (n + 1, 1.0, 2.0, 3.0 - r)], v.schema))
    i, j = F.expr(f"id div {parts}"), F.col("id") % parts
    k = (j + 1) % parts
    band = spark.range((rings - 2) * parts)
    a, b, c, d = i * parts + j, i * parts + k, (i + 1) * parts + j, (i + 1) * parts + k
    tri = band.select(F.explode(F.array(F.struct(a.alias("v0"), c.alias("v1"), b.alias("v2")), F.struct(b.alias("v0"), c.alias("v1"), d.alias("v2")))).alias("f")).select("f.*")
    cap = spark.range(parts)
    j, k = F.col("id"), (F.col("id") + 1) % parts
    tri = tri.unionByName(cap.select(F.lit(n).cast("long").alias("v0"), j.alias("v1"), k.alias("v2")))
    tri = tri.unionByName(cap.select(F.lit(n + 1).cast("long").alias("v0"), (k + (rings - 2) * parts).alias("v1"), (j + (rings - 2) * parts).alias("v2")))
    return v, tri.withColumn("fid", F.xxhash64("v0", "v1", "v2"))


def sphere_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sphere with a ring for each frame, its radius roughened a little by the frame's values."""
    stack = polar(spark, sf_dir)
    v, f = _sphere(spark, frames(stack) + 1, 48)
    rough = stack.where("r = 0 AND p < 48").select((F.col("k") * 48 + F.col("p")).cast("long").alias("vid"), (1 + 0.002 * F.col("v")).alias("s"))
    moved = v.join(rough, "vid", "left").withColumn("s", F.coalesce("s", F.lit(1.0)))
    return moved.select("vid", *((F.lit(c) + (F.col(a) - c) * F.col("s")).alias(a) for a, c in (("x", 1.0), ("y", 2.0), ("z", 3.0)))), f


@query(f"WITH {GRID}, {EDGE} SELECT src, dst, count(*) AS times, round(any_value(w), 6) AS w FROM ed GROUP BY src, dst")
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    return mesh.edges(f, v).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"), rnd(F.max("w")).alias("w"))


@query(f"WITH {GRID}, {EDGE}, {RIM} SELECT vid FROM rim")
def mesh_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.boundary(_grid(spark, sf_dir)[1])


@query(f"WITH {GRID}, {AREA}, p AS (SELECT vid FROM vtx WHERE x + y < 15) SELECT round(sum(area), 6) AS area, count(*) AS n FROM fa WHERE v0 IN (FROM p) AND v1 IN (FROM p) AND v2 IN (FROM p)")
def patch_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    return mesh.patch_area(f, v, v.where("x + y < 15")).select(rnd("area").alias("area"), "n")


#: Edges of the longest shortest way over the grid of 32 frames, and some more.
LEVELS = 64


def _paths_sql(seed: str) -> str:
    """Bellman-Ford by levels: as many rounds as any shortest way has edges at most."""
    steps = "".join(f", d{i + 1} AS (SELECT vid, min(d) AS d FROM (SELECT * FROM d{i} UNION ALL SELECT dst, d + w FROM d{i} JOIN u ON src = vid) GROUP BY vid)" for i in range(LEVELS))
    return f"WITH {GRID}, {EDGE}, {RIM}, u AS (SELECT src, dst, min(w) AS w FROM ed GROUP BY 1, 2), d0 AS (SELECT vid, CAST(0 AS DOUBLE) AS d FROM {seed}){steps}"


@query(_paths_sql("vtx WHERE vid = 0") + f" SELECT vid, round(d, 6) + 0.0 AS d FROM d{LEVELS}")
def geodesic_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    return mesh.geodesic(f, v, v.where("vid = 0")).select("vid", rnd("d").alias("d"))


@query(_paths_sql("rim") + f" SELECT vid, round(d, 6) + 0.0 AS d FROM d{LEVELS}")
def geodesic_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    return mesh.geodesic(f, v, mesh.boundary(f)).select("vid", rnd("d").alias("d"))


@query(_paths_sql("rim") + f" SELECT vid, round(d, 6) + 0.0 AS d FROM d{LEVELS} ORDER BY d DESC, vid LIMIT 1")
def boundary_distance_apex(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    return mesh.farthest_from_boundary(f, v, v, v).select("vid", rnd("d").alias("d"))


@query(_paths_sql("vtx WHERE vid = 0") + f""", {AREA}, s AS (SELECT greatest(a.d, b.d, c.d) AS radius, area FROM fa JOIN d{LEVELS} a ON a.vid = v0 JOIN d{LEVELS} b ON b.vid = v1 JOIN d{LEVELS} c ON c.vid = v2)
SELECT round(radius, 5) AS radius, round(sum(sum(area)) OVER (ORDER BY radius), 5) AS area FROM s GROUP BY radius""")
def area_vs_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    got = mesh.area_by_radius(f, v, mesh.geodesic(f, v, v.where("vid = 0")))
    return got.select(rnd("radius", 5).alias("radius"), rnd("area", 5).alias("area"))


@query()
def fixed_area_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    table = mesh.area_by_radius(f, v, mesh.geodesic(f, v, v.where("vid = 0")))
    return spark.range(1).select(rnd(F.lit(mesh.radius_for_area(table, 60.0)), 5).alias("radius"))


@query(f"WITH {GRID}, {EDGE}, r AS (SELECT src AS vid, dst AS near FROM ed UNION ALL SELECT vid, vid FROM vtx) SELECT r.vid, median(z) AS v FROM r JOIN vtx ON vtx.vid = near GROUP BY r.vid")
def one_ring_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    return mesh.ring_median(f, v.select("vid", F.col("z").alias("v")))


@query(f"WITH {GRID}, {EDGE}, s0 AS (SELECT vid, z AS v FROM vtx)" + "".join(f", s{i + 1} AS (SELECT a.vid, any_value(a.v) + 0.5 * (avg(b.v) - any_value(a.v)) AS v FROM s{i} a JOIN ed ON src = a.vid JOIN s{i} b ON b.vid = dst GROUP BY a.vid)" for i in range(5)) + " SELECT vid, round(v, 6) + 0.0 AS v FROM s5")
def laplacian_scalar_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    return mesh.smooth_scalar(f, v.select("vid", F.col("z").alias("v"))).select("vid", rnd("v").alias("v"))


@query()
def discrete_mean_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over a slightly rough sphere of radius 12: about 1 / 12 by rights."""
    v, f = sphere_of(spark, sf_dir)
    return mesh.mean_curvature(f, v).agg(rnd(F.median("h"), 4).alias("median_h"), F.count(F.lit(1)).alias("n"))


@query()
def windowed_sinc_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = _grid(spark, sf_dir)
    got = mesh.windowed_sinc(f, v)
    return got.select("vid", *(rnd(c, 5).alias(c) for c in ("x", "y", "z")))
