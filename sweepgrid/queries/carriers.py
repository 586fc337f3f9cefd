"""Driver tables reshaped as the inputs of this engine, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recon import Fan

ROWS, COLS = 16, 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (k, r, p, v): 16 vectors of 64 values make a frame; the last frame is filled up with zeros."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    zeros = F.array_repeat(F.lit(0.0), 64)
    last = e.agg(F.max("vec_id").alias("m")).select(F.explode(F.sequence(F.col("m") + 1, F.expr("m div 16 * 16 + 16"))).alias("vec_id"), zeros.alias("embedding"))
    kept = e.unionByName(last.where("vec_id % 16 > 0"))
    return kept.select(F.expr("cast(vec_id div 16 as int)").alias("k"), F.expr("cast(vec_id % 16 as int)").alias("r"), F.posexplode("embedding").alias("p", "v")).withColumn("v", F.col("v").cast("double"))


def frames(polar_: DataFrame) -> int:
    return polar_.agg(F.max("k")).first()[0] + 1


POLAR = """pol AS (
  SELECT CAST(vec_id // 16 AS INT) AS k, CAST(vec_id % 16 AS INT) AS r, CAST(p - 1 AS INT) AS p, CAST(x AS DOUBLE) AS v
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)
  UNION ALL SELECT CAST(m // 16 AS INT), CAST(o AS INT), CAST(p AS INT), 0 FROM (SELECT max(vec_id) AS m FROM embeddings), range(16) t(o), range(64) q(p) WHERE o > m % 16
)"""

FAN = Fan(depth_mm=20.0, phi0=0.0, phi1=math.radians(52.0), rows=ROWS, cols=COLS)
VOXEL = 2.0


def cells_sql(depth: float, voxel: float, phi1_deg: float = 52.0) -> str:
    """CTEs ax, cells(ix, iy, iz, r_mm, phi, psi): the cells of a fan [0, phi1]."""
    n = math.ceil(2 * depth / voxel)
    return f"""ax AS (SELECT CAST(i AS INT) AS i, CAST(CAST(CAST(-{depth} AS DOUBLE) + CAST({2 * depth} AS DOUBLE) * i / CAST({n - 1} AS DOUBLE) AS FLOAT) AS DOUBLE) AS x FROM range({n}) t(i)),
g AS (SELECT a.i AS ix, b.i AS iy, c.i AS iz, a.x AS x, b.x AS y, c.x AS z, sqrt(b.x ** 2 + c.x ** 2) AS rho FROM ax a, ax b, ax c),
cells AS (
  SELECT ix, iy, iz, sqrt(x ** 2 + rho ** 2) AS r_mm, atan2(rho, x) AS phi,
    CASE WHEN atan2(z, y) < 0 THEN atan2(z, y) + 2 * pi() ELSE atan2(z, y) END AS psi
  FROM g WHERE sqrt(x ** 2 + rho ** 2) <= {depth} AND atan2(rho, x) >= 0 AND atan2(rho, x) <= radians(CAST({phi1_deg} AS DOUBLE))
)"""


def sample_sql(depth: float, rows: int, cols: int, n: str, phi1_deg: float = 52.0) -> str:
    """CTEs kn, pos, smp on top of pol (k 0..n-1) and cells: order-1 samples with one frame of padding, knots evenly over 2 pi."""
    return f"""nf AS (SELECT {n} AS n),
padded AS (
  SELECT k + 1 AS k, r, p, v FROM pol UNION ALL SELECT k - n + 1, r, p, v FROM pol, nf WHERE k >= n - 1 UNION ALL SELECT k + n + 1, r, p, v FROM pol, nf WHERE k < 1
),
kn AS (
  SELECT i, CASE WHEN i = 0 THEN last - (last - 0.0) WHEN i = n + 1 THEN 0.0 + (last - 0.0) ELSE 2 * pi() * (i - 1) / n END AS t, (last - 0.0) AS span, n
  FROM (SELECT unnest(range(0, n + 2)) AS i, n, 2 * pi() * (n - 1) / n AS last FROM nf)
),
kp AS (SELECT list(t ORDER BY i) AS ts, any_value(span) AS span, any_value(n) AS n FROM kn),
th AS (SELECT c.*, least(greatest(psi / (2 * pi()) * span, ts[1]), ts[n + 2]) AS theta, ts, n FROM cells c, kp),
att AS (SELECT *, len(list_filter(ts, lambda x: x <= theta)) AS j FROM th),
pos AS (
  SELECT ix, iy, iz, least(greatest(r_mm / ({depth} / CAST({rows} AS DOUBLE)), 0), {rows} - 1 - 1e-3) AS ri,
    least(greatest(phi / (radians(CAST({phi1_deg} AS DOUBLE)) / {cols - 1}), 0), {cols} - 1 - 1e-3) AS pi_,
    least(greatest(CASE WHEN j = 0 THEN 0 WHEN j >= n + 2 THEN n + 1 ELSE (j - 1) + (theta - ts[j]) / CASE WHEN ts[j + 1] > ts[j] THEN ts[j + 1] - ts[j] ELSE 1 END END, 0), n + 1 - 1e-6) AS ki
  FROM att
),
cor AS (
  SELECT ix, iy, iz, CAST(floor(ri) AS INT) + a AS r, CAST(floor(pi_) AS INT) + b AS p, CAST(floor(ki) AS INT) + c AS k,
    (CASE a WHEN 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE b WHEN 1 THEN pi_ - floor(pi_) ELSE 1 - (pi_ - floor(pi_)) END) * (CASE c WHEN 1 THEN ki - floor(ki) ELSE 1 - (ki - floor(ki)) END) AS w
  FROM pos, range(2) t1(a), range(2) t2(b), range(2) t3(c)
),
vox AS (SELECT ix, iy, iz, sum(w * coalesce(v, 0)) AS v FROM cor LEFT JOIN padded USING (r, p, k) GROUP BY ix, iy, iz)"""


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points (seg, vid, x, y, z)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("seg"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("vid"),
        F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100.0).alias("y"), (F.col("l_extendedprice") / 1000.0).alias("z"),
    )


CLOUD = """pts AS (
  SELECT l_returnflag AS seg, l_orderkey * 8 + l_linenumber AS vid, CAST(l_quantity AS DOUBLE) AS x, l_discount * CAST(100.0 AS DOUBLE) AS y, l_extendedprice / CAST(1000.0 AS DOUBLE) AS z FROM lineitem
)"""
