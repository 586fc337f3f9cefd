"""Volumes: statistics over the reconstruction, quantization and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, graph, recon, volume
from . import query
from .carriers import COLS, FAN, POLAR, ROWS, VOXEL, cells_sql, frames, polar, read, rnd, sample_sql

VOX = f"{POLAR}, {cells_sql(20.0, 2.0)}, {sample_sql(20.0, ROWS, COLS, '(SELECT max(k) + 1 FROM pol)')}"
N = recon.axis_count(FAN.depth_mm, VOXEL)


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    return recon.resample(spark, stack, FAN, frames(stack), VOXEL)


@query(f"WITH {VOX}, a AS (SELECT v FROM vox UNION ALL SELECT 0 FROM range({N**3} - (SELECT count(*) FROM vox))) SELECT round(quantile_cont(v, 0.6), 6) + 0.0 AS p_60, round(quantile_cont(v, 0.997), 6) + 0.0 AS p_99_7 FROM a")
def volume_percentiles_dense_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.dense_percentiles(_voxels(spark, sf_dir), N**3, (60, 99.7)).select(rnd("p_60").alias("p_60"), rnd("p_99_7").alias("p_99_7"))


@query(f"""WITH {VOX} SELECT 'xy' AS plane, ix AS a, iy AS b, round(greatest(max(v), 0), 6) + 0.0 AS v FROM vox GROUP BY ix, iy
UNION ALL SELECT 'xz', ix, iz, round(greatest(max(v), 0), 6) + 0.0 FROM vox GROUP BY ix, iz UNION ALL SELECT 'yz', iy, iz, round(greatest(max(v), 0), 6) + 0.0 FROM vox GROUP BY iy, iz""")
def volume_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three projections in one pass: a row per voxel and plane, maxima merged before the shuffle."""
    planes = F.array(*[F.struct(F.lit(n).alias("plane"), F.col(a).alias("a"), F.col(b).alias("b")) for n, a, b in (("xy", "ix", "iy"), ("xz", "ix", "iz"), ("yz", "iy", "iz"))])
    rows = _voxels(spark, sf_dir).select(F.explode(planes).alias("c"), "v")
    return rows.groupBy("c.plane", "c.a", "c.b").agg(rnd(F.greatest(F.max("v"), F.lit(0.0))).alias("v"))


@query(f"WITH {VOX}, s AS (SELECT ix, sum(v) AS t FROM vox GROUP BY ix) SELECT ix, round(t, 5) + 0.0 AS total FROM s ORDER BY t DESC, ix LIMIT 1")
def x_signal_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.x_signal_argmax(_voxels(spark, sf_dir)).select("ix", rnd("total", 5).alias("total"))


@query()
def axis_ratio_even_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis ratio of volumes from all, even and odd frames."""
    from ..plans import qc

    stack = polar(spark, sf_dir)
    return qc.even_odd_ratios(stack, FAN, frames(stack), VOXEL, 50).select("subset", rnd("ratio", 4).alias("ratio"), rnd("drift", 4).alias("drift"), "alarm")


@query("""WITH s AS (SELECT o_orderpriority AS seg, quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.997) AS hi FROM orders WHERE o_totalprice > 0 GROUP BY 1)
SELECT o_orderkey, CAST(round_even(least(greatest((o_totalprice - lo) / greatest(hi - lo, 1e-9), 0), 1) * 255, 0) AS INT) AS q FROM orders JOIN s ON seg = o_orderpriority""")
def robust_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.robust_rescale(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_totalprice", by=["o_orderpriority"]).select("o_orderkey", "q")


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(trunc(least(greatest((l_extendedprice - lo) / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END), 0), 1) * 255) AS INT) AS q FROM lineitem, s""")
def minmax_quantize_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.min_max_quantize(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 8).select("l_orderkey", "l_linenumber", "q")


@query("""SELECT l_orderkey, l_linenumber, CAST(trunc(least(greatest((l_quantity - lo) / (CASE WHEN hi <= lo THEN 1 ELSE hi - lo END), 0), 1) * 65535) AS INT) AS q
FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_shipdate) AS lo, max(l_quantity) OVER (PARTITION BY l_shipdate) AS hi FROM lineitem)""")
def slice_quantize_u16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return volume.min_max_quantize(rows, "l_quantity", 16, by=["l_shipdate"]).select("l_orderkey", "l_linenumber", "q")


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(least(greatest(l_discount * 12, 0), 1) * 255) AS INT) AS q FROM lineitem")
def clip_quantize_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 12).alias("v"))
    return volume.min_max_quantize(rows, "v", 8, auto_window=False).select("l_orderkey", "l_linenumber", "q")


#: The polar stack read as a block of cells (frame, row, column) with whole values from 0 to 63; mx is the last frame.
BLOCK = f"{POLAR}, blk AS (SELECT k AS ix, r AS iy, p AS iz, CAST(CAST(floor(abs(v) * 400) AS BIGINT) % 64 AS DOUBLE) AS v, max(k) OVER () AS mx FROM pol)"
NEAR = f"near AS (SELECT c.ix, c.iy, c.iz, least(greatest(c.ix + dx, 0), mx) AS jx, least(greatest(c.iy + dy, 0), {ROWS - 1}) AS jy, least(greatest(c.iz + dz, 0), {COLS - 1}) AS jz FROM blk c, o)"
OFFSETS = "o AS (SELECT CAST(x - 1 AS INT) AS dx, CAST(y - 1 AS INT) AS dy, CAST(z - 1 AS INT) AS dz FROM range(3) t1(x), range(3) t2(y), range(3) t3(z))"


def _block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polar(spark, sf_dir).select(F.col("k").alias("ix"), F.col("r").alias("iy"), F.col("p").alias("iz"), (F.floor(F.abs("v") * 400) % 64).cast("double").alias("v"))


def _shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    return frames(polar(spark, sf_dir)), ROWS, COLS


@query(f"""WITH {BLOCK}, g AS (
  SELECT c.ix, c.iy, c.iz, c.v, sqrt(((x1.v - x0.v) / 2) ** 2 + ((y1.v - y0.v) / 2) ** 2 + ((z1.v - z0.v) / 2) ** 2) AS g FROM blk c
  JOIN blk x0 ON x0.ix = greatest(c.ix - 1, 0) AND x0.iy = c.iy AND x0.iz = c.iz JOIN blk x1 ON x1.ix = least(c.ix + 1, c.mx) AND x1.iy = c.iy AND x1.iz = c.iz
  JOIN blk y0 ON y0.iy = greatest(c.iy - 1, 0) AND y0.ix = c.ix AND y0.iz = c.iz JOIN blk y1 ON y1.iy = least(c.iy + 1, {ROWS - 1}) AND y1.ix = c.ix AND y1.iz = c.iz
  JOIN blk z0 ON z0.iz = greatest(c.iz - 1, 0) AND z0.iy = c.iy AND z0.ix = c.ix JOIN blk z1 ON z1.iz = least(c.iz + 1, {COLS - 1}) AND z1.iy = c.iy AND z1.ix = c.ix)
SELECT round(avg(v) FILTER (v > 0), 6) AS mean, round(stddev_pop(v) FILTER (v > 0), 6) AS std, round(avg(v) FILTER (v > 0) / stddev_pop(v) FILTER (v > 0), 6) AS snr, round(avg(g), 6) AS gradient, round(100.0 * count(*) FILTER (v > 0) / count(*), 6) AS coverage FROM g""")
def volume_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = volume.quality(_block(spark, sf_dir), _shape(spark, sf_dir))
    return got.select(*(rnd(c).alias(c) for c in got.columns))


@query(f"WITH {BLOCK}, {OFFSETS}, {NEAR} SELECT c.ix, c.iy, c.iz, median(n.v) AS v FROM near c JOIN blk n ON n.ix = jx AND n.iy = jy AND n.iz = jz GROUP BY 1, 2, 3")
def median_filter_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.median_filter(_block(spark, sf_dir), _shape(spark, sf_dir))


@query(f"""WITH {BLOCK}, {OFFSETS}, {NEAR}, d AS (SELECT c.ix, c.iy, c.iz, max(CASE WHEN n.v > 58 THEN 1 ELSE 0 END) AS m FROM near c JOIN blk n ON n.ix = jx AND n.iy = jy AND n.iz = jz GROUP BY 1, 2, 3)
SELECT c.ix, c.iy, c.iz FROM near c JOIN d n ON n.ix = jx AND n.iy = jy AND n.iz = jz GROUP BY 1, 2, 3 HAVING min(n.m) > 0""")
def binary_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.binary_closing(_block(spark, sf_dir).where("v > 58"), _shape(spark, sf_dir))


@query(f"""WITH {BLOCK}, b AS (SELECT -0.5 * ix - 1.0 AS x, -0.25 * iy + 2.0 AS y, 2.0 * iz - 3.0 AS z FROM blk WHERE v > 40)
, m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM b)
SELECT round(CAST(x0 + 3.0 + (x1 - x0 + 7.0) / 2 AS DOUBLE), 6) AS cx, round(CAST((y0 + y1) / 2 AS DOUBLE), 6) + 0.0 AS cy, round(CAST((z0 + z1) / 2 AS DOUBLE), 6) + 0.0 AS cz, round(CAST(x1 - x0 + 7.0 AS DOUBLE), 6) AS lx, round(CAST(y1 - y0 + 4.0 AS DOUBLE), 6) AS ly, round(CAST(z1 - z0 + 4.0 AS DOUBLE), 6) AS lz FROM m""")
def nonzero_bounds_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalars import ijk_to_ras

    matrix = ijk_to_ras((0.5, 0.25, 2.0), (1.0, -2.0, -3.0))
    got = volume.roi_box(volume.ras_bounds(_block(spark, sf_dir), matrix, 40.0))
    return got.select(*(rnd(c).alias(c) for c in got.columns))


@query(f"WITH {BLOCK} SELECT ix - 1 AS ix, iy - 2 AS iy, iz - 3 AS iz, v FROM blk WHERE ix BETWEEN 1 AND 5 AND iy BETWEEN 2 AND 7 AND iz BETWEEN 3 AND 8")
def crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.crop(_block(spark, sf_dir), (1, 2, 3), (5, 7, 8)).select("ix", "iy", "iz", "v")


@query(f"WITH {BLOCK} SELECT ix, iy, iz, v FROM blk WHERE iy IN (0, 3, 8)")
def slice_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.slices(_block(spark, sf_dir), 1, (0, 3, 8), _shape(spark, sf_dir)).select("ix", "iy", "iz", "v")


@query(f"""WITH {BLOCK}, s AS (SELECT CAST(a AS INT) AS ix, CAST(b AS INT) AS iy, CAST(c AS INT) AS iz, a * 0.7 AS x, b * 1.3 AS y, c * 0.9 AS z FROM (SELECT unnest(range(CAST(round((max(ix) + 1) / 0.7) AS BIGINT))) AS a FROM blk) t1, range({round(ROWS / 1.3)}) t2(b), range({round(COLS / 0.9)}) t3(c)),
c AS (SELECT s.*, CAST(floor(x) AS INT) + i AS jx, CAST(floor(y) AS INT) + j AS jy, CAST(floor(z) AS INT) + k AS jz,
  (CASE i WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE j WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE k WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w
  FROM s, range(2) t4(i), range(2) t5(j), range(2) t6(k) WHERE x <= (SELECT max(ix) FROM blk) AND y <= {ROWS - 1} AND z <= {COLS - 1})
SELECT c.ix, c.iy, c.iz, round(CAST(sum(w * blk.v) AS DOUBLE), 6) + 0.0 AS v FROM c JOIN blk ON blk.ix = jx AND blk.iy = jy AND blk.iz = jz GROUP BY 1, 2, 3""")
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.linear_resample(_block(spark, sf_dir), _shape(spark, sf_dir), (1.0, 1.0, 1.0), (0.7, 1.3, 0.9)).select("ix", "iy", "iz", rnd("v").alias("v"))


def _label_sql(cells: str, axes: str, near: str) -> str:
    same = " AND ".join(f"s.{a} = r.{a}" for a in axes.split(", "))
    return f"""WITH RECURSIVE {cells}, n AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON {near}),
r AS (SELECT id, id AS root FROM c UNION SELECT n.b, r.root FROM r JOIN n ON n.a = r.id),
l AS (SELECT id, min(root) AS label FROM r GROUP BY id), best AS (SELECT label FROM l GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT {axes} FROM c JOIN l USING (id) WHERE label = (SELECT label FROM best)"""


@query(_label_sql(f"{POLAR}, c AS (SELECT k * 16 + r AS y, p AS x, (k * 16 + r) * 64 + p AS id FROM pol WHERE v > 0.17)", "y, x", "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id"))
def largest_component_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright pixels of one tall image of all vectors."""
    stack = polar(spark, sf_dir)
    cells = stack.where("v > 0.17").select((F.col("k") * 16 + F.col("r")).cast("int").alias("y"), F.col("p").alias("x"))
    return graph.largest_component(cells, ["y", "x"], [frames(stack) * 16, 64], True)


@query()
def outer_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer borders of the bright sets of one tall image of all vectors, each with its cells and the area it encloses."""
    stack = polar(spark, sf_dir)
    cells = stack.where("v > 0.17").select(F.col("p").alias("x"), (F.col("k") * 16 + F.col("r")).alias("y"))
    each = geometry.outer_contours(cells, 64, frames(stack) * 16)
    return each.groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.max("area").alias("area"))


@query(_label_sql(f"{BLOCK}, c AS (SELECT ix, iy, iz, (ix * {ROWS} + iy) * {COLS} + iz AS id FROM blk WHERE v < 6)", "ix, iy, iz", "abs(a.ix - b.ix) + abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1"))
def largest_component_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.largest_component(_block(spark, sf_dir).where("v < 6"), ["ix", "iy", "iz"], list(_shape(spark, sf_dir)), False)


@query()
def curvature_diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.curvature_diffusion(_block(spark, sf_dir), _shape(spark, sf_dir), rounds=2).select("ix", "iy", "iz", rnd("v", 5).alias("v"))


@query(f"WITH {BLOCK} SELECT iz AS i, count(*) AS n FROM blk WHERE v > 30 AND iz % {COLS // 20} = 0 GROUP BY iz")
def sampled_slice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.sampled_slice_counts(_block(spark, sf_dir).where("v > 30"), "iz", COLS)


@query(f"WITH {BLOCK}, q AS (SELECT i AS cid, CAST(i * 2 AS INT) AS x, CAST(i AS INT) AS y, CAST(8 - i AS INT) AS z FROM range(5) t(i)) SELECT cid, count(blk.v) AS n FROM q LEFT JOIN blk ON v > 50 AND abs(ix - x) <= 2 AND abs(iy - y) <= 2 AND abs(iz - z) <= 2 GROUP BY cid")
def apex_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = spark.range(5).select(F.col("id").alias("cid"), (F.col("id") * 2).cast("int").alias("ix"), F.col("id").cast("int").alias("iy"), (8 - F.col("id")).cast("int").alias("iz"))
    return volume.window_counts(_block(spark, sf_dir).where("v > 50"), guess, 2)
