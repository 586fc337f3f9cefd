"""Frames around the sweep, over embeddings and events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import increasing
from ..operators import recon, registration, seam
from . import query
from .carriers import COLS, FAN, POLAR, ROWS, VOXEL, cells_sql, frames, polar, read, rnd, sample_sql

CORR = "(sum(a * b) - sum(a) * sum(b) / count(*)) / (sqrt(greatest(sum(a * a) - sum(a) * sum(a) / count(*), 0) * greatest(sum(b * b) - sum(b) * sum(b) / count(*), 0)) + 1e-12)"
ADJACENT = f"adj AS (SELECT y.k AS k, {CORR.replace('a * b', 'x.v * y.v').replace('sum(a)', 'sum(x.v)').replace('sum(b)', 'sum(y.v)').replace('a * a', 'x.v * x.v').replace('b * b', 'y.v * y.v')} AS corr FROM pol x JOIN pol y ON x.r = y.r AND x.p = y.p AND y.k = x.k + 1 GROUP BY y.k)"


@query(f"""WITH {POLAR}, {cells_sql(20.0, 2.0)}, {sample_sql(20.0, ROWS, COLS, '(SELECT max(k) + 1 FROM pol)')},
top AS (SELECT ix, iy, max(v) AS v FROM vox GROUP BY ix, iy)
SELECT a.i AS ix, b.i AS iy, round(greatest(coalesce(v, 0), 0), 6) + 0.0 AS mip FROM ax a CROSS JOIN ax b LEFT JOIN top ON top.ix = a.i AND top.iy = b.i""")
def recon_trilinear_mip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    n = recon.axis_count(FAN.depth_mm, VOXEL)
    voxels = recon.resample(spark, stack, FAN, frames(stack), VOXEL)
    return recon.mip(voxels, ("ix", "iy"), (n, n)).select("ix", "iy", rnd("v").alias("mip"))


def _phantom(kind: str, value: str):
    sql = f"""WITH {POLAR.replace('pol AS', 'carrier AS')}, pol AS (SELECT k, r, p, {value} AS v FROM carrier, (SELECT max(k) + 1 AS n FROM carrier)),
{cells_sql(16.0, 2.0)}, {sample_sql(16.0, ROWS, COLS, '(SELECT max(k) + 1 FROM pol)')} SELECT ix, iy, iz, round(v, 6) + 0.0 AS v FROM vox"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A stack with known answers, of as many frames as the carrier has."""
        fan, n = recon.Fan(16.0, 0.0, math.radians(52.0), ROWS, COLS), frames(polar(spark, sf_dir))
        return recon.resample(spark, recon.phantom_stack(spark, kind, ROWS, COLS, n), fan, n, 2.0).select("ix", "iy", "iz", rnd("v").alias("v"))

    run.__name__ = f"phantom_{kind}_recon"
    query(sql)(run)


_phantom("radial", "CAST(r AS DOUBLE)")
_phantom("phi", "CAST(p AS DOUBLE)")
_phantom("theta", "0.5 * (cos(2 * pi() * k / n) + 1)")


@query(f"WITH {POLAR}, {ADJACENT} SELECT k, round(corr, 6) + 0.0 AS corr FROM adj")
def frame_adjacent_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.adjacent_corr(polar(spark, sf_dir)).select("k", rnd("corr").alias("corr"))


@query(f"""WITH {POLAR}, {ADJACENT},
w AS (SELECT a.k AS k FROM adj a JOIN adj b ON b.k = a.k + 1 WHERE least(a.corr, b.corr) < 0.9 ORDER BY least(a.corr, b.corr), a.k LIMIT 1)
SELECT c.k, c.r, c.p, round(CASE WHEN c.k IN (SELECT k FROM w) THEN (x.v + y.v) * 0.5 ELSE c.v END, 6) + 0.0 AS v
FROM pol c LEFT JOIN pol x ON x.k = c.k - 1 AND x.r = c.r AND x.p = c.p LEFT JOIN pol y ON y.k = c.k + 1 AND y.r = c.r AND y.p = c.p""")
def theta_outlier_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.repair_outlier(polar(spark, sf_dir)).select("k", "r", "p", rnd("v").alias("v"))


#: A closing frame that nearly repeats the first.
CLOSED = "closed AS (SELECT * FROM pol UNION ALL SELECT CAST((SELECT max(k) + 1 FROM pol) AS INT), r, p, v + 0.001 * (p % 3) FROM pol WHERE k = 0)"


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    last = stack.where("k = 0").join(F.broadcast(stack.agg((F.max("k") + 1).alias("n")))).select(F.col("n").cast("int").alias("k"), "r", "p", (F.col("v") + 0.001 * (F.col("p") % 3)).alias("v"))
    return stack.unionByName(last)


@query(f"""WITH {POLAR}, {CLOSED}, e AS (SELECT max(k) AS n FROM closed),
c AS (SELECT {CORR.replace('a * b', 'x.v * y.v').replace('sum(a)', 'sum(x.v)').replace('sum(b)', 'sum(y.v)').replace('a * a', 'x.v * x.v').replace('b * b', 'y.v * y.v')} AS corr FROM closed x JOIN closed y USING (r, p) WHERE x.k = 0 AND y.k = (SELECT n FROM e))
SELECT z.k, z.r, z.p, round(CASE WHEN z.k = 0 AND (SELECT corr FROM c) > 0.99 THEN (z.v + l.v) * 0.5 ELSE z.v END, 6) + 0.0 AS v
FROM closed z JOIN closed l ON l.r = z.r AND l.p = z.p AND l.k = (SELECT n FROM e) WHERE NOT ((SELECT corr FROM c) > 0.99 AND z.k = (SELECT n FROM e))""")
def duplicate_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.close_duplicate(_closed(spark, sf_dir)).select("k", "r", "p", rnd("v").alias("v"))


@query(f"""WITH {POLAR}, {CLOSED}, e AS (SELECT max(k) AS n FROM closed)
SELECT z.k, z.r, z.p, round(CASE WHEN z.k = 0 THEN (z.v + l.v) * 0.5 ELSE z.v END, 6) + 0.0 AS v
FROM closed z JOIN closed l ON l.r = z.r AND l.p = z.p AND l.k = (SELECT n FROM e) WHERE z.k < (SELECT n FROM e)""")
def v2_duplicate_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.close_duplicate(_closed(spark, sf_dir), always=True).select("k", "r", "p", rnd("v").alias("v"))


@query(f"""WITH base AS (WITH {POLAR} SELECT * FROM pol WHERE p % 4 = 0 AND r >= 2 AND r < 14), pol AS (SELECT * FROM base), {ADJACENT},
n AS (SELECT max(k) + 1 AS n FROM pol)
SELECT CAST(k AS INT) AS cut, round(corr, 6) + 0.0 AS score FROM adj, n WHERE k >= 2 AND k <= n - 2 ORDER BY corr DESC, k LIMIT 1""")
def best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.best_cut(polar(spark, sf_dir), 2, 14).select("cut", rnd("score").alias("score"))


@query(f"WITH {POLAR} SELECT CAST((k - 7 + (SELECT max(k) + 1 FROM pol)) % (SELECT max(k) + 1 FROM pol) AS INT) AS k, r, p, round(v, 6) + 0.0 AS v FROM pol")
def circular_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    return seam.roll_frames(stack, 7, frames(stack)).select("k", "r", "p", rnd("v").alias("v"))


@query(f"""WITH {POLAR}, n AS (SELECT max(k) + 1 AS n FROM pol)
SELECT c.k, c.r, c.p, round(CASE WHEN o.v IS NULL THEN c.v ELSE (1 - (0.5 - 0.5 * cos(pi() * c.s / 5))) * c.v + (0.5 - 0.5 * cos(pi() * c.s / 5)) * o.v END, 6) + 0.0 AS v
FROM (SELECT *, CASE WHEN k < 5 THEN k WHEN k >= n - 5 THEN k - n + 5 END AS s, CASE WHEN k < 5 THEN n - 5 + k WHEN k >= n - 5 THEN k - n + 5 END AS mate FROM pol, n) c
LEFT JOIN pol o ON o.k = c.mate AND o.r = c.r AND o.p = c.p""")
def closure_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.blend_closure(polar(spark, sf_dir)).select("k", "r", "p", rnd("v").alias("v"))


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drifts by frame: means of two columns of the stack."""
    stack = polar(spark, sf_dir)
    return stack.groupBy("k").agg((F.sum(F.when(F.col("p") == 3, F.col("v"))) * 2.0).alias("dr"), (F.sum(F.when(F.col("p") == 5, F.col("v"))) * 3.0).alias("dphi"))


SWEEP = "sweep AS (SELECT k, sum(CASE WHEN p = 3 THEN v END) * 2.0 AS dr, sum(CASE WHEN p = 5 THEN v END) * 3.0 AS dphi FROM pol GROUP BY k)"


@query(f"""WITH {POLAR}, {SWEEP},
e AS (SELECT count(*) AS n, max(CASE WHEN k = 0 THEN dr END) AS r0, max(CASE WHEN k = 0 THEN dphi END) AS p0, arg_max(dr, k) AS r1, arg_max(dphi, k) AS p1 FROM sweep)
SELECT k, round(dr - (r0 + (r1 - r0) * k / (n - 1)), 5) + 0.0 AS dr_corr, round(dphi - (p0 + (p1 - p0) * k / (n - 1)), 5) + 0.0 AS dphi_corr,
  round(-(r0 + (r1 - r0) * k / (n - 1)), 5) + 0.0 AS dr_extra, round(-(p0 + (p1 - p0) * k / (n - 1)), 5) + 0.0 AS dphi_extra FROM sweep, e""")
def closure_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.detrend_closure(_sweep(spark, sf_dir)).select("k", *(rnd(c, 5).alias(c) for c in ("dr_corr", "dphi_corr", "dr_extra", "dphi_extra")))


@query(f"""WITH RECURSIVE {POLAR}, {SWEEP}, n AS (SELECT count(*) AS n FROM sweep),
b AS (SELECT k, 2 * pi() * k / n - round_even(dphi, 0) * 0.0036 AS t FROM sweep, n),
m AS (SELECT k, t - (SELECT min(t) FROM b) AS t FROM b), s AS (SELECT k, t * 2 * pi() / greatest((SELECT max(t) FROM m), 1e-6) AS t FROM m),
f AS (SELECT k, t FROM s WHERE k = 0 UNION ALL SELECT s.k, CASE WHEN s.t <= f.t THEN f.t + 1e-6 ELSE s.t END FROM f JOIN s ON s.k = f.k + 1)
SELECT k, round(t, 6) + 0.0 AS theta FROM f""")
def theta_knots_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.rebuild_knots(_sweep(spark, sf_dir).select("k", "dphi"), 0.0036, 2 * math.pi).select("k", rnd("theta").alias("theta"))


def _increasing(e: DataFrame) -> DataFrame:
    got = increasing(e.select("user_id", "ts", "event_id", "value"), "value", ["user_id"], ["ts", "event_id"], "v", "i")
    return got.select("user_id", F.col("i").cast("int").alias("i"), rnd("v").alias("v"))


@query("""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, CAST(i AS INT) AS i, round(max(CAST(value AS DOUBLE) - i * 1e-6) OVER (PARTITION BY user_id ORDER BY i) + i * 1e-6, 6) + 0.0 AS v FROM e""")
def strictly_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold over the values of all users, each in time order; in SQL as a running maximum, which it is as values are multiples of the step."""
    return _increasing(read(spark, sf_dir, "events"))


@query("""WITH e AS (SELECT event_id, user_id, ts, (value - floor(value / (2 * pi())) * 2 * pi()) - pi() AS a FROM events),
d AS (SELECT *, a - lag(a) OVER w AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT *, (d + pi()) - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() AS m FROM d)
SELECT event_id, round(a + sum(CASE WHEN d IS NULL OR abs(d) < pi() THEN 0 ELSE (CASE WHEN m = -pi() AND d > 0 THEN pi() ELSE m END) - d END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS phase FROM x""")
def phase_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.pmod(F.col("value"), F.lit(2.0) * F.pi()) - F.pi()).alias("a"))
    return seam.unwrap_phase(e, "a", ["ts", "event_id"], ["user_id"], "phase").select("event_id", rnd("phase", 5).alias("phase"))


@query("""WITH kn AS (SELECT list(t ORDER BY i) AS ts FROM (SELECT i, i * 0.5 + 0.1 * sin(CAST(i AS DOUBLE)) AS t FROM range(60) x(i))),
e AS (SELECT event_id, value - floor(value / 30.0) * 30.0 AS t, ts FROM (SELECT event_id, value FROM events), kn),
a AS (SELECT *, len(list_filter(ts, lambda x: x <= t)) AS j FROM e)
SELECT event_id, round(CASE WHEN j = 0 THEN 0 WHEN j >= 60 THEN 59 ELSE (j - 1) + (t - ts[j]) / (ts[j + 1] - ts[j]) END, 5) + 0.0 AS idx FROM a""")
def theta_interp_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = F.array(*[F.lit(i * 0.5 + 0.1 * math.sin(i)) for i in range(60)])
    e = read(spark, sf_dir, "events").select("event_id", F.pmod(F.col("value"), F.lit(30.0)).alias("t"))
    return e.select("event_id", rnd(recon.interp_knots(F.col("t"), knots), 5).alias("idx"))


@query(f"""WITH {POLAR}, n AS (SELECT max(k) + 1 AS n FROM pol),
w AS (SELECT o, exp(-0.5 * (o / 1.5) ** 2) AS g FROM (SELECT unnest(range(-6, 7)) AS o)), q AS (SELECT o, g / (SELECT sum(g) FROM w) AS g FROM w)
SELECT CAST((k + o + n) % n AS INT) AS k, r, p, round(sum(v * g), 6) + 0.0 AS v FROM pol, q, n GROUP BY 1, r, p""")
def gaussian_theta_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    return recon.gaussian_theta(stack, frames(stack), 1.5).select("k", "r", "p", rnd("v").alias("v"))


@query(f"""WITH {POLAR}, prof AS (SELECT k, p, sum(v) AS s FROM pol GROUP BY k, p), c AS (SELECT k, p, s - avg(s) OVER (PARTITION BY k) AS s FROM prof),
x AS (SELECT m.k AS k, a.p - m.p AS lag, sum(a.s * m.s) AS cc FROM c a JOIN c m ON a.k = 0 GROUP BY 1, 2)
SELECT k, CAST(arg_max(lag, (cc, -lag)) AS INT) AS shift FROM x GROUP BY k""")
def xcorr_shift_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registration.xcorr_shift(polar(spark, sf_dir), 0)


@query()
def phase_corr_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    return registration.estimate_shifts(stack, ROWS, COLS, frames(stack) // 2).select("k", rnd("dr", 4).alias("dr"), rnd("dphi", 4).alias("dphi"))


@query()
def registered_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    return registration.register(stack, ROWS, COLS, frames(stack) // 2).select("k", "r", "p", rnd("v", 4).alias("v"))


@query(f"""WITH {POLAR}, s AS (SELECT k, 0.35 * k AS sh FROM (SELECT DISTINCT k FROM pol)),
g AS (SELECT k, r, p, (p - sh) - floor((p - sh) / 64.0) * 64.0 AS x FROM pol JOIN s USING (k))
SELECT g.k, g.r, g.p, round((1 - (x - floor(x))) * a.v + (x - floor(x)) * b.v, 6) + 0.0 AS v
FROM g JOIN pol a ON a.k = g.k AND a.r = g.r AND a.p = CAST(floor(x) AS INT) % 64 JOIN pol b ON b.k = g.k AND b.r = g.r AND b.p = (CAST(floor(x) AS INT) + 1) % 64""")
def fractional_shift_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir).withColumn("sh", F.lit(0.35) * F.col("k"))
    return registration.shift_columns(stack, F.col("sh"), COLS).select("k", "r", "p", rnd("v").alias("v"))


@query(f"""WITH {POLAR}, g AS (SELECT k, r, p, least(greatest(r - 0.3 * (k % 5), 0), 15) AS x FROM pol)
SELECT g.k, g.r, g.p, round((1 - (x - floor(x))) * a.v + (x - floor(x)) * b.v, 6) + 0.0 AS v
FROM g JOIN pol a ON a.k = g.k AND a.p = g.p AND a.r = CAST(floor(x) AS INT) JOIN pol b ON b.k = g.k AND b.p = g.p AND b.r = least(CAST(floor(x) AS INT) + 1, 15)""")
def fractional_shift_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = polar(spark, sf_dir)
    return registration.shift_rows(stack, F.lit(0.3) * (F.col("k") % 5), ROWS).select("k", "r", "p", rnd("v").alias("v"))


@query("""WITH d AS (SELECT p_partkey AS i, CAST(0.02 AS DOUBLE) * p_size AS dr, 200 + p_partkey % 300 AS n FROM part),
a AS (SELECT *, least(greatest(round_even(CAST(15 AS DOUBLE) / dr, 0), 0), n - 1) AS r0 FROM d)
SELECT i, CAST(r0 AS INT) AS r0, CAST(least(greatest(round_even(CAST(35 AS DOUBLE) / dr, 0), r0 + 1), n) AS INT) AS r1 FROM a""")
def depth_roi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth rows for each part's row spacing and count."""
    r0, r1 = seam.depth_roi(F.lit(0.02) * F.col("p_size"), (200 + F.col("p_partkey") % 300).cast("double"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), r0.alias("r0"), r1.alias("r1"))


@query(f"""WITH {POLAR}, f AS (SELECT max(k) + 1 AS n FROM pol)
SELECT 'all' AS subset, CAST(count(DISTINCT k) AS BIGINT) AS frames, round(avg(v), 6) + 0.0 AS mean_v FROM pol
UNION ALL SELECT CASE k % 2 WHEN 0 THEN 'even' ELSE 'odd' END, CAST(count(DISTINCT k) AS BIGINT), round(avg(v), 6) + 0.0 FROM pol GROUP BY k % 2""")
def even_odd_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = polar(spark, sf_dir).withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col("k") % 2 == 0, "even").otherwise("odd"))))
    return rows.groupBy("subset").agg(F.countDistinct("k").alias("frames"), rnd(F.avg("v")).alias("mean_v"))


