"""From the polar stack to a Cartesian volume.

Voxels are sparse: (ix, iy, iz, v) for cells inside the fan; every other cell is 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import PI2, clip, num
from . import tiles


@dataclass(frozen=True)
class Fan:
    """Geometry of a scan: depth in mm, fan bounds in radians, polar rows and columns."""

    depth_mm: float
    phi0: float
    phi1: float
    rows: int
    cols: int
    r_max_pix: float | None = None

    @property
    def dr_mm(self) -> float:
        return self.depth_mm / (self.r_max_pix or self.rows)

    @property
    def dphi(self) -> float:
        return (self.phi1 - self.phi0) / max(self.cols - 1, 1)


def pad_theta(polar: DataFrame, n: int | Column, pad: int = 1) -> DataFrame:
    """Frames -pad..n+pad-1 as 0..n+2*pad-1: copies of the last and first frames stand before and after."""
    n = n if isinstance(n, Column) else F.lit(n)
    inner = polar.withColumn("k", F.col("k") + pad)
    before = polar.where(F.col("k") >= n - pad).withColumn("k", (F.col("k") - n + pad).cast("int"))
    after = polar.where(F.col("k") < pad).withColumn("k", (F.col("k") + n + pad).cast("int"))
    return before.unionByName(inner).unionByName(after)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-radius, radius + 1)]
    return [(x, y / sum(w)) for x, y in zip(range(-radius, radius + 1), w, strict=True)]


#: Frames of a block that is smoothed at once, or four radii if these are more; angle columns that go with them; taps up to which they are added one by one.
BLOCK, TOGETHER, FEW = 1024, 16, 64


def _smoothed(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The part of the convolution of lines with weights that all weights reach; by transforms where these are many and values finite."""
    n = x.shape[1] - len(w) + 1
    if len(w) > FEW and np.isfinite(x).all():
        size = 1 << (x.shape[1] - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(w, size), size)[:, len(w) - 1 : len(w) - 1 + n]
    out = np.zeros((len(x), n))
    for i, share in enumerate(w):
        out += share * x[:, i : i + n]
    return out


def gaussian_theta(polar: DataFrame, n: int | Column, sigma: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Smoothed along the sweep, around the circle. Nulls and absent frames count nothing.

    Frames travel in blocks with the frames that these read on both sides, at most half as many again, however wide the smoothing is.
    """
    num_ = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    rows = polar.select(*by, F.col("k").cast("long").alias("k"), "r", "p", F.col("v").cast("double").alias("v"), num_(n, "long").alias("__n"), num_(sigma, "double").alias("__s"))
    reach = F.floor(4.0 * F.col("__s") + 0.5)
    rows = rows.withColumn("__reach", reach).withColumn("__block", F.greatest(F.lit(BLOCK), 4 * F.col("__reach")))
    turns = F.ceil(F.col("__reach") / F.col("__n"))
    seen = rows.withColumn("__at", F.explode(F.transform(F.sequence(-turns, turns), lambda m: F.pmod("k", F.col("__n")) + m * F.col("__n"))))
    first = F.greatest(F.floor((F.col("__at") - F.col("__reach")) / F.col("__block")), F.lit(0))
    last = F.least(F.floor((F.col("__at") + F.col("__reach")) / F.col("__block")), F.floor((F.col("__n") - 1) / F.col("__block")))
    sent = seen.withColumns({"__first": first, "__last": last}).where("__first <= __last").withColumn("__b", F.explode(F.sequence("__first", "__last")))
    groups = [*by, "r", "__b", "__c"]
    sent = sent.select(*by, "r", "__b", F.floor(F.col("p") / TOGETHER).alias("__c"), "p", "__at", "v", "__n", "__s", "__block")
    kinds = dict(polar.dtypes)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        around, s, size = (t.column(c)[0].as_py() for c in ("__n", "__s", "__block"))
        w = np.array([x for _, x in gaussian_weights(s)])
        reach, start = len(w) // 2, key[-2].as_py() * size
        n = min(size, around - start)
        columns, i = np.unique(t.column("p").to_numpy(), return_inverse=True)
        at, v, some = t.column("__at").to_numpy() - (start - reach), t.column("v").to_numpy(), t.column("v").is_valid().to_numpy()
        inside = (at >= 0) & (at < n + 2 * reach)
        shape = (len(columns), n + 2 * reach)

        def laid(values: np.ndarray, which: np.ndarray) -> np.ndarray:
            return np.bincount(i[which] * shape[1] + at[which], values[which], shape[0] * shape[1]).reshape(shape)

        def met(which: np.ndarray) -> np.ndarray:
            sums = np.cumsum(np.pad(laid(np.ones(len(at)), which), ((0, 0), (1, 0))), axis=1)
            return sums[:, 2 * reach + 1 :] > sums[:, :n]

        got, there, valued = _smoothed(laid(v, inside & some), w), met(inside), met(inside & some)
        c, k = np.nonzero(there)
        keys = [pa.array([x.as_py()] * len(k), x.type) for x in key[:-2]]
        return pa.Table.from_arrays([*keys[:-1], pa.array((k + start).astype(np.int32)), keys[-1], pa.array(columns[c]), pa.array(got[c, k], mask=~valued[c, k])], names=[*by, "k", "r", "p", "v"])

    return sent.groupBy(*groups).applyInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), f"k int, r {kinds['r']}, p {kinds['p']}, v double"]))


def axis_count(depth_mm: float, voxel_mm: float) -> int:
    return math.ceil(2 * depth_mm / voxel_mm)


def axis_value(i: Column, depth_mm: float | Column, n: int | Column) -> Column:
    """Points from -depth to depth, kept in single precision as the grid's axes are."""
    steps = F.greatest(num(n) - 1.0, F.lit(1.0))
    return (-num(depth_mm) + 2.0 * num(depth_mm) * i / steps).cast("float").cast("double")


def _rows_in_fan(columns: DataFrame, keep: Sequence[str], n: int | Column, depth: float | Column, phi0: float | Column, phi1: float | Column, along_x: bool | Column) -> DataFrame:
    """columns (keep, ix, iy) with all iz inside the fan; ranges are bounded first, then joined."""
    columns = columns.withColumns({"x": axis_value(F.col("ix"), depth, n), "y": axis_value(F.col("iy"), depth, n)})
    # A fan that opens along +x: half of the columns hold no cell.
    columns = columns.where(~(along_x if isinstance(along_x, Column) else F.lit(along_x)) | (F.col("x") >= -1e-6))
    columns = columns.where(F.col("x") ** 2 + F.col("y") ** 2 <= num(depth) * num(depth) * 1.0001)
    last = n - 1 if isinstance(n, Column) else F.lit(n - 1)
    rows = columns.withColumn("iz", F.explode(F.sequence(F.lit(0), last))).withColumn("z", axis_value(F.col("iz"), depth, n))
    rho = F.sqrt(F.col("y") ** 2 + F.col("z") ** 2)
    rows = rows.withColumn("rho", rho).withColumns({"r_mm": F.sqrt(F.col("x") ** 2 + F.col("rho") ** 2), "phi": F.atan2(F.col("rho"), F.col("x")), "psi": F.pmod(F.atan2(F.col("z"), F.col("y")), F.lit(PI2))})
    return rows.where((F.col("r_mm") <= num(depth)) & (F.col("phi") >= num(phi0)) & (F.col("phi") <= num(phi1))).select(*keep, "ix", "iy", "iz", "r_mm", "phi", "psi")


def valid_cells(spark: SparkSession, fan: Fan, voxel_mm: float, slab: int = 1) -> DataFrame:
    """(ix, iy, iz, r_mm, phi, psi) of the cells inside the fan; slab: depth planes that a task makes at most, fewer where there are cores for more tasks.

    Rows are made in place, by depth slab: nothing is shuffled and no cell outside is kept.
    """
    n = axis_count(fan.depth_mm, voxel_mm)
    cells = spark.range(0, n * n, 1, max(1, min(n, 512, max(-(-n // slab), spark.sparkContext.defaultParallelism)))).select((F.col("id") / n).cast("int").alias("ix"), (F.col("id") % n).cast("int").alias("iy"))
    return _rows_in_fan(cells, (), n, fan.depth_mm, fan.phi0, fan.phi1, fan.phi0 >= 0 and fan.phi1 <= math.pi / 2)


def scan_cells(scans: DataFrame, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The same for many scans (by, depth, phi0, phi1, voxel_mm and the columns to keep): planes are dealt out to tasks, cells made in place."""
    planes = scans.withColumn("side", F.ceil(2.0 * F.col("depth") / F.col("voxel_mm")).cast("int"))
    planes = planes.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    # Planes are small and what is made of them is not: a given number of tasks is not coalesced.
    spread = planes.repartition(int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "ix")
    columns = spread.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    return _rows_in_fan(columns, [*by, *keep], F.col("side"), F.col("depth"), F.col("phi0"), F.col("phi1"), (F.col("phi0") >= 0) & (F.col("phi1") <= math.pi / 2))


def interp_knots(theta: Column, knots: Column, size: int | None = None, most: int | None = None) -> Column:
    """Position of theta between sorted knots (an array), linear between and held at the ends.

    With the size known, or a bound of it (most), the interval is found by bisection, else by counting knots.
    """
    n = F.size(knots)
    if size is None and most is None:
        at = F.size(F.filter(knots, lambda x: x <= theta))  # knots at or before theta
    else:

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            before = (s["lo"] < s["hi"]) & (F.element_at(knots, F.least(mid + 1, n)) <= theta)
            return F.struct(F.when(before, mid + 1).otherwise(s["lo"]).alias("lo"), F.when((s["lo"] < s["hi"]) & ~before, mid).otherwise(s["hi"]).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), (n if size is None else F.lit(size)).alias("hi"))
        at = F.aggregate(F.sequence(F.lit(1), F.lit((size or most).bit_length() + 1)), start, halve, lambda s: s["lo"])
    lo = F.element_at(knots, F.greatest(at, F.lit(1)))
    hi = F.element_at(knots, F.least(at + 1, n))
    inside = (at - 1) + (theta - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.when(at == 0, 0.0).when(at >= n, (n - 1).cast("double")).otherwise(inside)


def among_knots(theta: Column, knots: Sequence[float]) -> Column:
    """`interp_knots` among knots that all rows share. They go to the tasks as data: one literal a knot would have the planner work longer than the tasks."""
    table = np.array(knots, float)

    @F.arrow_udf("double")
    def place(theta: pa.Array) -> pa.Array:
        x = theta.to_numpy(zero_copy_only=False)
        at = np.searchsorted(table, x, side="right")  # knots at or before theta
        lo, hi = table[np.maximum(at, 1) - 1], table[np.minimum(at, len(table) - 1)]
        inside = (at - 1) + (x - lo) / np.where(hi > lo, hi - lo, 1.0)
        return pa.array(np.where(at == 0, 0.0, np.where(at >= len(table), len(table) - 1.0, inside)))

    return place(theta)


def sample_positions(cells: DataFrame, fan: Fan, knots: list[float], pad: int = 1) -> DataFrame:
    """Adds r_idx, p_idx, k_idx: where each cell falls in the padded stack. knots: angles of the frames."""
    span = max(knots[-1] - knots[0], 1e-6)
    padded = [x - span for x in knots[-pad:]] + list(knots) + [x + span for x in knots[:pad]] if pad else list(knots)
    theta = clip(F.col("psi") / F.lit(PI2) * F.lit(span) + F.lit(float(knots[0])), padded[0], padded[-1])
    return cells.withColumns({
        "r_idx": clip(F.col("r_mm") / F.lit(fan.dr_mm), 0.0, fan.rows - 1 - 1e-3),
        "p_idx": clip((F.col("phi") - F.lit(fan.phi0)) / F.lit(fan.dphi), 0.0, fan.cols - 1 - 1e-3),
        "k_idx": clip(among_knots(theta, padded), 0.0, len(padded) - 1 - 1e-6),
    })


def scan_positions(cells: DataFrame, pad: int = 1) -> DataFrame:
    """The same for cells of many scans, which carry rows, cols, dr, phi0, per_px, n and knots as columns."""
    span, n = F.greatest(F.element_at("knots", -1) - F.element_at("knots", 1), F.lit(1e-6)), F.size("knots")
    before = F.transform(F.slice("knots", F.greatest(n - pad + 1, F.lit(1)), F.lit(pad)), lambda x: x - span)
    after = F.transform(F.slice("knots", F.lit(1), F.lit(pad)), lambda x: x + span)
    table = F.concat(before, F.col("knots"), after)
    cells = cells.withColumn("table", table)
    theta = clip(F.col("psi") / F.lit(PI2) * span + F.element_at("knots", 1), F.element_at("table", 1), F.element_at("table", -1))
    cells = cells.withColumn("theta", theta)
    return cells.withColumns({
        "r_idx": clip(F.col("r_mm") / F.col("dr"), 0.0, F.col("rows") - 1 - 1e-3),
        "p_idx": clip((F.col("phi") - F.col("phi0")) / F.col("per_px"), 0.0, F.col("cols") - 1 - 1e-3),
        "k_idx": clip(interp_knots(F.col("theta"), F.col("table"), most=1 << 16), 0.0, F.size("table") - 1 - 1e-6),
    }).drop("theta", "table", "knots")


def older_positions(cells: DataFrame, fan: Fan, n: int) -> DataFrame:
    """The older rule: frames evenly over the circle, no padding."""
    return cells.withColumns({
        "r_idx": F.col("r_mm") / F.lit(fan.dr_mm), "p_idx": (F.col("phi") - F.lit(fan.phi0)) / F.lit(fan.dphi),
        "k_idx": clip(F.col("psi") * F.lit((n - 1) / PI2), 0.0, n - 1 - 1e-3),
    })


def trilinear(samples: DataFrame, polar: DataFrame, keys: list[str]) -> DataFrame:
    """keys and v: weighted sum over the eight corners, read in tiles of lines. A corner outside counts 0."""
    return tiles.linear(samples, polar, keys)


def nearest(samples: DataFrame, polar: DataFrame, keys: list[str], by: Sequence[str] = ()) -> DataFrame:
    """by, keys and v of the nearest sample."""
    at = samples.select(*by, *keys, *(F.floor(F.col(f"{x}_idx") + 0.5).cast("int").alias(x) for x in "rpk"))
    return at.join(polar.select(*by, "r", "p", "k", "v"), [*by, "r", "p", "k"], "left").select(*by, *keys, F.coalesce("v", F.lit(0.0)).alias("v"))


def spline_coefficients(line: np.ndarray, order: int, axis: int) -> np.ndarray:
    """Interpolating B-spline coefficients along an axis, mirrored at the ends (Unser 1999)."""
    poles = {2: [math.sqrt(8) - 3], 3: [math.sqrt(3) - 2], 4: [math.sqrt(664 - math.sqrt(438976)) + math.sqrt(304) - 19, math.sqrt(664 + math.sqrt(438976)) - math.sqrt(304) - 19],
             5: [math.sqrt(67.5 - math.sqrt(4436.25)) + math.sqrt(26.25) - 6.5, math.sqrt(67.5 + math.sqrt(4436.25)) - math.sqrt(26.25) - 6.5]}.get(order, [])
    c = np.moveaxis(np.array(line, float), axis, 0)
    n = len(c)
    if n == 1:
        return np.moveaxis(c, 0, axis)
    for z in poles:
        c *= (1 - z) * (1 - 1 / z)
        k = np.arange(1, n - 1)
        first = c[0] + z ** (n - 1) * c[-1] + np.tensordot(z**k + z ** (2 * n - 2 - k), c[1:-1], 1)
        c[0] = first / (1 - z ** (2 * n - 2))
        for i in range(1, n):
            c[i] += z * c[i - 1]
        c[-1] = z / (z * z - 1) * (c[-1] + z * c[-2])
        for i in range(n - 2, -1, -1):
            c[i] = z * (c[i + 1] - c[i])
    return np.moveaxis(c, 0, axis)


def basis(order: int, t: np.ndarray) -> np.ndarray:
    """The centred B-spline of an order at t."""
    out = np.zeros_like(t)
    half = (order + 1) / 2
    for j in range(order + 2):
        out += (-1) ** j * math.comb(order + 1, j) * np.maximum(t + half - j, 0.0) ** order
    return out / math.factorial(order)


def sample_stack(stack: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Values of a 3-D array at positions (3 x n), nearest at the borders. stack holds coefficients for orders of 2 and more."""
    if order == 0:
        i = [np.clip(np.floor(x + 0.5).astype(int), 0, m - 1) for x, m in zip(at, stack.shape, strict=True)]
        return stack[tuple(i)]
    base = np.floor(at if order % 2 else at + 0.5).astype(int) - order // 2
    out = np.zeros(at.shape[1])
    weights = [[basis(order, at[d] - (base[d] + j)) for j in range(order + 1)] for d in range(3)]
    index = [[np.clip(base[d] + j, 0, stack.shape[d] - 1) for j in range(order + 1)] for d in range(3)]
    for a in range(order + 1):
        for b in range(order + 1):
            for c in range(order + 1):
                out += weights[0][a] * weights[1][b] * weights[2][c] * stack[index[0][a], index[1][b], index[2][c]]
    return out


def spline_sample(samples: DataFrame, polar: DataFrame, shape: tuple[int, int, int], keys: list[str], order: int = 3) -> DataFrame:
    """keys and v by spline interpolation of any order from 0 to 5, tile by tile; shape: rows, columns and frames of the stack."""
    return nearest_clipped(samples, polar, shape, keys) if order == 0 else tiles.spline(samples, polar, shape, keys, order)


def nearest_clipped(samples: DataFrame, polar: DataFrame, shape: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """The nearest sample, of those inside the stack."""
    inside = samples.withColumns({f"{x}_idx": clip(F.col(f"{x}_idx"), 0.0, n - 1.0) for x, n in zip("rpk", shape, strict=True)})
    return nearest(inside, polar, keys)


def phantom_stack(spark: SparkSession, kind: str, rows: int, cols: int, frames: int) -> DataFrame:
    """Stacks with known answers: by theta, by phi, by radius, or ones."""
    n = rows * cols * frames
    cell = spark.range(n).select((F.col("id") / (rows * cols)).cast("int").alias("k"), ((F.col("id") / cols).cast("int") % rows).alias("r"), (F.col("id") % cols).cast("int").alias("p"))
    v = {"theta": 0.5 * (F.cos(F.lit(PI2) * F.col("k") / frames) + 1.0), "phi": F.col("p").cast("double"), "radial": F.col("r").cast("double"), "ones": F.lit(1.0)}[kind]
    return cell.withColumn("v", v)


def resample(spark: SparkSession, polar: DataFrame, fan: Fan, frames: int, voxel_mm: float, knots: list[float] | None = None, order: int = 1, sigma_deg: float = 0.0, span_deg: float = 360.0, pad: int | None = None, slab: int = 1) -> DataFrame:
    """(ix, iy, iz, v) of all cells inside the fan."""
    pad = (2 if order >= 3 else 1) if pad is None else pad
    knots = knots or [math.radians(span_deg) * i / frames for i in range(frames)]
    stack = pad_theta(polar, frames, pad)
    n = frames + 2 * pad
    if sigma_deg > 0:
        stack = gaussian_theta(stack, n, sigma_deg * (n - 1) / max(span_deg, 1e-3))
    samples = sample_positions(valid_cells(spark, fan, voxel_mm, slab), fan, knots, pad)
    keys = ["ix", "iy", "iz"]
    if order == 0:
        return nearest(samples, stack, keys)
    if order == 1:
        return trilinear(samples, stack, keys)
    return spline_sample(samples, stack, (fan.rows, fan.cols, n), keys, order)


def mip(voxels: DataFrame, axes: tuple[str, str], shape: tuple[int, int] | None = None) -> DataFrame:
    """Maximum over the third axis; cells without voxels are 0 where a shape is given."""
    top = voxels.groupBy(*axes).agg(F.greatest(F.max("v"), F.lit(0.0)).alias("v"))
    if shape is None:
        return top
    a, b = axes
    grid = voxels.sparkSession.range(shape[0] * shape[1]).select((F.col("id") / shape[1]).cast("int").alias(a), (F.col("id") % shape[1]).cast("int").alias(b))
    return grid.join(top, [a, b], "left").select(a, b, F.coalesce("v", F.lit(0.0)).alias("v"))


def slab_bounds(cells: DataFrame, slab: int = 48) -> DataFrame:
    """First and last slab that holds a cell; nulls without any."""
    return cells.agg(F.min(F.expr(f"ix div {slab}")).alias("first_slab"), F.max(F.expr(f"ix div {slab}")).alias("last_slab"), F.count(F.lit(1)).alias("n_valid"))


