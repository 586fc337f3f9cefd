"""Registration of frames in depth and angle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dense
from ..functions.scalars import clip, half_even, num
from ..functions.session import beside


def profile(polar: DataFrame) -> DataFrame:
    """(k, p, s): sums over depth."""
    return polar.groupBy("k", "p").agg(F.sum("v").alias("s"))


def xcorr_shift(polar: DataFrame, reference: int) -> DataFrame:
    """(k, shift): the first lag at which a frame's angle profile fits the reference's best (direct sums)."""
    flat = profile(polar).withColumn("s", F.col("s") - F.avg("s").over(Window.partitionBy("k")))
    # The reference profile is one row per angle column: bounded by the probe's width.
    ref = flat.where(F.col("k") == reference).select(F.collect_list(F.struct("p", "s")).alias("ref"))
    pairs = flat.join(F.broadcast(ref)).select("k", "p", "s", F.explode("ref").alias("a"))
    cc = pairs.groupBy("k", (F.col("a.p") - F.col("p")).alias("lag")).agg(F.sum(F.col("a.s") * F.col("s")).alias("cc"))
    return cc.groupBy("k").agg((-F.max(F.struct("cc", (-F.col("lag")).alias("minus")))["minus"]).cast("int").alias("shift"))


def phase_shift(a: np.ndarray, b: np.ndarray, eps: float = 1e-8) -> tuple[float, float]:
    """Shift (rows, columns) to apply to b so that it fits a, with a parabola through the peak on each axis."""
    return peak_shift(np.fft.fft2(a - a.mean()), b, eps)


def peak_shift(fixed: np.ndarray, b: np.ndarray, eps: float = 1e-8) -> tuple[float, float]:
    """The same with the spectrum of a."""
    spectrum = fixed * np.conj(np.fft.fft2(b - b.mean()))
    c = np.abs(np.fft.ifft2(spectrum / (np.abs(spectrum) + eps)))
    peak = np.unravel_index(int(c.argmax()), c.shape)
    out = []
    for axis in (0, 1):
        line = np.take(c, peak[1 - axis], axis=1 - axis)
        n, i = len(line), int(peak[axis])
        lo, mid, hi = line[i - 1], line[i], line[(i + 1) % n]
        bend = lo - 2 * mid + hi
        out.append((i - n if i > n // 2 else i) + (0.5 * (lo - hi) / bend if abs(bend) >= 1e-12 else 0.0))
    return float(out[0]), float(out[1])


#: Frames that one task compares with their reference at a time.
TOGETHER = 16


def estimate_shifts(polar: DataFrame, rows: int | Column, cols: int | Column, reference: int | Column, r_frac: tuple[float, float] = (0.20, 0.90), p_frac: tuple[float, float] = (0.05, 0.95), by: Sequence[str] = ()) -> DataFrame:
    """(k, dr, dphi): phase correlation with the reference frame in a region of interest.

    Depth rows travel as arrays. Frames are dealt out sixteen at a time, each lot with a copy of the reference, so that
    a task holds as many frames at once and nothing grows with the scan. What a frame lacks of the region counts 0.
    """
    whole = lambda share, n: F.floor(F.lit(share) * num(n)).cast("int")
    named = polar.select(*by, "k", "r", "p", "v", whole(r_frac[0], rows).alias("r0"), whole(r_frac[1], rows).alias("r1"), whole(p_frac[0], cols).alias("p0"), whole(p_frac[1], cols).alias("p1"), num(reference).cast("int").alias("ref"))
    roi = named.where("r >= r0 AND r < r1 AND p >= p0 AND p < p1")
    pairs = roi.groupBy(*by, "k", "r", "r0", "r1", "p0", "p1", "ref").agg(F.collect_list(F.struct((F.col("p") - F.col("p0")).alias("i"), F.col("v").cast("double").alias("v"))).alias("px"))
    lines = pairs.select(*by, "k", "ref", (F.col("r") - F.col("r0")).alias("i"), (F.col("r1") - F.col("r0")).alias("h"), (F.col("p1") - F.col("p0")).alias("w"), dense("px", F.col("p1") - F.col("p0")).alias("line"))
    lots = lines.select(*by, F.floor(F.col("k") / TOGETHER).cast("int").alias("lot"), "k", F.lit(False).alias("is_ref"), "i", "h", "w", "line")
    last = lines.groupBy(*by).agg(F.floor(F.max("k") / TOGETHER).cast("int").alias("last"))
    held = beside(lines.where("k = ref"), last, by).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("last"))))
    sent = lots.unionByName(held.select(*by, "lot", "k", F.lit(True).alias("is_ref"), "i", "h", "w", "line"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        h, w = t.column("h")[0].as_py(), t.column("w")[0].as_py()
        is_ref, i = t.column("is_ref").to_numpy(), t.column("i").to_numpy()
        values = np.concatenate([c.flatten().to_numpy() for c in t.column("line").chunks]).reshape(-1, w)
        fixed = np.zeros((h, w))
        fixed[i[is_ref]] = values[is_ref]
        frames, at = np.unique(t.column("k").to_numpy()[~is_ref], return_inverse=True)
        moved = np.zeros((len(frames), h, w))
        moved[at, i[~is_ref]] = values[~is_ref]
        spectrum = np.fft.fft2(fixed - fixed.mean())
        got = [peak_shift(spectrum, m) for m in moved]
        columns = [pa.array([k.as_py()] * len(frames), k.type) for k in key[:-1]] + [pa.array(frames, pa.int32()), pa.array([x for x, _ in got], pa.float64()), pa.array([y for _, y in got], pa.float64())]
        return pa.Table.from_arrays(columns, names=[*by, "k", "dr", "dphi"])

    kinds = dict(polar.dtypes)
    return sent.groupBy(*by, "lot").applyInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "k int, dr double, dphi double"]))


def roll_columns(polar: DataFrame, shift: Column, cols: int) -> DataFrame:
    """Integer shift around the circle of columns."""
    return polar.withColumn("p", F.pmod(F.col("p") + shift, F.lit(cols)).cast("int"))


def _two_taps(polar: DataFrame, axis: str, x: Column, size: int | Column, wrap: bool, by: Sequence[str] = ()) -> DataFrame:
    """Values at fractional positions x along an axis, linear between neighbours, by a self-join on two taps."""
    other = "p" if axis == "r" else "r"
    want = polar.withColumns({"__x": x, "__size": num(size)})
    low = F.floor("__x").cast("int")
    taps = F.array(F.struct(low.alias("i"), (1.0 - (F.col("__x") - low)).alias("w")), F.struct((low + 1).alias("i"), (F.col("__x") - low).alias("w")))
    sent = want.select(*by, "k", "r", "p", "__size", F.explode(taps).alias("t"))
    at = F.pmod(F.col("t.i"), F.col("__size")) if wrap else clip(F.col("t.i"), 0.0, F.col("__size") - 1.0)
    sent = sent.select(*by, "k", "r", "p", at.cast("int").alias("__at"), F.col("t.w").alias("__w"))
    src = polar.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("k").alias("__k"), F.col(axis).alias("__s"), F.col(other).alias("__o"), F.col("v").alias("__v"))
    same = (sent["k"] == src["__k"]) & (sent[other] == src["__o"]) & (sent["__at"] == src["__s"])
    for c in by:
        same = same & (sent[c] == src[f"__{c}"])
    return sent.join(src, same).groupBy(*by, "k", "r", "p").agg(F.sum(F.col("__w") * F.col("__v")).alias("v"))


def shift_columns(polar: DataFrame, shift: Column, cols: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Fractional shift around the circle of columns (period: the number of columns)."""
    return _two_taps(polar, "p", F.pmod(F.col("p") - shift, num(cols)), cols, True, by)


def shift_rows(polar: DataFrame, shift: Column, rows: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Fractional shift in depth, the edge repeated."""
    return _two_taps(polar, "r", clip(F.col("r") - shift, 0.0, num(rows) - 1.0), rows, False, by)


def _frame_taps(v: np.ndarray, there: np.ndarray, valued: np.ndarray, x: np.ndarray, n: int, wrap: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_two_taps` of one frame along its last axis (size: n), at positions x that all lines share: values, and where there are pixels and values."""
    low = np.floor(x).astype(int)
    out, met, some = np.zeros((len(v), len(x))), np.zeros((len(v), len(x)), bool), np.zeros((len(v), len(x)), bool)
    for i, w in ((low, 1.0 - (x - low)), (low + 1, x - low)):
        i = i % n if wrap else np.clip(i, 0, n - 1)
        out += np.where(valued[:, i], w * v[:, i], 0.0)
        met |= there[:, i]
        some |= valued[:, i]
    return out, met, some


def apply_shifts(polar: DataFrame, shifts: DataFrame, rows: int | Column, cols: int | Column, subpixel: bool = True, least: float = 1e-3, by: Sequence[str] = ()) -> DataFrame:
    """Rolls each frame by its rounded dphi, then moves it by what is left (around the circle) and by dr (the edge repeated), where they matter.

    A frame travels once and both moves are made on it; what it lacks stays out, as with `shift_columns` and `shift_rows`.
    """
    moved = polar.select(*by, "k", "r", "p", "v", num(rows).alias("rows"), num(cols).alias("cols")).join(shifts.select(*by, "k", "dr", "dphi"), [*by, "k"])
    whole = half_even(F.col("dphi")).cast("int")
    rest = F.col("dphi") - whole
    rolled = moved.select(*by, "k", "r", F.pmod(F.col("p") + whole, F.col("cols")).cast("int").alias("p"), "v", F.when(F.abs(rest) > least, rest).otherwise(0.0).alias("f"), F.when(F.abs(F.col("dr")) > least, F.col("dr")).otherwise(0.0).alias("d"), "rows", "cols")
    if not subpixel:
        return rolled.select(*by, "k", "r", "p", "v")
    kinds = dict(rolled.dtypes)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        f, d, h, w = (t.column(c)[0].as_py() for c in ("f", "d", "rows", "cols"))
        h, w = int(h), int(w)
        r, p, value = t.column("r").to_numpy(), t.column("p").to_numpy(), t.column("v")
        shape = (max(h, int(r.max()) + 1), w)
        v, valued, there = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        there[r, p], valued[r, p] = True, value.is_valid().to_numpy()
        v[r, p] = value.fill_null(0.0).to_numpy()
        turned, met, some = _frame_taps(v, there, valued, (np.arange(w) - f) % w, w, True)
        there, valued = met & there, some & there
        sunk, met, some = _frame_taps(turned.T, there.T, valued.T, np.clip(np.arange(shape[0]) - d, 0.0, h - 1.0), h, False)
        r, p = np.nonzero((met & there.T).T)
        keys = [pa.array([x.as_py()] * len(r), x.type) for x in key]
        return pa.Table.from_arrays([*keys, pa.array(r.astype(t.schema.field("r").type.to_pandas_dtype())), pa.array(p.astype(np.int32)), pa.array(sunk.T[r, p], mask=~some.T[r, p])], names=[*by, "k", "r", "p", "v"])

    sent = rolled.withColumn("v", F.col("v").cast("double"))
    return sent.groupBy(*by, "k").applyInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in (*by, "k", "r")), "p int, v double"]))


def register(polar: DataFrame, rows: int, cols: int, reference: int, subpixel: bool = True) -> DataFrame:
    """All frames moved onto the reference frame."""
    return apply_shifts(polar, estimate_shifts(polar, rows, cols, reference), rows, cols, subpixel)


def register_older(polar: DataFrame, cols: int, reference: int) -> DataFrame:
    """The older rule: whole columns only, by the one-dimensional profile."""
    moved = polar.join(xcorr_shift(polar, reference), "k")
    return roll_columns(moved, F.col("shift"), cols).select("k", "r", "p", "v")
