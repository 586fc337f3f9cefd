"""Quality control of a sweep: projections and slices as images, spans of a segment, even and odd frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import beside
from ..operators import recon, tiles, volume
from ..operators.recon import Fan
from ..sources import png


def pictures(voxels: DataFrame, n: int) -> DataFrame:
    """(picture, a, b, v): three maximum projections and three slices of a volume of side n, sparse but for one cell of each.

    Slices lie in the middle, that across x where the signal is largest.
    """
    top = volume.x_signal_argmax(voxels).first()
    cx = top["ix"] if top is not None and top["ix"] is not None else n // 2
    planes = (("xy", "ix", "iy", "iz", n // 2), ("xz", "ix", "iz", "iy", n // 2), ("yz", "iy", "iz", "ix", cx))
    rows = F.array(*[F.struct(F.lit(f"mip_{p}").alias("picture"), F.col(a).alias("a"), F.col(b).alias("b")) for p, a, b, _, _ in planes], *[F.when(F.col(c) == at, F.struct(F.lit(f"slice_{p}").alias("picture"), F.col(a).alias("a"), F.col(b).alias("b"))) for p, a, b, c, at in planes])
    each = voxels.select(F.explode(F.array_compact(rows)).alias("c"), "v").select("c.picture", "c.a", "c.b", "v")
    names = [f"{kind}_{p}" for kind in ("mip", "slice") for p, *_ in planes]
    corner = voxels.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("picture"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0.0).alias("v"))
    return each.unionByName(corner).groupBy("picture", "a", "b").agg(F.greatest(F.max("v"), F.lit(0.0)).alias("v"))


def display_window(voxels: DataFrame, n: int) -> tuple[float, float]:
    """The percentiles of the whole volume between which pictures are shown."""
    r = volume.dense_percentiles(voxels, n**3, (60, 99.7)).first()
    return float(r["p_60"]), float(r["p_99_7"])


def encoded(pictures_: DataFrame, n: int, window: tuple[float, float] | None = None) -> DataFrame:
    """(picture, png): each picture in its own range, or all in one window, as an 8-bit image."""
    if window is None:
        scaled = volume.min_max_quantize(pictures_, "v", 8, by=["picture"])
    else:
        lo, hi = window
        part = (F.col("v") - lo) / max(hi - lo, 1e-12)
        scaled = pictures_.withColumn("q", F.floor(F.greatest(F.least(part * 256, F.lit(255.0)), F.lit(0.0))).cast("int"))
    ground = 0 if window is None else int(max(min((0.0 - window[0]) / max(window[1] - window[0], 1e-12) * 256, 255.0), 0.0))

    def run(key, pdf):
        a = np.full((n, n), ground, np.uint8)
        a[pdf["a"], pdf["b"]] = pdf["q"]
        return pd.DataFrame({"picture": [key[0]], "png": [png.encode(a)]})

    return scaled.groupBy("picture").applyInPandas(run, "picture string, png binary")


#: Beyond so much difference of axis ratios a sweep's geometry is in doubt.
ALARM = 0.02


def even_odd_ratios(stack: DataFrame, fan: Fan, frames: int, voxel_mm: float = 0.30, least: int = 500) -> DataFrame:
    """(subset, ratio, drift, alarm): axis ratio of the volumes from all, even and odd frames, and how far it lies from that of all.

    The three are resampled as three scans of one plan.
    """
    by, keys = ["subset"], ["ix", "iy", "iz"]
    subsets = [(name, fan.rows, fan.cols, fan.phi0, fan.phi1, fan.depth_mm, voxel_mm, fan.dr_mm, fan.dphi, n) for name, n in (("all", frames), ("even", (frames + 1) // 2), ("odd", frames // 2)) if n]
    known = stack.sparkSession.createDataFrame(subsets, "subset string, rows int, cols int, phi0 double, phi1 double, depth double, voxel_mm double, dr double, per_px double, n int")
    known = known.withColumn("knots", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.lit(2 * math.pi) * i / F.col("n")))
    parity = F.when(F.col("k") % 2 == 0, "even").otherwise("odd")
    each = F.explode(F.array(F.struct(F.lit("all").alias("subset"), F.col("k")), F.struct(parity.alias("subset"), F.floor(F.col("k") / 2).cast("int").alias("k"))))
    rows = stack.select(each.alias("s"), "r", "p", "v").select("s.subset", "s.k", "r", "p", "v")
    padded = recon.pad_theta(beside(rows, known.select("subset", "n"), by), F.col("n"), 1)
    samples = recon.scan_positions(recon.scan_cells(known, by, ["rows", "cols", "dr", "phi0", "per_px", "knots"]))
    got = volume.axis_ratio(tiles.linear(samples, padded, keys, by), recon.axis_count(fan.depth_mm, voxel_mm) ** 3, least=least, by=by)
    whole = got.where("subset = 'all'").select(F.col("ratio").alias("whole"))
    drift = F.abs(F.col("ratio") - F.col("whole"))
    return got.join(F.broadcast(whole)).select("subset", "ratio", drift.alias("drift"), (drift > ALARM).alias("alarm"))


def frame_pictures(stack: DataFrame, on: DataFrame | None, fan: Fan) -> DataFrame:
    """(picture, png): the middle unwrapped frame, by its own range, and the mask on the polar grid; a picture is as large as one frame."""
    middle = stack.agg(F.expr("(max(k) + 1) div 2").alias("m"))
    frame = stack.join(F.broadcast(middle), F.col("k") == F.col("m")).select(F.lit("unwrapped_mid").alias("picture"), "r", "p", F.col("v").cast("double").alias("v"))
    if on is not None:
        frame = frame.unionByName(on.select(F.lit("mask").alias("picture"), "r", "p", F.lit(1.0).alias("v")))
    shown = volume.min_max_quantize(frame.where(F.col("picture") != "mask"), "v", 8, by=["picture"]).unionByName(frame.where(F.col("picture") == "mask").withColumn("q", F.lit(255)))
    h, w = fan.rows, fan.cols

    def run(key, pdf):
        a = np.zeros((h, w), np.uint8)
        a[pdf["r"], pdf["p"]] = pdf["q"]
        return pd.DataFrame({"picture": [key[0]], "png": [png.encode(a)]})

    return shown.groupBy("picture").applyInPandas(run, "picture string, png binary")


def edge_columns(row: np.ndarray, low: float = 50.0, high: float = 150.0) -> np.ndarray:
    """Columns of edges in one row of 8-bit values: horizontal Sobel response, peaks along the row, hysteresis."""
    v = row.astype(float)
    g = np.abs(4.0 * (np.append(v[1:], v[-1]) - np.insert(v[:-1], 0, v[0])))
    peak = (g > np.insert(g[:-1], 0, 0.0)) & (g >= np.append(g[1:], 0.0))
    weak, strong = peak & (g > low), peak & (g > high)
    keep, run = np.zeros(len(v), bool), []
    for i in [*np.flatnonzero(weak), len(v) + 2]:
        if run and i > run[-1] + 1:
            if strong[run].any():
                keep[run] = True
            run = []
        run.append(i)
    return np.flatnonzero(keep)


def segment_spans(polar: DataFrame, k: int, r: int, mm_per_px: float) -> DataFrame:
    """(threshold_mm, edge_mm): width of what is above mid-range in one depth row, against the width between its edges.

    One row of one frame, as wide as the probe's image; nothing where fewer than two columns are above.
    """
    line = polar.where((F.col("k") == k) & (F.col("r") == r)).groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda x: x["v"].cast("double")).alias("vs"))

    def run(batches):
        for b in batches:
            out = []
            for vs in b["vs"]:
                v = np.asarray(vs)
                above = np.flatnonzero(v > 0.5 * (v.max() + v.min()))
                if v.max() <= 0 or len(above) < 2:
                    continue
                edges = edge_columns((255 * (v - v.min()) / (np.ptp(v) + 1e-6)).astype(np.uint8))
                wide = above[-1] - above[0]
                out.append((wide * mm_per_px, (wide if len(edges) < 2 else edges[-1] - edges[0]) * mm_per_px))
            yield pd.DataFrame(out, columns=["threshold_mm", "edge_mm"], dtype=float)

    return line.mapInPandas(run, "threshold_mm double, edge_mm double")
