"""Extension: frames that arrive as files. Correlations with the frame before, as a stream.

The batch engine reads a scan whole; here each arriving frame is compared with its neighbour in time within a
watermark, so state stays as large as the scans that are open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.seam import corr_of_sums


def frame_summaries(pixels: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(scan_id, k, window, n, mean_v, std_v) of a stream of pixels (ts, scan_id, k, v): one state row per open frame."""
    w = pixels.withWatermark("ts", delay)
    return w.groupBy(F.window("ts", delay), "scan_id", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"))


def stream_neighbour_corr(pixels: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(scan_id, k, corr) by a stream-stream join of each frame's pixels with those of the frame before."""
    a = pixels.withWatermark("ts", delay).alias("a")
    b = pixels.select(F.col("ts").alias("ts_b"), F.col("scan_id").alias("scan_b"), (F.col("k") + 1).alias("k_b"), F.col("r").alias("r_b"), F.col("p").alias("p_b"), F.col("v").alias("v_b")).withWatermark("ts_b", delay)
    near = F.expr(f"a.scan_id = scan_b AND a.k = k_b AND a.r = r_b AND a.p = p_b AND ts_b BETWEEN a.ts - INTERVAL {delay} AND a.ts + INTERVAL {delay}")
    x, y = F.col("v").cast("double"), F.col("v_b").cast("double")
    met = a.join(b, near).groupBy(F.window("ts", delay), "scan_id", "k")
    sums = met.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    return sums.select("scan_id", "k", corr_of_sums(F.col("n").cast("double"), *(F.col(c) for c in ("x", "y", "xy", "xx", "yy"))).alias("corr"))
