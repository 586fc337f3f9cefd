"""Frames and masks from image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import numeric_first_key, stem
from ..functions.quantiles import ranked
from ..operators.polar import brightness


def scan_frames(spark: SparkSession, folder: str, scan_id: str = "scan") -> DataFrame:
    """(scan_id, frame_idx, origin, height, width, n_channels, data): jpg and png files in numeric order of their names.

    Files are decoded where they lie; only names, not pixels, are put in order.
    A file that two patterns match stands once. Hidden files are left out.
    """
    images = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*.{jpg,JPG,jpeg,JPEG,png,PNG}").load(folder).select("image.*").dropDuplicates(["origin"])
    names = images.select("origin", stem(F.col("origin")).alias("stem"))
    order = ranked(names, [*numeric_first_key(F.col("stem")), "origin"], "rank").select("origin", (F.col("rank") - 1).cast("int").alias("frame_idx"))
    return images.join(order, "origin").select(F.lit(scan_id).alias("scan_id"), "frame_idx", "origin", "height", "width", F.col("nChannels").alias("n_channels"), "data")


def checked_stack(frames: DataFrame) -> DataFrame:
    """frames, or an error when read if shapes differ or a scan has fewer than two frames."""
    shape = frames.groupBy("scan_id").agg(F.countDistinct(F.struct("height", "width")).alias("shapes"), F.count(F.lit(1)).alias("n"))
    bad = F.when(F.col("shapes") > 1, "frames of different shapes").when(F.col("n") < 2, "fewer than two frames")
    ok = F.when(bad.isNull(), True).otherwise(F.raise_error(bad).cast("boolean"))
    return frames.join(shape, "scan_id").where(ok).drop("shapes", "n")


def pixels(frames: DataFrame) -> DataFrame:
    """(scan_id, k, y, x, v): grey pixels in long form, in Arrow batches (bytes have no unsigned column type)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n_channels).astype(float)
                g = a[..., 0] if r.n_channels == 1 else np.floor(brightness(a[..., 0], a[..., 1], a[..., 2]))
                y, x = np.divmod(np.arange(g.size), r.width)
                yield pd.DataFrame({"scan_id": r.scan_id, "k": r.frame_idx, "y": y.astype("int32"), "x": x.astype("int32"), "v": g.ravel()})

    return frames.select("scan_id", "frame_idx", "height", "width", "n_channels", "data").mapInPandas(run, "scan_id string, k int, y int, x int, v double")


def mask_pixels(spark: SparkSession, path: str, threshold: int = 128) -> DataFrame:
    """(x, y) of the pixels of a mask image above the threshold, with its width and height."""
    image = spark.read.format("image").load(path).select(F.lit("mask").alias("scan_id"), F.lit(0).alias("frame_idx"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data")
    shape = image.select("width", "height")
    return pixels(image).where(F.col("v") > threshold).select("x", "y").join(F.broadcast(shape))
