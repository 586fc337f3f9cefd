"""Volumes of all scans of a table of frame rows, and a report on each, in one run.

    python -m jobs.scan_volumes --frames embeddings.parquet --volumes OUT/volumes --reports OUT/reports --config jobs/scan_volumes.json

Input: rows of frames (vec_id, embedding, label): a vector is a depth row, so many vectors make a frame and so many frames a
scan, by the configuration; the last frame is filled up with zeros. The smallest label of a scan names its depth preset.
All scans go through one plan (`sweepgrid.plans.scans`). Output: voxels partitioned by scan and slab of depth planes, and a
report of a row a scan, partitioned by scan. A run replaces the partitions of the scans that its input holds
and leaves all others, so that it can be repeated, and can be run for new scans alone. A scan too small for a voxel has a report
without figures.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.functions.session import beside, cut
from sweepgrid.plans import scans
from sweepgrid.plans.sweep import SweepOptions

from .common import log, main, read_json

VOXELS = "ix int, iy int, iz int, v double, scan_id int, slab int"
DEFAULTS = {
    "vectors_per_frame": 16, "frames_per_scan": 8, "fan_degrees": 52.0, "depths_mm": [16.0, 18.0, 20.0], "voxel_mm": 2.0, "registration": True,
    "best_cut": True, "blend_frames": 2, "sigma_theta_deg": 0.0, "interp_order": 1, "slab_size": 8,
}


def stack_of(vectors: DataFrame, rows: int, frames: int) -> DataFrame:
    """(scan_id, k, r, p, v) of all vectors; rows that the last frame lacks are 0. A missing vector, or value, counts 0."""
    at = lambda c: [F.floor(c / (rows * frames)).cast("int").alias("scan_id"), F.pmod(F.floor(c / rows), F.lit(frames)).cast("int").alias("k"), F.pmod(c, F.lit(rows)).cast("int").alias("r")]
    values = vectors.select("vec_id", F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("line"))
    last = values.agg(F.max("vec_id").alias("m"), F.max(F.size("line")).alias("cols")).where("m IS NOT NULL")
    zeros = last.select(F.explode(F.sequence(F.col("m") + 1, F.floor(F.col("m") / rows) * rows + rows)).alias("vec_id"), F.array_repeat(F.lit(0.0), F.col("cols")).alias("line")).where(F.pmod("vec_id", F.lit(rows)) > 0)
    whole = values.unionByName(zeros)
    return whole.select(*at(F.col("vec_id")), F.posexplode("line").alias("p", "v")).withColumn("v", F.coalesce("v", F.lit(0.0)))


def scan_settings(vectors: DataFrame, conf: dict) -> DataFrame:
    """One row a scan: its rows, columns, fan and depth preset."""
    rows, depths = conf["vectors_per_frame"], conf["depths_mm"]
    scan = F.floor(F.col("vec_id") / (rows * conf["frames_per_scan"])).cast("int")
    found = vectors.groupBy(scan.alias("scan_id")).agg(F.coalesce(F.min("label"), F.lit(0)).alias("preset"), F.max(F.size("embedding")).alias("cols"), F.count(F.lit(1)).alias("vectors"))
    depth = F.element_at(F.array(*[F.lit(float(d)) for d in depths]), (F.pmod("preset", F.lit(len(depths))) + 1).cast("int"))
    return found.select("scan_id", F.lit(rows).alias("rows"), "cols", F.lit(0.0).alias("phi0"), F.lit(math.radians(conf["fan_degrees"])).alias("phi1"), depth.alias("depth"), "vectors")


def run(spark: SparkSession, frames: str, volumes: str, reports: str, config: str | None = None, **changes) -> dict[str, int]:
    """Reads frames, writes volumes and reports; returns the rows read and written. changes: settings that go before the file's."""
    conf = read_json(spark, config, DEFAULTS) | changes
    vectors = spark.read.parquet(frames).select("vec_id", "embedding", "label").where("vec_id IS NOT NULL")
    stack, settings = stack_of(vectors, conf["vectors_per_frame"], conf["frames_per_scan"]), cut(scan_settings(vectors, conf))
    o = SweepOptions(voxel_mm=conf["voxel_mm"], registration=conf["registration"], best_cut=conf["best_cut"], blend_frames=conf["blend_frames"], sigma_theta_deg=conf["sigma_theta_deg"], interp_order=conf["interp_order"], slab_size=conf["slab_size"])
    got = scans.reconstruct(stack, settings, o)

    # Slabs of a scan are written by different tasks: no scan has to fit one. A small partition costs a file all the same, so tasks go
    # by the number of partitions and not of bytes: a given number of them is not coalesced.
    voxels = got.voxels.withColumn("slab", F.floor(F.col("ix") / o.slab_size).cast("int"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    replace = lambda df, *by: df.repartition(tasks, *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    replace(voxels, "scan_id", "slab").parquet(volumes)

    of = got.scans.select("scan_id", "n", "cut", "score", "depth").join(settings.select("scan_id", "vectors"), "scan_id")
    mine = beside(spark.read.schema(VOXELS).parquet(volumes), of.select("scan_id"), ["scan_id"])
    figures = mine.groupBy("scan_id").agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("v") != 0).cast("long")).alias("filled"), F.min("v").alias("lowest"), F.max("v").alias("highest"), F.avg("v").alias("mean"))
    lines = cut(of.join(figures, "scan_id", "left"))
    replace(lines, "scan_id").parquet(reports)
    total = lines.agg(F.coalesce(F.sum("vectors"), F.lit(0)), F.coalesce(F.sum("cells"), F.lit(0)), F.count(F.lit(1))).first()
    made = dict(zip(("vectors", "voxels", "scans"), total, strict=True))
    log.info("read %d vectors from %s; wrote %d voxels of %d scans to %s, reports to %s", made["vectors"], frames, made["voxels"], made["scans"], volumes, reports)
    return made


if __name__ == "__main__":
    sys.exit(main(__doc__, run, ("frames", "volumes", "reports")))
