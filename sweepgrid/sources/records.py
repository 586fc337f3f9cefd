"""Metric records, configurations, calibration records and meshes in files."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import sha1_12
from ..functions.scalars import fixed_text

#: Columns of the phantom report with their decimals.
PHANTOM_DECIMALS = {"distance_mm": 2, "mean_r": 2, "std_r": 3, "min_r": 2, "max_r": 2, "band_pct": 1, "distance_err_pct": 2, "radius_err_pct": 2}
CALIBRATION = "apex_xy array<double>, r_max_pix double, image_height int, image_width int, phi0_mask double, phi1_mask double, n_rows_mask int, mask_fan_angle_deg double, mask_file string, mask_sha1_12 string"


def report_text(metrics: DataFrame, decimals: dict[str, int] | None = None) -> DataFrame:
    """Numbers as text with fixed decimals, what is missing as N/A."""
    decimals = decimals or {k: v for k, v in PHANTOM_DECIMALS.items() if k in metrics.columns}
    cells = {c: F.coalesce(fixed_text(F.col(c), d), F.lit("N/A")) for c, d in decimals.items()}
    return metrics.withColumns({c: F.when(F.col(c).isNull(), "N/A").otherwise(e) for c, e in cells.items()})


def report_table(metrics: DataFrame, errors: tuple[str, ...] = ("distance_err_pct", "radius_err_pct")) -> DataFrame:
    """The same record as numbers in single precision: a missing error counts 0 here."""
    return metrics.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)).cast("float") for c in errors if c in metrics.columns})


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_config(path: str) -> dict[str, Any]:
    """YAML or JSON by the file's ending; of repeated keys the last counts."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f) or {}
        return json.load(f)


def merge_config(defaults: dict, given: dict, flags: dict) -> dict:
    """Nested defaults, then the file, then flags that were set; nested tables are merged key by key."""
    out = dict(defaults)
    for layer in (given, {k: v for k, v in flags.items() if v is not None}):
        for k, v in layer.items():
            out[k] = out[k] | v if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def calibration_record(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION).json(path)


def write_calibration(calib: DataFrame, path: str) -> None:
    """Keyed by the mask's hash: a changed mask does not meet an old record."""
    calib.write.mode("overwrite").partitionBy("mask_sha1_12").json(path)


def kept_calibration(spark: SparkSession, folder: str, mask_path: str, measured: Callable[[], DataFrame]) -> DataFrame:
    """The record of a mask (by its file's hash) if folder has it, else what measured gives, which is kept there."""
    content = spark.read.format("binaryFile").load(mask_path).select(sha1_12(F.col("content")).alias("h")).first()["h"]
    try:
        found = calibration_record(spark, folder).where(F.col("mask_sha1_12") == content)
    except AnalysisException:  # no record yet
        found = None
    if found is None or found.isEmpty():
        made = measured()
        made = made.select(F.array("apex_x", "apex_y").alias("apex_xy"), *[c for c in made.columns if c not in ("apex_x", "apex_y")], F.lit(mask_path).alias("mask_file"), F.lit(content).alias("mask_sha1_12"))
        write_calibration(made, folder)
        found = calibration_record(spark, folder).where(F.col("mask_sha1_12") == content)
    return found.select(F.col("apex_xy")[0].alias("apex_x"), F.col("apex_xy")[1].alias("apex_y"), *[c for c in found.columns if c != "apex_xy"]).limit(1)


#: Columns of the posterior report, and those that the older report lacks.
POSTERIOR_COLUMNS = [
    "Patch", "ApexMode", "PatchArea_mm2", "GEO_radius_mm", "Angle_deg", "Plane_d_mm", "BFS_radius_mm", "Apex_depth_mm", "RMS_residual_mm",
    "Quad_R_equiv_apex_mm", "Quad_anisotropy_apex", "Disc_R_equiv_patch_mm", "Disc_H_trimmed_mean_abs_invmm", "Apex_x_mm", "Apex_y_mm", "Apex_z_mm",
]
NEWER_COLUMNS = ("Quad_R_equiv_apex_mm", "Quad_anisotropy_apex", "Disc_R_equiv_patch_mm", "Disc_H_trimmed_mean_abs_invmm")


def posterior_report(spark: SparkSession, metrics: dict[str, Any], mode: str, geodesic_mm: float, angle_deg: float, plane_mm: float, older: bool = False) -> DataFrame:
    """One row with the 16 columns of the report (older: 12); of the patch's sizes only that of its mode is given."""
    x, y, z = metrics["apex_point_ras"]
    quad = metrics["quad_metrics"]
    values = [
        metrics["patch"], metrics["apex_mode"], metrics["patch_area_mm2"], geodesic_mm if mode == "geodesic" else None, angle_deg if mode == "angle" else None, plane_mm if mode == "plane" else None,
        metrics["R_mm"], metrics["apex_depth_mm"], metrics["rms_resid_mm"], 1 / quad["H"] if abs(quad["H"]) > 1e-9 else float("inf"), quad["anisotropy"], metrics["disc_R_equiv_patch_mm"], metrics["disc_H_trimmed_mean_abs_invmm"], x, y, z,
    ]
    row = [(c, v) for c, v in zip(POSTERIOR_COLUMNS, values, strict=True) if not older or c not in NEWER_COLUMNS]
    text = ("Patch", "ApexMode")
    schema = ", ".join(f"{c} {'string' if c in text else 'double'}" for c, _ in row)
    return spark.createDataFrame([tuple(v if c in text or v is None else float(v) for c, v in row)], schema)


def write_surface(vertices: DataFrame, faces: DataFrame, scalars: list[str], path: str, most: int = 5_000_000) -> None:
    """A surface (vid, x, y, z, scalars; v0, v1, v2) as one file, written by the driver: of one eye, so its size is checked, not spread."""
    if vertices.count() > most:
        raise ValueError(f"a surface of more than {most} vertices does not go into one file")
    points = vertices.orderBy("vid").select("vid", "x", "y", "z", *scalars).toPandas()
    place = {int(v): i for i, v in enumerate(points["vid"])}
    cells = [[place[r["v0"]], place[r["v1"]], place[r["v2"]]] for r in faces.select("v0", "v1", "v2").toLocalIterator()]
    with open(path, "wb") as f:
        f.write(vtk_polydata(points[["x", "y", "z"]].values, cells, {c: points[c].values for c in scalars}))


def pick_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """The node called name, else the first whose name starts with it; reading raises without one."""
    rank = F.when(F.col("name") == name, 0).when(F.startswith("name", F.lit(name)), 1)
    best = nodes.withColumn("rank", rank).where("rank IS NOT NULL").agg(F.min(F.struct("rank", "name")).alias("b")).select(F.coalesce("b.name", F.raise_error(F.lit(f"no node {name}")).cast("string")).alias("name"))
    return nodes.join(F.broadcast(best), "name")


def vtk_polydata(points: list, triangles: list, scalars: dict[str, list]) -> bytes:
    """A mesh in the legacy binary format, big-endian."""
    import numpy as np

    p, t = np.asarray(points, ">f4"), np.asarray(triangles, ">i4")
    cells = np.hstack([np.full((len(t), 1), 3, ">i4"), t]).astype(">i4")
    out = b"# vtk DataFile Version 3.0\nsurface\nBINARY\nDATASET POLYDATA\n" + f"POINTS {len(p)} float\n".encode() + p.tobytes() + f"\nPOLYGONS {len(t)} {cells.size}\n".encode() + cells.tobytes()
    if scalars:
        out += f"\nPOINT_DATA {len(p)}\n".encode()
        for name, values in scalars.items():
            out += f"SCALARS {name.replace(' ', '_')} float 1\nLOOKUP_TABLE default\n".encode() + np.asarray(values, ">f4").tobytes() + b"\n"
    return out


def slice_images(voxels: DataFrame, basename: str, axis: str, shape: tuple[int, int, int], bits: int = 8, ext: str = ".png") -> DataFrame:
    """(name, data): one image per slice that holds a voxel, quantized by its own range; PNG or TIFF by ext."""
    import numpy as np
    import pandas as pd

    from ..operators.volume import AXES, min_max_quantize
    from . import png, tiff

    other = [a for a in AXES if a != axis]
    h, w = (shape[AXES.index(a)] for a in other)
    rows = min_max_quantize(voxels, "v", bits, by=[axis]).select(axis, *other, "q")
    encode = tiff.encode if ext in (".tif", ".tiff") else png.encode

    def run(key, pdf):
        a = np.zeros((h, w), np.uint8 if bits == 8 else np.uint16)
        a[pdf[other[0]], pdf[other[1]]] = pdf["q"]
        return pd.DataFrame({"name": [f"{basename}_{key[0]:04d}{ext}"], "data": [encode(a)]})

    return rows.groupBy(axis).applyInPandas(run, "name string, data binary")


def write_slices(voxels: DataFrame, path: str, basename: str, axis: str, shape: tuple[int, int, int], bits: int = 8) -> DataFrame:
    """One PNG image per slice as rows (name, data) of a Parquet table.

    Returns the table (name, h, w, n) of what was written.
    """
    from ..operators.volume import AXES

    h, w = (n for n, a in zip(shape, AXES, strict=True) if a != axis)
    slice_images(voxels, basename, axis, shape, bits).write.mode("overwrite").parquet(path)
    return voxels.sparkSession.read.parquet(path).select("name", F.lit(h).alias("h"), F.lit(w).alias("w"), F.length("data").alias("n"))


def write_slice_files(voxels: DataFrame, folder: str, basename: str, axis: str, shape: tuple[int, int, int], bits: int = 8, ext: str = ".tif") -> int:
    """One image file per slice, empty ones included, written by the driver one at a time; returns how many."""
    from pathlib import Path

    import numpy as np

    from ..operators.volume import AXES
    from . import png, tiff

    Path(folder).mkdir(parents=True, exist_ok=True)
    h, w = (n for n, a in zip(shape, AXES, strict=True) if a != axis)
    blank = (tiff.encode if ext in (".tif", ".tiff") else png.encode)(np.zeros((h, w), np.uint8 if bits == 8 else np.uint16))
    missing = {f"{basename}_{i:04d}{ext}" for i in range(shape[AXES.index(axis)])}
    for r in slice_images(voxels, basename, axis, shape, bits, ext).toLocalIterator():
        (Path(folder) / r["name"]).write_bytes(r["data"])
        missing.discard(r["name"])
    for name in missing:
        (Path(folder) / name).write_bytes(blank)
    return shape[AXES.index(axis)]


def first_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """The node called name, else the first of all; nothing without nodes."""
    best = nodes.agg(F.min(F.struct((F.col("name") != name).cast("int").alias("other"), F.col("name"))).alias("b")).select("b.name")
    return nodes.join(F.broadcast(best), "name")


def containing(nodes: DataFrame, base: str) -> DataFrame:
    """All nodes whose name contains base: what is saved together."""
    return nodes.where(F.contains("name", F.lit(base)))


def stack_summary(frames: DataFrame) -> DataFrame:
    """One line of text per scan: how many frames of which size and range."""
    got = frames.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("h"), F.max("width").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return got.select("scan_id", F.format_string("%d frames, %d x %d, values %.1f to %.1f", "n", "h", "w", "lo", "hi").alias("summary"))
