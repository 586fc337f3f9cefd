"""Command line: a volume from a folder of frames and a cone mask."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sweepgrid", description=__doc__)
    p.add_argument("img_dir", nargs="?")
    p.add_argument("mask_path", nargs="?")
    p.add_argument("--input-dir")
    p.add_argument("--cone-mask")
    p.add_argument("--config")
    p.add_argument("--out-dir")
    p.add_argument("-o", "--output")
    p.add_argument("--depth", type=float)
    p.add_argument("--voxel", type=float)
    p.add_argument("--sigma-theta", type=float)
    p.add_argument("--theta-span-deg", type=float)
    p.add_argument("--interp-order", type=int)
    p.add_argument("--slab-size", type=int)
    p.add_argument("--no-register", action="store_true")
    p.add_argument("--keep-duplicate", action="store_true")
    p.add_argument("--no-mask", action="store_true", help="keep what lies outside the mask")
    p.add_argument("--phantom", choices=("theta", "phi", "radial", "ones"), help="a stack with a known answer in the place of the frames'")
    p.add_argument("--even-odd", action="store_true", help="compare the volumes of even and odd frames, and warn where they differ")
    p.add_argument("--quiet", action="store_true")
    return p


def run(spark: SparkSession, img_dir: str, mask_path: str | None, out_dir: str, options, name: str | None = None, pictures: bool = True, even_odd: bool = False) -> str:
    """Reads, calibrates, reconstructs and writes; returns the file of the volume.

    pictures: eight pictures for a look at the run. even_odd: a table of axis ratios beside them, and a warning where they drift.

    A mask's calibration is kept beside the frames, by the mask's hash, and read again by later runs. Without a name
    the volume is called by the folder, with the next run number.
    """
    from .functions.session import cut
    from .operators import geometry
    from .plans import qc
    from .plans.sweep import reconstruct, unwrapped_with_mask
    from .sources import images, records
    from .sources.nrrd import write_nrrd

    frames = images.checked_stack(images.scan_frames(spark, img_dir))
    if mask_path:
        mask = images.mask_pixels(spark, mask_path)

        def measured():
            shape = mask.select("width", "height").first()
            return geometry.calibrate(mask.select("x", "y"), shape["width"], shape["height"])

        calib = records.kept_calibration(spark, str(Path(img_dir).parent / "mask_detection"), mask_path, measured)
    else:
        mask, calib = None, geometry.default_calibration(frames)
    record = geometry.geometry(calib.withColumn("depth_mm", F.lit(options.depth_mm))).first().asDict()
    stack, fan, on = unwrapped_with_mask(spark, images.pixels(frames), record, options, mask)
    stack = cut(stack)
    got = reconstruct(spark, stack, fan, options)
    name = name or next_name(spark, img_dir, out_dir)
    write_nrrd(got.voxels, out_dir, (got.n,) * 3, options.voxel_mm, vol_id=name)
    folder = Path(out_dir) / "QC"
    if pictures:
        folder.mkdir(parents=True, exist_ok=True)
        shown = qc.encoded(qc.pictures(got.voxels, got.n), got.n, qc.display_window(got.voxels, got.n)).unionByName(qc.frame_pictures(stack, on, fan))
        for r in shown.toLocalIterator():
            (folder / f"{r['picture']}.png").write_bytes(r["png"])
    if even_odd:
        ratios = qc.even_odd_ratios(stack, fan, len(got.knots)).orderBy("subset").collect()
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "even_odd.csv").write_text("subset,ratio,drift,alarm\n" + "".join(f"{r['subset']},{r['ratio']:.6f},{r['drift']:.6f},{str(r['alarm']).lower()}\n" for r in ratios))
        if any(r["alarm"] for r in ratios):
            print(f"sweepgrid: axis ratios of even and odd frames differ by more than {qc.ALARM}", file=sys.stderr)
    return str(Path(out_dir) / f"{name}.nrrd")


def run_config(spark: SparkSession, conf: dict) -> dict[str, str | None]:
    """The older chain by a configuration: a raw and a smooth volume on one grid, and their slices as images.

    Tables raw, smooth (enabled, sigma_theta_deg, interp_order, bit_depth) and frames (enabled, axis, bit_depth,
    basename_raw, basename_smooth). Returns the file of each volume, null for one that is switched off.
    """
    from .functions.scalars import fixed_text
    from .operators import geometry, volume
    from .plans.sweep import SweepOptions, raw_and_smooth, unwrapped
    from .sources import images, records
    from .sources.nrrd import write_nrrd

    raw, smooth, shown = (conf.get(k) or {} for k in ("raw", "smooth", "frames"))
    out = Path(conf.get("out_dir") or Path(conf["input_dir"]) / "sweepgrid_outputs")
    out.mkdir(parents=True, exist_ok=True)
    o = SweepOptions(depth_mm=float(conf.get("depth_mm", 48.0)), voxel_mm=float(conf.get("voxel_mm", 0.2)), registration=bool(conf.get("do_registration", True)), drop_duplicate=bool(conf.get("drop_duplicate", True)), older=True)
    mask = images.mask_pixels(spark, conf["cone_mask"])
    shape = mask.select("width", "height").first()
    calib = geometry.calibrate(mask.select("x", "y"), shape["width"], shape["height"]).withColumn("depth_mm", F.lit(o.depth_mm))
    record = geometry.geometry(calib, older=True).first().asDict()
    frames = images.checked_stack(images.scan_frames(spark, conf["input_dir"]))
    stack, fan = unwrapped(spark, images.pixels(frames), record, o, mask)
    setting = lambda table, sigma, order: replace(o, sigma_theta_deg=float(table.get("sigma_theta_deg", sigma)), interp_order=int(table.get("interp_order", order)))
    both = raw_and_smooth(spark, stack, fan, setting(raw, 0.0, 1), setting(smooth, 1.0, 3))
    voxel = spark.range(1).select(fixed_text(F.lit(o.voxel_mm), 3)).first()[0]
    made: dict[str, str | None] = {"raw": None, "smooth": None}
    for kind, table, got, bits in (("raw", raw, both[0], 16), ("smooth", smooth, both[1], 8)):
        if not table.get("enabled", True):
            continue
        bits, side = int(table.get("bit_depth", bits)), (got.n,) * 3
        name = f"{conf.get(kind + '_basename', 'eye_' + kind)}_{voxel}mm"
        values = got.voxels if bits == 32 else volume.min_max_quantize(got.voxels, "v", bits, auto_window=False).select("ix", "iy", "iz", F.col("q").alias("v"))
        write_nrrd(values, str(out), side, o.voxel_mm, bits, name)
        made[kind] = str(out / f"{name}.nrrd")
        if shown.get("enabled", False):
            axis = volume.AXES[int(shown.get("axis", 0))]
            records.write_slice_files(got.voxels, str(out / f"frames_{kind}"), shown.get(f"basename_{kind}", f"eye_{kind}_slice"), axis, side, int(shown.get("bit_depth", 16)))
    return made


def next_name(spark: SparkSession, img_dir: str, out_dir: str) -> str:
    """The folder's volume name with the run number after the highest that out_dir holds."""
    from .functions import names

    folder = Path(img_dir).resolve()
    prefix = spark.range(1).select(names.volume_prefix(F.lit(folder.name), F.lit(folder.parent.name))).first()[0]
    here = [p.name for p in Path(out_dir).glob("*.nrrd") if p.name.startswith(f"{prefix}_r")]
    files = spark.createDataFrame([(n,) for n in here], "name string")
    return prefix + "_" + files.agg(names.run_suffix(F.max(names.run_number(F.col("name"))))).first()[0]


def main(argv: list[str] | None = None) -> int:
    from .plans.sweep import SweepOptions
    from .sources.records import merge_config, read_config

    a = parser().parse_args(argv)
    conf = read_config(a.config) if a.config else {}
    img_dir, mask = a.input_dir or a.img_dir or conf.get("input_dir"), a.cone_mask or a.mask_path or conf.get("cone_mask")
    if not img_dir:
        parser().error("a folder of frames is needed")
    given = {"depth_mm": a.depth or conf.get("depth_mm"), "voxel_mm": a.voxel or conf.get("voxel_mm"), "sigma_theta_deg": a.sigma_theta, "theta_span_deg": a.theta_span_deg, "interp_order": a.interp_order, "slab_size": a.slab_size or conf.get("slab_size")}
    options = SweepOptions(**{k: v for k, v in given.items() if v is not None}, registration=not a.no_register, drop_duplicate=not a.keep_duplicate, use_mask=not a.no_mask, phantom=a.phantom)
    spark = SparkSession.builder.appName("sweepgrid").getOrCreate()
    try:
        if conf.keys() & {"raw", "smooth"}:
            # A file that has these tables asks for both volumes; flags that are set go before it.
            flags = {"input_dir": img_dir, "cone_mask": mask, "out_dir": a.out_dir, "depth_mm": a.depth, "voxel_mm": a.voxel, "do_registration": False if a.no_register else None, "drop_duplicate": False if a.keep_duplicate else None}
            made = run_config(spark, merge_config({}, conf, flags))
            if not a.quiet:
                print(*filter(None, made.values()), sep="\n")
            return 0
        file = Path(a.output) if a.output else None
        folder = str(file.parent) if file else a.out_dir or conf.get("out_dir") or str(Path(img_dir).parent)
        out = run(spark, img_dir, mask, folder, options, file.name.removesuffix(".nrrd") if file else None, even_odd=a.even_odd)
    except Exception as e:  # the exit code is what callers look at
        print(f"sweepgrid: {e}", file=sys.stderr)
        return 1
    if not a.quiet:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
