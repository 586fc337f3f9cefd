"""Known answers: geometry, phantoms, surfaces, sources and invariants."""

import heapq
import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepgrid.functions import names, scalars, scans, session
from sweepgrid.operators import geometry, graph, mesh, pointcloud, recon, registration, seam, volume
from sweepgrid.queries.mesh import _sphere
from sweepgrid.sources import nrrd, records


def calib(spark, **k):
    base = {"image_height": 512, "r_max_pix": 400.0, "depth_mm": 48.0, "n_rows_mask": None, "phi0_mask": None, "phi1_mask": None} | k
    schema = "image_height int, r_max_pix double, depth_mm double, n_rows_mask int, phi0_mask double, phi1_mask double"
    return spark.createDataFrame([tuple(base.values())], schema)


def test_angle_step_uses_mask_rows(spark):
    g = geometry.geometry(calib(spark, n_rows_mask=256, phi0_mask=0.0, phi1_mask=math.radians(52))).first()
    assert g["dphi"] == pytest.approx(math.radians(52) / 255)


def test_depth_step(spark):
    assert geometry.geometry(calib(spark, r_max_pix=480.0)).first()["dr"] == pytest.approx(0.1)


def test_ones_stay_ones(spark):
    """16 x 40 x 32 ones at voxel 1 and depth 20: a 40-cubed grid, 1 in every valid cell."""
    fan = recon.Fan(20.0, 0.0, math.radians(52), 40, 32, 40.0)
    got = recon.resample(spark, recon.phantom_stack(spark, "ones", 40, 32, 16), fan, 16, 1.0)
    assert recon.axis_count(20.0, 1.0) == 40
    low, high, n = got.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    assert low == pytest.approx(1) and high == pytest.approx(1) and n > 1000


@pytest.mark.parametrize("order", [0, 1, 2, 3, 5])
def test_orders_agree_on_a_plane(spark, order):
    fan = recon.Fan(16.0, 0.0, math.radians(52), 16, 24)
    stack = recon.phantom_stack(spark, "ones", 16, 24, 12)
    got = recon.resample(spark, stack, fan, 12, 4.0, order=order).agg(F.min("v"), F.max("v")).first()
    assert got[0] == pytest.approx(1, abs=1e-6) and got[1] == pytest.approx(1, abs=1e-6)


def test_spline_interpolates():
    a = np.random.default_rng(0).random((6, 7, 8))
    c = a
    for axis in range(3):
        c = recon.spline_coefficients(c, 3, axis)
    at = np.array([[2.0, 3.0], [3.0, 2.0], [4.0, 3.0]])
    assert recon.sample_stack(c, at, 3) == pytest.approx(a[[2, 3], [3, 2], [4, 3]], abs=2e-2)


def test_roll_back_is_identity(spark):
    s = recon.phantom_stack(spark, "phi", 3, 4, 9)
    back = seam.roll_frames(seam.roll_frames(s, 4, 9), -4, 9)
    assert back.exceptAll(s.select(back.columns)).count() == 0


def test_blend_keeps_pair_sums(spark):
    s = recon.phantom_stack(spark, "theta", 2, 3, 12).withColumn("v", F.col("v") * (F.col("k") + 1))
    assert seam.blend_closure(s).agg(F.sum("v")).first()[0] == pytest.approx(s.agg(F.sum("v")).first()[0])


def test_constant_frames_correlate_zero(spark):
    assert {r["corr"] for r in seam.adjacent_corr(recon.phantom_stack(spark, "ones", 3, 3, 3)).collect()} == {0.0}


def test_best_cut_needs_six_frames(spark):
    assert tuple(seam.best_cut(recon.phantom_stack(spark, "phi", 2, 8, 5)).first()) == (0, -1.0)


def test_phase_shift_finds_a_roll():
    a = np.random.default_rng(1).random((32, 48))
    dr, dphi = registration.phase_shift(a, np.roll(a, (-3, 5), (0, 1)))
    assert round(dr) == 3 and round(dphi) == -5


def test_registration_undoes_a_roll(spark):
    rng = np.random.default_rng(2)
    base = rng.random((16, 32))
    rows = [(k, r, p, float(np.roll(base, k, 1)[r, p])) for k in range(3) for r in range(16) for p in range(32)]
    got = registration.estimate_shifts(spark.createDataFrame(rows, "k int, r int, p int, v double"), 16, 32, 1, (0, 1), (0, 1)).collect()
    assert {r["k"]: round(r["dphi"]) for r in got} == {0: 1, 1: 0, 2: -1}


def test_sphere_fit_is_exact(spark):
    v, _ = _sphere(spark)
    x, y, z, r = pointcloud.robust_sphere(v)
    assert (x, y, z, r) == pytest.approx((1, 2, 3, 12), abs=1e-6)
    band = pointcloud.radius_stats(v.withColumn("seg", F.lit("s"))).first()
    assert band["band_pct"] == pytest.approx(100)


def test_sphere_area_curvature_and_boundary(spark):
    v, f = _sphere(spark)
    area = mesh.patch_area(f, v, v).first()["area"]
    assert area == pytest.approx(4 * math.pi * 144, rel=0.02)
    assert mesh.boundary(f).count() == 0
    assert mesh.mean_curvature(f, v).agg(F.median("h")).first()[0] == pytest.approx(1 / 12, rel=0.05)


def test_windowed_sinc_keeps_a_flat_mesh_flat(spark, sf_dir):
    from sweepgrid.queries.mesh import _grid

    v, f = _grid(spark, sf_dir)
    got = mesh.windowed_sinc(f, v.withColumn("z", F.lit(0.0)), rounds=4)
    assert got.agg(F.max(F.abs("z"))).first()[0] == pytest.approx(0)


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["label"] for r in graph.hook_components(edges).collect()} == {0}


def test_eigenvalues_match(spark):
    m = np.array([[4.0, 1, 0.5], [1, 3, 0.2], [0.5, 0.2, 1]])
    e = scalars.symmetric_eigenvalues(*(F.lit(float(x)) for x in (m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2])))
    got = spark.range(1).select(*(c.alias(n) for c, n in zip(e, "abc", strict=True))).first()
    assert tuple(got) == pytest.approx(tuple(sorted(np.linalg.eigvalsh(m), reverse=True)))


def test_quantize_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert {r["q"] for r in volume.min_max_quantize(df, "v", 8).collect()} == {0}
    with pytest.raises(Exception, match="no finite"):
        volume.min_max_quantize(spark.createDataFrame([(float("nan"),)], "v double"), "v", 8).collect()


def test_slices_out_of_range(spark):
    with pytest.raises(ValueError):
        volume.slices(spark.range(0), 0, [9], (9, 9, 9))


def test_percent_error_and_report(spark):
    df = spark.createDataFrame([(30.3, 30.0), (1.0, None)], "mean_r double, truth double")
    df = df.withColumn("radius_err_pct", pointcloud.percent_error(F.col("mean_r"), F.col("truth")))
    text = {r["radius_err_pct"] for r in records.report_text(df).collect()}
    assert text == {"1.00", "N/A"}
    assert sorted(r["radius_err_pct"] for r in records.report_table(df).collect()) == pytest.approx([0.0, 1.0])


def test_missing_segment_raises(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "name string"), spark.createDataFrame([("x",)], "name string")
    assert [r["name"] for r in pointcloud.missing_names(a, b, "name").collect()] == ["y"]
    with pytest.raises(Exception, match="missing: y"):
        pointcloud.require_names(a, b, "name").collect()


def test_nrrd_round_trip(spark, tmp_path):
    vox = spark.createDataFrame([(0, 1, 2, 3.5), (3, 0, 1, 1.25)], "ix int, iy int, iz int, v double")
    nrrd.write_nrrd(vox, str(tmp_path / "out"), (4, 3, 5), 0.2, vol_id="a")
    got = nrrd.read_nrrd(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("ix", "iy", "iz", "v").collect())) == [(0, 1, 2, 3.5), (3, 0, 1, 1.25)]
    _, fields = nrrd.decode((tmp_path / "out" / "a.nrrd").read_bytes())
    assert fields["sizes"] == "4 3 5" and fields["space origin"] == "(-0.4,-0.2,0.0)"


@pytest.mark.parametrize(("bits", "compress"), [(32, True), (32, False), (16, True)])
def test_nrrd_segments_make_one_plain_file(spark, tmp_path, bits, compress):
    """Segments smaller than a plane, some without cells: any gzip reader takes the file, and each is read by its own task."""
    rng, n = np.random.default_rng(3), (7, 5, 6)
    want = np.zeros(n)
    for x, y, z in rng.integers(0, (7, 5, 3), (60, 3)):
        want[x, y, z] = rng.integers(1, 200)
    rows = [("b", *map(int, i), float(want[tuple(i)])) for i in np.argwhere(want)] + [("c", 6, 4, 5, 9.0)]
    vox = spark.createDataFrame(rows, "vol_id string, ix int, iy int, iz int, v double")
    nrrd.write_nrrd(vox, str(tmp_path), n, 0.5, bits=bits, compress=compress, segment=16)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.nrrd", "c.nrrd"]
    got, fields = nrrd.decode((tmp_path / "b.nrrd").read_bytes())
    assert fields["encoding"] == ("gzip" if compress else "raw") and np.array_equal(got, want)
    back = nrrd.read_nrrd(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert back.rdd.getNumPartitions() == (28 if compress else 2)


def test_nrrd_cell_outside_raises(spark, tmp_path):
    with pytest.raises(Exception, match="outside of its volume"):
        nrrd.write_nrrd(spark.createDataFrame([(0, 0, 5, 1.0)], "ix int, iy int, iz int, v double"), str(tmp_path), (4, 3, 5), 0.2, vol_id="a")


def test_config_layers(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"raw": {"a": 2}}))
    assert records.merge_config({"raw": {"a": 1, "b": 1}, "x": 1}, records.read_config(str(p)), {"x": 5, "y": None}) == {"raw": {"a": 2, "b": 1}, "x": 5}


def test_names(spark):
    row = spark.range(1).select(names.volume_prefix(F.lit("Lens 65 mm - Secondary - OD - Radial - 04-17-2022 - 08-31"), F.lit("x")).alias("n"), scalars.hms(F.lit(90061)).alias("t")).first()
    assert row["n"] == "Lens 65mm_OD_EYE_VOL" and row["t"] == "1 day, 1:01:01"


def test_png_frames(spark, tmp_path):
    import struct
    import zlib

    from sweepgrid.sources import images

    def png(a):
        chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
        raw = b"".join(b"\0" + row.tobytes() for row in a)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    for i in (2, 10, 1):
        (tmp_path / f"{i}.png").write_bytes(png(np.full((4, 5), i * 10, np.uint8)))
    frames = images.checked_stack(images.scan_frames(spark, str(tmp_path)))
    order = [r["origin"].rsplit("/", 1)[1] for r in frames.orderBy("frame_idx").collect()]
    assert order == ["1.png", "2.png", "10.png"]
    px = images.pixels(frames)
    assert px.count() == 60 and {r["v"] for r in px.where("k = 2").collect()} == {100.0}


def test_posterior_and_phantom_metrics(spark):
    from sweepgrid.plans import surface

    v, f = _sphere(spark)
    got = surface.posterior_metrics(v, f, surface.PosteriorOptions(mode="angle", smooth_rounds=0, radius_limit_mm=100.0))
    assert got["R_mm"] == pytest.approx(12, abs=1e-3) and got["rms_resid_mm"] == pytest.approx(0, abs=1e-3)
    row = surface.phantom_metrics(v.withColumn("seg", F.lit("s")), (1.0, 2.0, 33.0), 30.0, 12.0).first()
    assert row["distance_mm"] == pytest.approx(30, abs=1e-3) and row["radius_err_pct"] == pytest.approx(0, abs=1e-3)


def test_command_line_writes_a_volume(spark, tmp_path):
    from sweepgrid import cli
    from sweepgrid.plans.sweep import SweepOptions, reconstruct

    assert cli.parser().parse_args(["a", "b", "--depth", "40"]).depth == 40.0
    fan = recon.Fan(12.0, 0.0, math.radians(52), 12, 16)
    got = reconstruct(spark, recon.phantom_stack(spark, "ones", 12, 16, 8), fan, SweepOptions(voxel_mm=3.0, registration=False))
    nrrd.write_nrrd(got.voxels, str(tmp_path / "v"), (got.n,) * 3, 3.0, vol_id="v")
    assert nrrd.read_nrrd(spark, str(tmp_path / "v")).count() == got.voxels.count()


def test_stream_of_frames(spark, tmp_path):
    from sweepgrid.streaming.arrivals import frame_summaries

    rows = spark.range(40).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("s").alias("scan_id"), (F.col("id") % 4).cast("int").alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = frame_summaries(stream).writeStream.outputMode("complete").format("memory").queryName("summaries").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("summaries").agg(F.sum("n")).first()[0] == 40


@pytest.mark.parametrize("q", [0.0, 0.02, 0.5, 0.997, 1.0])
def test_percentile_by_narrowing(spark, q):
    from sweepgrid.functions.quantiles import exact_percentile

    rng = np.random.default_rng(4)
    for values in (rng.normal(size=3000), np.round(rng.exponential(size=3000), 1), np.full(50, 2.0), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        assert exact_percentile(df, "v", q, direct=40) == pytest.approx(np.percentile(values, 100 * q))
    heavy = spark.createDataFrame([(0.0, 900), (1.0, 50), (2.0, 50)], "v double, n long")
    assert exact_percentile(heavy, "v", q, "n", direct=1) == pytest.approx(np.percentile(np.repeat([0.0, 1.0, 2.0], [900, 50, 50]), 100 * q))
    assert exact_percentile(df.limit(0), "v", q) is None


def test_few_refuses_many(spark):
    from sweepgrid.functions.session import few

    assert few(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        few(spark.range(6), 5)


def test_fixed_decimals_are_those_of_the_binary_value(spark):
    from sweepgrid.functions.scalars import fixed_text

    rnd = random.Random(6)
    values = [0.125, 0.375, 1.005, 2.675, 1e-9, 0.0, -0.0, -0.001, 0.5, 1.5, 2.5, 0.045, 12345.675, 99.995, 1e15 + 0.5, 3e17, float("nan"), float("inf"), -float("inf")]
    values += [rnd.uniform(-1e4, 1e4) for _ in range(500)] + [round(rnd.uniform(-100, 100), 3) for _ in range(1500)] + [k / 8 for k in range(-80, 80)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        got = [r["t"] for r in df.select(fixed_text(F.col("v"), digits).alias("t")).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_names_are_cleaned(spark):
    from sweepgrid.functions import names

    want = {
        "Lens 24 mm - Radial - OD - Primary - 01-02-2024 - 10-15": "Lens 24mm", "a_Radial_b": "a_Radial_b", "Radial": "", "x - 7MM  y": "x 7mm y", "one _ two": "one_two",
        "12-30 scan 5": "scan 5", "scan12-30": "scan12 30", "radial os PRIMARY z": "z", "A–B—C": "A B C", "  plain  name ": "plain name",
    }
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r["n"]: r["b"] for r in df.select("n", names.clean_base(F.col("n")).alias("b")).collect()} == want
    long = ["10", "9", "-3", "99999999999999999999999", "100000000000000000000000", "007", "b", "a", "-20", "8"]
    got = spark.createDataFrame([(n,) for n in long], "n string").orderBy(*names.numeric_first_key(F.col("n"))).collect()
    assert [r["n"] for r in got] == ["-20", "-3", "007", "8", "9", "10", "99999999999999999999999", "100000000000000000000000", "a", "b"]


def scan(folder, frames=6, side=64):
    """Frames of a cone with one bright arc that turns, and the cone's mask, as PNG files."""
    from sweepgrid.sources import png

    y, x = np.mgrid[0:side, 0:side]
    r, phi = np.hypot(x - 4.0, y - side / 2), np.arctan2(y - side / 2, x - 4.0)
    cone = (r <= side - 10) & (np.abs(phi) <= math.radians(26)) & (x >= 4)
    (folder / "Lens 12 mm - OD").mkdir(parents=True)
    for k in range(frames):
        a = np.where(cone, 60 + 40 * np.sin(k + 6 * phi) + 80 * (np.abs(r - 30) < 3), 0).astype(np.uint8)
        (folder / "Lens 12 mm - OD" / f"{k + 1}.png").write_bytes(png.encode(a))
    (folder / "mask.png").write_bytes(png.encode(np.where(cone, 255, 0).astype(np.uint8)))
    return str(folder / "Lens 12 mm - OD"), str(folder / "mask.png")


def test_command_line_from_frames(spark, tmp_path):
    """From image files to a named volume, twice: the second run takes the next number and the mask's record as it was kept."""
    from sweepgrid import cli
    from sweepgrid.plans.sweep import SweepOptions

    frames, mask = scan(tmp_path / "in")
    out = tmp_path / "out"
    out.mkdir()
    o = SweepOptions(depth_mm=40.0, voxel_mm=8.0, registration=False)
    first = cli.run(spark, frames, mask, str(out), o)
    assert first.endswith("/Lens 12mm_OD_EYE_VOL_r01.nrrd")
    kept = sorted(p for p in (tmp_path / "in" / "mask_detection").rglob("*.json"))
    assert kept and "apex_xy" in kept[0].read_text()
    second = cli.run(spark, frames, mask, str(out), o)
    assert second.endswith("_r02.nrrd")
    assert sorted(p for p in (tmp_path / "in" / "mask_detection").rglob("*.json")) == kept
    assert (out / "Lens 12mm_OD_EYE_VOL_r01.nrrd").read_bytes() == (out / "Lens 12mm_OD_EYE_VOL_r02.nrrd").read_bytes()
    assert sorted(p.name for p in (out / "QC").glob("*.png")) == sorted(["mask.png", "unwrapped_mid.png", *(f"{a}_{b}.png" for a in ("mip", "slice") for b in ("xy", "xz", "yz"))])


def test_command_line_options(spark, tmp_path, capsys):
    """Without the mask's effect, a stack with a known answer, and the table of even and odd frames with its warning."""
    from sweepgrid import cli
    from sweepgrid.plans import qc, sweep
    from sweepgrid.sources import images

    frames, mask = scan(tmp_path / "in")
    o = sweep.SweepOptions(depth_mm=40.0, voxel_mm=8.0, registration=False, apex_search=False)
    cli.run(spark, frames, mask, str(tmp_path / "out"), o, "a", pictures=False, even_odd=True)
    lines = (tmp_path / "out" / "QC" / "even_odd.csv").read_text().splitlines()
    assert lines[0] == "subset,ratio,drift,alarm" and [x.split(",")[0] for x in lines[1:]] == ["all", "even", "odd"]
    assert ("true" in "".join(lines)) == ("axis ratios" in capsys.readouterr().err)

    calib = geometry.calibrate(images.mask_pixels(spark, mask).select("x", "y"), *images.mask_pixels(spark, mask).select("width", "height").first())
    record = geometry.geometry(calib.withColumn("depth_mm", F.lit(40.0))).first().asDict()
    pixels = images.pixels(images.scan_frames(spark, frames))
    on = images.mask_pixels(spark, mask)
    stacks = {name: sweep.unwrapped(spark, pixels, record, o.__class__(**{**o.__dict__, **change}), on)[0] for name, change in (("masked", {}), ("open", {"use_mask": False}), ("ones", {"phantom": "ones"}))}
    assert stacks["ones"].where("v <> 1").isEmpty()
    masked, whole = (stacks[n].where("v <> 0").count() for n in ("masked", "open"))
    assert masked < whole and stacks["masked"].join(stacks["open"], ["k", "r", "p"]).count() == stacks["open"].count()
    args = cli.parser().parse_args(["a", "--no-mask", "--phantom", "radial", "--even-odd", "--slab-size", "8"])
    assert args.no_mask and args.phantom == "radial" and args.even_odd and args.slab_size == 8


def test_even_and_odd_frames_in_one_plan(spark):
    """The same ratios as by resampling each subset alone, whatever the number of frames."""
    from sweepgrid.plans import qc

    fan = recon.Fan(12.0, 0.0, math.radians(52), 12, 16)
    for n in (7, 8):
        _, stack = random_stack(spark, (12, 16, n), n)
        want = {}
        for name, every, first in (("all", 1, 0), ("even", 2, 0), ("odd", 2, 1)):
            sub = stack.where(F.col("k") % every == first).withColumn("k", F.expr(f"cast(k div {every} as int)"))
            voxels = recon.resample(spark, sub, fan, len(range(first, n, every)), 2.0)
            want[name] = volume.axis_ratio(voxels, recon.axis_count(12.0, 2.0) ** 3, least=5).first()["ratio"]
        got = {r["subset"]: r for r in qc.even_odd_ratios(stack, fan, n, 2.0, 5).collect()}
        assert {k: r["ratio"] for k, r in got.items()} == pytest.approx(want)
        assert all(r["drift"] == pytest.approx(abs(want[k] - want["all"])) and r["alarm"] == (r["drift"] > 0.02) for k, r in got.items())


def test_slabs_set_the_tasks(spark):
    fan = recon.Fan(40.0, 0.0, math.radians(52), 12, 16)
    parts = [recon.valid_cells(spark, fan, 1.0, s).rdd.getNumPartitions() for s in (1, 8, 1000)]
    assert parts == [80, 10, spark.sparkContext.defaultParallelism] and recon.valid_cells(spark, fan, 4.0, 8).count() == recon.valid_cells(spark, fan, 4.0).count()


def test_apex_search_takes_the_first_valid_place(spark):
    """Against a plain loop over the 25 places."""
    from sweepgrid.plans.sweep import search_apex

    side, rnd = 40, np.random.default_rng(5)
    img = rnd.integers(0, 255, (side, side)).astype(float)
    pixels = spark.createDataFrame([(k, y, x, float(img[y, x])) for k in range(3) for y in range(side) for x in range(side)], "k int, y int, x int, v double")
    calib = {"apex_x": 6.0, "apex_y": 20.0, "r_max_pix": 30.0, "rows_eff": 24, "dr": 40.0 / 30.0, "phi0": -0.4, "phi1": 0.4, "image_width": side, "image_height": side}
    best = None
    for dx in range(-2, 3):
        for dy in range(-2, 3):
            used = []
            for d in (12, 24, 36):
                r = round(d / calib["dr"])
                if r >= 30:
                    continue
                row = []
                for p in range(24):
                    phi, rho = -0.4 + 0.8 * p / 23, r * 30 / 29
                    sx, sy = 6.0 + dx + rho * math.cos(phi), 20.0 + dy + rho * math.sin(phi)
                    ddx, ddy = sx - 6.0 - dx, sy - 20.0 - dy
                    on = math.hypot(ddx, ddy) <= 30.0 and 0 <= sx <= side - 1 and 0 <= sy <= side - 1
                    x0, y0 = math.floor(sx), math.floor(sy)
                    v = sum(((sx - x0) if a else 1 - (sx - x0)) * ((sy - y0) if b else 1 - (sy - y0)) * (img[y0 + b, x0 + a] if 0 <= y0 + b < side and 0 <= x0 + a < side else 0) for a in (0, 1) for b in (0, 1))
                    row.append(v if on else 0.0)
                g = np.abs(np.gradient(np.array(row)))
                if (g > (0.5 * g.max() if g.max() > 0 else 0)).sum() >= 6:
                    used.append(float(d))
            if len(used) >= 2 and (best is None or np.var(used) < best[0]):
                best = (float(np.var(used)), dx, dy)
    got = search_apex(spark, pixels, calib)
    assert (got["apex_x"], got["apex_y"]) == ((6.0, 20.0) if best is None else (6.0 + best[1], 20.0 + best[2]))
    assert search_apex(spark, pixels.withColumn("v", F.lit(0.0)), calib) == calib


def test_posterior_files(spark, tmp_path):
    v, f = _sphere(spark)
    records.write_surface(v.withColumn("residual_mm", F.lit(0.5)), f, ["residual_mm"], str(tmp_path / "s.vtk"))
    head = (tmp_path / "s.vtk").read_bytes()
    assert f"POINTS {v.count()} float".encode() in head and f"POLYGONS {f.count()} {4 * f.count()}".encode() in head and b"SCALARS residual_mm float 1" in head
    metrics = {"patch": "angle", "apex_mode": "prior", "patch_area_mm2": 1.0, "R_mm": 2.0, "apex_depth_mm": 3.0, "rms_resid_mm": 4.0, "quad_metrics": {"H": 0.5, "anisotropy": 0.1}, "disc_R_equiv_patch_mm": 5.0, "disc_H_trimmed_mean_abs_invmm": 6.0, "apex_point_ras": (7, 8, 9)}
    for older, n in ((False, 16), (True, 12)):
        report = records.posterior_report(spark, metrics, "angle", 1.5, 46.0, 2.5, older)
        records.write_csv(report, str(tmp_path / f"c{n}"))
        back = spark.read.option("header", True).csv(str(tmp_path / f"c{n}")).first()
        assert len(back) == n and back["Angle_deg"] == "46.0" and back["GEO_radius_mm"] is None and back["BFS_radius_mm"] == "2.0" and back["Apex_z_mm"] == "9.0"
    assert report.columns == [c for c in records.POSTERIOR_COLUMNS if c not in records.NEWER_COLUMNS]


def test_configured_run_writes_both_volumes_and_slices(spark, tmp_path):
    from sweepgrid import cli

    frames, mask = scan(tmp_path / "in", frames=4, side=48)
    conf = {"input_dir": frames, "cone_mask": mask, "out_dir": str(tmp_path / "out"), "depth_mm": 40.0, "voxel_mm": 10.0, "do_registration": False,
            "raw": {"interp_order": 1, "bit_depth": 16}, "smooth": {"sigma_theta_deg": 20.0, "interp_order": 1, "bit_depth": 8}, "frames": {"enabled": True, "axis": 2, "basename_raw": "RAW"}}
    made = cli.run_config(spark, conf)
    assert made == {k: str(tmp_path / "out" / f"eye_{k}_10.000mm.nrrd") for k in ("raw", "smooth")}
    for kind, bits in (("raw", 16), ("smooth", 8)):
        _, fields = nrrd.decode((tmp_path / "out" / f"eye_{kind}_10.000mm.nrrd").read_bytes())
        assert fields["sizes"] == "8 8 8" and str(bits) in fields["type"]
    assert sorted(p.name for p in (tmp_path / "out" / "frames_raw").iterdir()) == [f"RAW_{i:04d}.tif" for i in range(8)]
    data = (tmp_path / "out" / "frames_raw" / "RAW_0004.tif").read_bytes()
    assert data[:4] == b"II*\0" and len(data) > 8 * 8 * 2
    assert cli.run_config(spark, conf | {"raw": {"enabled": False}, "frames": {}})["raw"] is None


def test_tiff_bytes():
    import struct

    from sweepgrid.sources import tiff

    a = np.arange(15, dtype=np.uint16).reshape(3, 5) * 999
    data = tiff.encode(a)
    at = struct.unpack_from("<I", data, 4)[0]
    n = struct.unpack_from("<H", data, at)[0]
    tags = {struct.unpack_from("<HHI", data, at + 2 + 12 * i)[0]: struct.unpack_from("<I" if struct.unpack_from("<HHI", data, at + 2 + 12 * i)[1] == 4 else "<H", data, at + 10 + 12 * i)[0] for i in range(n)}
    assert (tags[256], tags[257], tags[258], tags[279]) == (5, 3, 16, 30) and len(data) == at + 2 + 12 * n + 4
    assert (np.frombuffer(data, "<u2", 15, tags[273]).reshape(3, 5) == a).all()


def test_ranks_of_all_rows(spark):
    from sweepgrid.functions.quantiles import ranked

    rnd = random.Random(12)
    rows = [(i, rnd.randrange(40)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r["id"]: r["n"] for r in ranked(df, [-F.col("v"), "id"], "n").collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {i: k + 1 for k, (i, _) in enumerate(want)}
    assert ranked(df.limit(0), ["v"], "n").count() == 0


def random_stack(spark, shape, seed=0, holes=0):
    rng = np.random.default_rng(seed)
    values = rng.normal(0, 1, shape)  # rows, columns, frames
    cells = [(int(k), int(r), int(p), float(v)) for (r, p, k), v in np.ndenumerate(values)]
    gone = set(rng.choice(len(cells), holes, replace=False).tolist())
    for i in gone:
        k, r, p, _ = cells[i]
        values[r, p, k] = 0.0
    return values, spark.createDataFrame([c for i, c in enumerate(cells) if i not in gone], "k int, r int, p int, v double").repartition(3)


@pytest.mark.parametrize("order,holes", [(1, 0), (1, 300), (0, 40), (2, 0), (3, 0), (3, 50), (4, 0), (5, 0)])
def test_tiled_resampling_equals_the_dense_array(spark, order, holes):
    shape = (19, 23, 21)
    values, stack = random_stack(spark, shape, order, holes)
    rng = np.random.default_rng(order + 10)
    at = np.array([rng.uniform(0, n - 1, 400) for n in shape])
    at[:, :8] = np.array([[0.0, n - 1.0] for n in shape])[np.arange(3)[:, None], np.array([[i >> d & 1 for i in range(8)] for d in range(3)])]
    samples = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at.T)], "i int, r_idx double, p_idx double, k_idx double")
    got = {r["i"]: r["v"] for r in recon.spline_sample(samples, stack, shape, ["i"], order).collect()}
    dense = values
    if order >= 3:
        for axis in range(3):
            dense = recon.spline_coefficients(dense, order, axis)
    want = recon.sample_stack(dense, at, order)
    assert [got[i] for i in range(at.shape[1])] == pytest.approx(want.tolist(), abs=1e-9)
    if order >= 3 and not holes:  # the spline goes through its values
        assert recon.sample_stack(dense, np.array([[5.0], [7.0], [9.0]]), order)[0] == pytest.approx(values[5, 7, 9])
    if order == 1:
        lin = {r["i"]: r["v"] for r in recon.trilinear(samples, stack, ["i"]).collect()}
        assert [lin[i] for i in range(at.shape[1])] == pytest.approx(want.tolist(), abs=1e-9)


def test_tiled_resampling_has_no_rows_by_corner(spark):
    _, stack = random_stack(spark, (4, 4, 4))
    samples = spark.range(10).select("id", *(F.lit(1.5).alias(f"{x}_idx") for x in "rpk"))
    plan = recon.trilinear(samples, stack, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Join") == 1  # lines are sent to their tiles, samples are not exploded


def test_registration_by_lots_equals_frame_by_frame(spark):
    values, stack = random_stack(spark, (20, 32, 40), 3)
    for k in range(40):
        values[:, :, k] = np.roll(values[:, :, 20], (k % 3, k % 5), (0, 1)) if k != 20 else values[:, :, 20]
    stack = spark.createDataFrame([(int(k), int(r), int(p), float(v)) for (r, p, k), v in np.ndenumerate(values)], "k int, r int, p int, v double")
    got = {r["k"]: (r["dr"], r["dphi"]) for r in registration.estimate_shifts(stack, 20, 32, 20).collect()}
    roi = values[4:18, 1:30, :]
    for k in range(40):
        assert got[k] == pytest.approx(registration.phase_shift(roi[:, :, 20], roi[:, :, k]), abs=1e-9)


@pytest.mark.parametrize("register,sigma", [(False, 0.0), (True, 20.0)])
def test_many_scans_equal_each_scan_alone(spark, register, sigma):
    from dataclasses import replace

    from sweepgrid.plans import scans as many
    from sweepgrid.plans.sweep import SweepOptions, reconstruct

    o = SweepOptions(voxel_mm=3.0, registration=register, sigma_theta_deg=sigma, blend_frames=2)
    shapes = {"a": (16, 12, 9, 12.0, 50.0), "b": (10, 20, 5, 15.0, 40.0), "c": (12, 12, 14, 10.0, 60.0)}
    rows, table = [], []
    for i, (name, (r, p, k, depth, fan)) in enumerate(shapes.items()):
        values, _ = random_stack(spark, (r, p, k), i)
        rows += [(name, int(z), int(x), int(y), float(v)) for (x, y, z), v in np.ndenumerate(values)]
        table.append((name, r, p, 0.0, math.radians(fan), depth))
    rows.append(("no settings", 0, 0, 0, 1.0))
    stack = spark.createDataFrame(rows, "scan_id string, k int, r int, p int, v double")
    scans = spark.createDataFrame([*table, ("no frames", 4, 4, 0.0, 1.0, 9.0)], "scan_id string, rows int, cols int, phi0 double, phi1 double, depth double")
    got = many.reconstruct(stack, scans, o)
    cuts = {r["scan_id"]: r["cut"] for r in got.scans.collect()}
    found = {(r["scan_id"], r["ix"], r["iy"], r["iz"]): r["v"] for r in got.voxels.collect()}
    want = {}
    for name, (r, p, _, depth, fan) in shapes.items():
        one = reconstruct(spark, stack.where(F.col("scan_id") == name).drop("scan_id"), recon.Fan(depth, 0.0, math.radians(fan), r, p), replace(o, depth_mm=depth))
        assert cuts[name] == one.cut
        want |= {(name, x["ix"], x["iy"], x["iz"]): x["v"] for x in one.voxels.collect()}
    assert set(cuts) == set(shapes) and found == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("shape,edge", [((7, 9, 8), 3), ((5, 4, 11), 2), ((6, 6, 6), 24)])
def test_stencils_over_blocks_equal_the_whole_array(spark, monkeypatch, shape, edge):
    """Blocks of any size, also where the last one is larger, against plain loops over the padded volume."""
    from sweepgrid.operators import blocks

    monkeypatch.setattr(blocks, "EDGE", edge)
    rng = np.random.default_rng(4)
    v = np.where(rng.random(shape) < 0.6, rng.normal(0, 3, shape), 0.0)
    voxels = spark.createDataFrame([(*(int(a) for a in i), float(x)) for i, x in np.ndenumerate(v) if x], "ix int, iy int, iz int, v double")
    as_array = lambda df: {(r["ix"], r["iy"], r["iz"]): r["v"] for r in df.collect()}

    def around(a, f, reach=1):
        p = np.pad(a, reach, mode="edge")
        return {tuple(map(int, i)): float(f(p[tuple(slice(j, j + 2 * reach + 1) for j in i)])) for i in np.ndindex(*a.shape)}

    assert as_array(volume.median_filter(voxels, shape)) == pytest.approx(around(v, np.median))
    assert as_array(volume.median_filter(voxels, shape, 2)) == pytest.approx(around(v, np.median, 2))
    length = lambda w: math.sqrt(sum(x * x for x in ((w[2, 1, 1] - w[0, 1, 1]) / 1.0, (w[1, 2, 1] - w[1, 0, 1]) / 2.0, (w[1, 1, 2] - w[1, 1, 0]) / 4.0)))
    assert as_array(volume.gradient_magnitude(voxels, shape, (0.5, 1.0, 2.0))) == pytest.approx(around(v, length))
    wide = np.zeros(shape)
    for i, x in around((v > 2).astype(float), np.max).items():
        wide[i] = x
    want = {i for i, x in around(wide, np.min).items() if x}
    assert {(r["ix"], r["iy"], r["iz"]) for r in volume.binary_closing(voxels.where("v > 2"), shape).collect()} == want


def test_diffusion_equals_plain_loops(spark, monkeypatch):
    from sweepgrid.operators import blocks

    monkeypatch.setattr(blocks, "EDGE", 3)
    shape, now = (7, 5, 6), np.random.default_rng(6).normal(0, 1, (7, 5, 6))
    voxels = spark.createDataFrame([(*(int(a) for a in i), float(x)) for i, x in np.ndenumerate(now)], "ix int, iy int, iz int, v double")
    for _ in range(3):
        p, flow, size2 = np.pad(now, 1, mode="edge"), np.zeros(shape), np.zeros(shape)
        for i in np.ndindex(*shape):
            w = p[tuple(slice(j, j + 3) for j in i)]
            dx, dy, dz = (w[2, 1, 1] - w[0, 1, 1]) / 2, (w[1, 2, 1] - w[1, 0, 1]) / 2, (w[1, 1, 2] - w[1, 1, 0]) / 2
            xx, yy, zz = w[2, 1, 1] - 2 * w[1, 1, 1] + w[0, 1, 1], w[1, 2, 1] - 2 * w[1, 1, 1] + w[1, 0, 1], w[1, 1, 2] - 2 * w[1, 1, 1] + w[1, 1, 0]
            xy, xz, yz = (w[2, 2, 1] - w[2, 0, 1] - w[0, 2, 1] + w[0, 0, 1]) / 4, (w[2, 1, 2] - w[2, 1, 0] - w[0, 1, 2] + w[0, 1, 0]) / 4, (w[1, 2, 2] - w[1, 2, 0] - w[1, 0, 2] + w[1, 0, 0]) / 4
            size2[i] = dx**2 + dy**2 + dz**2
            bend = xx * (dy**2 + dz**2) + yy * (dx**2 + dz**2) + zz * (dx**2 + dy**2) - 2 * (dx * dy * xy + dx * dz * xz + dy * dz * yz)
            flow[i] = bend / size2[i] if size2[i] > 1e-12 else 0.0
        now = now + 0.05 * np.exp(-size2 / (2 * 1.5**2 * size2.mean())) * flow
    got = {(r["ix"], r["iy"], r["iz"]): r["v"] for r in volume.curvature_diffusion(voxels, shape, 3, 1.5, 0.05).collect()}
    assert got == pytest.approx({tuple(map(int, i)): float(x) for i, x in np.ndenumerate(now)})


@pytest.mark.parametrize("direct", [5, 1_000_000])
def test_percentiles_of_all_groups_together(spark, direct):
    """Groups of every size and kind of values, a null group among them, narrowed to a few rows or not at all."""
    from sweepgrid.functions.quantiles import percentiles_by

    rng = np.random.default_rng(11)
    groups = {"normal": rng.normal(0, 1, 700), "ties": np.round(rng.exponential(size=500), 1), "one": np.array([3.5]), "same": np.full(60, 2.0), "two": np.array([1.0, 5.0]), None: rng.uniform(-1, 1, 300)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    at = [0.0, 0.01, 0.5, 0.997, 1.0]
    got = {r["g"]: r["p"] for r in percentiles_by(df, "v", at, ["g"], direct=direct).collect()}
    assert got == {g: pytest.approx(np.percentile(xs, [100 * q for q in at]).tolist()) for g, xs in groups.items()}
    heavy = spark.createDataFrame([("a", 0.0, 900), ("a", 1.0, 50), ("a", 2.0, 50), ("b", 7.0, 3)], "g string, v double, n long")
    got = {r["g"]: r["p"] for r in percentiles_by(heavy, "v", at, ["g"], "n", direct=1).collect()}
    assert got == {"a": pytest.approx(np.percentile(np.repeat([0.0, 1.0, 2.0], [900, 50, 50]), [100 * q for q in at]).tolist()), "b": [7.0] * 5}
    assert percentiles_by(df, "v", [0.5], []).first()["p"][0] == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def plain_distances(links, seeds):
    best, heap = dict.fromkeys(seeds, 0.0), [(0.0, s) for s in seeds]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for v, w in links.get(u, ()):
            if d + w < best.get(v, math.inf):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


@pytest.mark.parametrize("size", [40, 10_000])
def test_geodesic_by_parts_equals_a_plain_search(spark, size, monkeypatch):
    """A bumpy sheet of 12 x 12 vertices with a wall that ways must go around, and a piece that nothing reaches."""
    rng, n = random.Random(5), 12
    at = {i * n + j: (float(i), float(j), rng.choice([0.0, 0.5, 3.0])) for i in range(n) for j in range(n)} | {900: (99.0, 0.0, 0.0), 901: (99.0, 1.0, 0.0), 902: (98.0, 0.0, 0.0), -7: (2.0, 2.0, 2.0)}
    tri = [t for i in range(n - 1) for j in range(n - 1) if not (i == 5 and j > 0) for a in [i * n + j] for t in ((a, a + n, a + 1), (a + 1, a + n, a + n + 1))] + [(900, 901, 902)]
    v = spark.createDataFrame([(k, *p) for k, p in at.items()], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, *t) for i, t in enumerate(tri)], "fid long, v0 long, v1 long, v2 long")
    links = {}
    for t in tri:
        for a in t:
            links.setdefault(a, []).extend((b, math.dist(at[a], at[b])) for b in t if b != a)
    for seeds in ([n * n - 1], [0, 7, 7, n * n - 1], [])[: 3 if size == 40 else 1]:
        cuts = []
        monkeypatch.setattr(graph, "cut", lambda df: cuts.append(0) or df.checkpoint())
        got = mesh.geodesic(f, v, spark.createDataFrame([(s,) for s in seeds], "vid long"), size)
        want = plain_distances(links, set(seeds))
        assert {r["vid"]: r["d"] for r in got.collect()} == pytest.approx(want, abs=1e-9)
        assert len(cuts) <= (3 if size > len(at) else 16)


def test_space_parts_are_of_one_size(spark):
    rows = [(i, 0.0 if i < 60 else float(i), 1.0, None if i == 3 else 2.0) for i in range(100)]
    got = graph.space_parts(spark.createDataFrame(rows, "vid long, x double, y double, z double"), "xyz", 30)
    assert sorted(r["count"] for r in got.groupBy("part").count().collect()) == [10, 30, 30, 30]
    assert graph.space_parts(spark.createDataFrame([], "vid long, x double, y double, z double"), "xyz").count() == 0


def test_geodesic_rounds_grow_with_the_parts_of_a_long_sheet(spark, monkeypatch):
    """600 x 4 vertices with rough heights in parts of 300: about a round a part, though ways cross the middle of the sheet all the time."""
    rng, n, m = random.Random(7), 600, 4
    at = {i * m + j: (float(i), float(j), rng.gauss(0, 0.5)) for i in range(n) for j in range(m)}
    tri = [t for i in range(n - 1) for j in range(m - 1) for a in [i * m + j] for t in ((a, a + m, a + 1), (a + 1, a + m, a + m + 1))]
    v = spark.createDataFrame([(k, *p) for k, p in at.items()], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, *t) for i, t in enumerate(tri)], "fid long, v0 long, v1 long, v2 long")
    links, cuts = {}, []
    for t in tri:
        for a in t:
            links.setdefault(a, []).extend((b, math.dist(at[a], at[b])) for b in t if b != a)
    monkeypatch.setattr(graph, "afresh", lambda df: cuts.append(0) or session.afresh(df))
    got = mesh.geodesic(f, v, spark.createDataFrame([(0,)], "vid long"), 300)
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40  # was a number of 2 ** rounds digits
    assert {r["vid"]: r["d"] for r in got.collect()} == pytest.approx(plain_distances(links, {0}), abs=1e-9)
    assert 8 <= len(cuts) <= 2 * 8


@pytest.mark.parametrize("size", [37, 1_000_000])
def test_increasing_over_ranges_equals_the_fold(spark, size):
    """One series with most rows, some of one row, nulls and a null key; ties and falls in all of them."""
    rng, rows = random.Random(8), []
    for i in range(600):
        key = rng.choice([1, 1, 1, 1, 1, 2, 3, None] if i else [9])
        rows.append((key, i, rng.choice([None, 0.25, 0.5, 3.0, 7.5, 0.01 * i, 0.5 * (i // 50) + 0.125])))
    want, state = {}, {}
    for key, i, x in rows:
        n, last = state.get(key, (0, None))
        y = None if x is None else x if last is None or x > last else last + 0.125
        state[key] = n + 1, last if x is None else y
        want[i] = (n, y)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s long, t long, x double").repartition(3)
    got = scans.increasing(df, "x", ["s"], ["t"], "y", "n", 0.125, size)
    assert got.columns == ["s", "t", "x", "y", "n"]
    assert {r["t"]: (r["n"], r["y"]) for r in got.collect()} == {i: (n, y if y is None else pytest.approx(y)) for i, (n, y) in want.items()}
    assert scans.increasing(df.limit(0), "x", ["s"], ["t"], "y", "n").count() == 0


def test_running_sum_over_ranges(spark):
    rows = [(i, None if i % 11 == 0 else float(i % 7)) for i in range(300)]
    got = scans.running_sum(spark.createDataFrame(rows, "i long, x double").repartition(4), "x", ["i"], "s", 40)
    want, total = {}, 0.0
    for i, x in rows:
        total += x or 0.0
        want[i] = total
    assert {r["i"]: r["s"] for r in got.collect()} == want


@pytest.mark.parametrize("size", [700, 1_000_000])
def test_running_sum_has_no_rounding_of_each_row(spark, size):
    """Equal to sums without rounding error, to the last bit, where adding row by row is off by a sixth decimal; infinities pass."""
    rows = [(i, None if i % 501 == 7 else 1e9 if i == 0 else 0.1 * (i % 13)) for i in range(5_000)]
    got = scans.running_sum(spark.createDataFrame(rows, "i long, x double").repartition(4), "x", ["i"], "s", size)
    assert got.columns == ["i", "x", "s"]
    found, exact, plain = {r["i"]: r["s"] for r in got.collect()}, Fraction(), 0.0
    for i, x in rows:
        exact, plain = exact + Fraction(x or 0.0), plain + (x or 0.0)
        assert found[i] == float(exact)
    assert abs(plain - float(exact)) > 1e-6
    odd = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, math.inf, 2.0, -math.inf, 3.0])], "i long, x double")
    assert [repr(r["x"]) for r in scans.running_sum(odd, "x", ["i"], "x", 2).orderBy("i").collect()] == ["1.0", "inf", "inf", "nan", "nan"]
    assert scans.running_sum(odd.limit(0), "x", ["i"], "s").count() == 0


def test_nearest_vertex_equals_all_pairs(spark):
    """Crowded points, copies of one place, ties on a lattice, one far outlier; fiducials inside, outside, at points and nowhere."""
    rng = random.Random(3)
    pts = [(i, float(i % 5), float(i // 5 % 5), float(i // 25)) for i in range(100)] + [(200 + i, 2.0 + rng.gauss(0, 1e-3), 2.0, 2.0) for i in range(60)]
    pts += [(300 + i, 9.0, 9.0, 9.0) for i in range(30)] + [(400, 1e6, 0.0, 0.0)]
    odd = [(500, None, 0.0, 0.0), (501, math.nan, 0.0, 0.0), (None, 0.1, 0.1, 0.1)]
    fid = [(f"f{i}", rng.uniform(-2, 11), rng.uniform(-2, 6), rng.uniform(-2, 6)) for i in range(40)] + [("tie", 1.5, 1.5, 1.5), ("copy", 9.0, 9.0, 9.1), ("far", 4e5, 7.0, -3.0), ("none", None, 0.0, 0.0)]
    p = spark.createDataFrame(pts + odd, "vid long, x double, y double, z double")
    f = spark.createDataFrame(fid, "name string, fx double, fy double, fz double")
    want = {n: min((math.dist(q[1:], xyz), q[0]) for q in pts) for n, *xyz in fid[:-1]}
    got = {r["name"]: (r["d"], r["vid"]) for r in pointcloud.nearest_vertex(p, f, 4).collect()}
    assert {n: v for n, (_, v) in got.items()} == {n: v for n, (_, v) in want.items()}
    assert {n: d for n, (d, _) in got.items()} == pytest.approx({n: d for n, (d, _) in want.items()})
    assert pointcloud.nearest_vertex(p.limit(0), f).count() == 0


@pytest.mark.parametrize("radius", [0, 5])
def test_window_counts_equal_all_pairs(spark, radius):
    rng = random.Random(4)
    cells = sorted({tuple(rng.randrange(20) for _ in range(3)) for _ in range(700)})
    tries = [(i, rng.randrange(-8, 27), rng.randrange(20), rng.randrange(20)) for i in range(30)] + [(99, *cells[0])]
    got = volume.window_counts(spark.createDataFrame(cells, "ix int, iy int, iz int"), spark.createDataFrame(tries, "cid long, ix int, iy int, iz int"), radius)
    want = {c: sum(all(abs(a - b) <= radius for a, b in zip(p, at)) for p in cells) for c, *at in tries}
    assert {r["cid"]: r["n"] for r in got.collect()} == want


def plain_sets(cells, near):
    left, sets = set(cells), []
    while left:
        todo, got = [left.pop()], set()
        while todo:
            c = todo.pop()
            got.add(c)
            found = {(c[0] + a, c[1] + b) for a, b in near} & left
            left -= found
            todo.extend(found)
        sets.append(got)
    return sets


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def test_components_by_runs_equal_flood_filling(spark):
    rng = random.Random(6)
    cells = sorted({(rng.randrange(30), rng.randrange(25)) for _ in range(330)})
    df = spark.createDataFrame(cells, "y int, x int").repartition(3)
    for near, diagonal in ((FOUR, False), (EIGHT, True)):
        want = {c: min(y * 25 + x for y, x in part) for part in plain_sets(cells, near) for c in part}
        assert {(r["y"], r["x"]): r["label"] for r in graph.grid_components(df, ["y", "x"], [30, 25], diagonal).collect()} == want


def test_outer_contours_by_hand(spark):
    """A ring with a dot in its hole, a small square, a line, a diagonal, and a cell at the image's edge."""
    ring = {(x, y) for x in range(1, 8) for y in range(1, 8) if x in (1, 7) or y in (1, 7)}
    shapes = [ring | {(4, 4)}, {(10, 1), (11, 1), (10, 2), (11, 2)}, {(10, 5), (11, 5), (12, 5)}, {(14, 1), (15, 2), (16, 3)}, {(0, 11)}, {(10, 8), (11, 8), (10, 9)}]
    areas, rims = [36.0, 1.0, 0.0, 0.0, 0.0, 0.5], [ring, *shapes[1:]]
    mask = spark.createDataFrame(sorted(set().union(*shapes)), "x int, y int")
    got = {}
    for r in geometry.outer_contours(mask, 17, 12).collect():
        got.setdefault((r["label"], r["area"]), set()).add((r["x"], r["y"]))
    assert got == {(min(y * 17 + x for x, y in rim), a): rim for rim, a in zip(rims, areas, strict=True)}
    assert {tuple(r) for r in geometry.main_contour(mask, 17, 12).collect()} == ring
    assert geometry.outer_contours(mask.limit(0), 17, 12).count() == 0


def test_outer_contours_of_all_vectors_by_flood_filling(spark, sf_dir):
    """The query's rows against plain flood filling of the same image."""
    from sweepgrid.queries import QUERIES
    from sweepgrid.queries.carriers import frames, polar

    stack = polar(spark, sf_dir)
    high, wide = frames(stack) * 16, 64
    on = {(r["p"], r["k"] * 16 + r["r"]) for r in stack.where("v > 0.17").select("k", "r", "p").collect()}
    whole = {(x, y) for x in range(-1, wide + 1) for y in range(-1, high + 1)}
    outside = next(s for s in plain_sets(whole - on, FOUR) if (-1, -1) in s)
    want = {}
    for part in plain_sets(whole - outside, EIGHT):
        squares = {(x - a, y - b) for x, y in part for a in (0, 1) for b in (0, 1)}
        area = sum({4: 1.0, 3: 0.5}.get(sum((x + a, y + b) in part for a in (0, 1) for b in (0, 1)), 0.0) for x, y in squares)
        rim = sum(any((x + a, y + b) in outside for a, b in FOUR) for x, y in part)
        want[min(y * wide + x for x, y in part)] = (rim, area)
    assert {r["label"]: (r["cells"], r["area"]) for r in QUERIES["outer_contours"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize(("n", "sigma", "block"), [(7, 3.0, 1024), (50, 1.5, 16), (300, 30.0, 8), (300, 2.0, 40)])
def test_gaussian_by_blocks_equals_a_plain_sum(spark, monkeypatch, n, sigma, block):
    """Radii beyond the circle, blocks that do not divide it, many taps; an absent frame and a null."""
    monkeypatch.setattr(recon, "BLOCK", block)
    rng = random.Random(n)
    rows = [(k, r, p, None if (k, r) == (1, 1) else rng.random()) for k in range(n) for r in range(2) for p in (0, 3, 17) if k != 4]
    want = {}
    for k, r, p, v in rows:
        for o, w in recon.gaussian_weights(sigma):
            at = ((k + o) % n, r, p)
            want[at] = want.get(at, 0.0) + w * (v or 0.0)
    got = recon.gaussian_theta(spark.createDataFrame(rows, "k int, r int, p int, v double"), n, sigma)
    assert got.dtypes == [("k", "int"), ("r", "int"), ("p", "int"), ("v", "double")]
    assert {(x["k"], x["r"], x["p"]): x["v"] for x in got.collect()} == pytest.approx(want, abs=1e-12)


def test_gaussian_sends_no_row_for_each_tap(spark):
    stack = spark.range(4000).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("r"), F.lit(0).alias("p"), F.rand(1).alias("v"))
    got = recon.gaussian_theta(stack, 4000, 100.0)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "FlatMapGroupsInArrow" in text and "partial_sum" not in text


def test_radius_stats_leave_points_where_they_are(spark):
    """Nothing is shuffled by segment but partial sums, even where the planner would not broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("a", 0.0, 0.0, 0.0), ("a", 2.0, 0.0, 0.0), ("b", 5.0, 1.0, 1.0), (None, 9.0, 9.0, 9.0)]
        got = pointcloud.radius_stats(spark.createDataFrame(rows, "seg string, x double, y double, z double"))
        found = {r["seg"]: r for r in got.collect()}
        text = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.keys() == {"a", "b"} and found["a"]["n"] == 2 and found["a"]["mean_r"] == 1.0 and found["a"]["band_pct"] == 100.0 and found["b"]["std_r"] == 0.0
    assert text.count("BroadcastHashJoin") >= 2


def test_shifts_of_frames_equal_the_steps_one_by_one(spark):
    """Both moves of a frame at once give what the joins give, also where pixels or values are missing; a frame travels once."""
    rows = [(k, r, p, None if (k + r + p) % 11 == 3 else float(r * r + 3 * p + k)) for k in range(4) for r in range(6) for p in range(8) if (k, r, p) not in {(0, 2, 3), (1, 0, 0), (1, 0, 1), (1, 5, 7)}]
    stack = spark.createDataFrame(rows, "k int, r int, p int, v double").withColumn("scan_id", F.col("k") % 2)
    shifts = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 1, 0.4, -2.7), (0, 2, -1.25, 3.5), (1, 3, 7.0, 0.0004)], "scan_id int, k int, dr double, dphi double")
    for by in ((), ("scan_id",)):
        got = registration.apply_shifts(stack, shifts, 6, 8, by=by)
        whole = F.bround("dphi", 0).cast("int")
        rolled = stack.join(shifts, ["scan_id", "k"]).withColumns({"p": F.pmod(F.col("p") + whole, F.lit(8)).cast("int"), "f": F.when(F.abs(F.col("dphi") - whole) > 1e-3, F.col("dphi") - whole).otherwise(0.0)})
        turned = registration.shift_columns(rolled, F.col("f"), 8, by).join(shifts.select("k", "dr"), "k")
        want = registration.shift_rows(turned, F.col("dr"), 6, by)
        columns = [*by, "k", "r", "p", "v"]
        assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
        assert dict(got.dtypes) == dict(want.dtypes)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_knots_are_not_in_the_plan(spark):
    """A sweep of many frames: positions equal the array's, and the plan has no literal for each frame."""
    n = 3000
    knots = [2 * math.pi * k / n + 1e-4 * math.sin(k) + 1e-4 for k in range(n)]
    fan = recon.Fan(20.0, 0.0, math.radians(52.0), 16, 64)
    cells = spark.createDataFrame([(1.0, 0.1, x) for x in [0.0, 1e-4, knots[1], knots[-1], 6.2831, *(0.013 * i for i in range(480))]], "r_mm double, phi double, psi double")
    got = recon.sample_positions(cells, fan, knots)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 20_000
    span = knots[-1] - knots[0]
    padded = [knots[-1] - span, *knots, knots[0] + span]
    theta = F.least(F.greatest(F.col("psi") / (2 * math.pi) * span + knots[0], F.lit(padded[0])), F.lit(padded[-1]))
    array = spark.createDataFrame([(padded,)], "a array<double>")
    want = cells.crossJoin(array).select("psi", F.least(recon.interp_knots(theta, F.col("a"), len(padded)), F.lit(n + 1 - 1e-6)).alias("k"))
    assert sorted(tuple(r) for r in got.select("psi", "k_idx").collect()) == sorted(tuple(r) for r in want.collect())


def test_knots_of_many_frames_fold_rows(spark):
    """As the array's fold, on drifts that put many angles out of order."""
    sweep = spark.range(400).select(F.col("id").cast("int").alias("k"), (F.pmod(F.col("id") * 37, F.lit(23)) - 11.0).alias("dphi"))
    rows = [r["theta"] for r in seam.rebuild_knots(sweep, 0.01, 2 * math.pi).orderBy("k").collect()]
    assert rows == seam.knot_arrays(sweep, 0.01, 2 * math.pi).first()["knots"] and all(a < b for a, b in zip(rows, rows[1:], strict=False))
