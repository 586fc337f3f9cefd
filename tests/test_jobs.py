"""The jobs: their queries against SQL, reruns, growing input, and failures half way."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, page_catalogue, registered, scan_volumes

from .conftest import DATA, ROOT


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_job_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(registered.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = registered.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def rows_of(df):
    return sorted(map(repr, (sorted(r.asDict().items()) for r in df.collect())))


def test_volumes_of_new_scans_leave_the_others(spark, tmp_path):
    """A run over some scans and one over the rest give what one run over all gives; a repeated run changes nothing."""
    every = spark.read.parquet(f"{DATA}/embeddings.parquet")
    small = {"frames_per_scan": 6, "depths_mm": [8.0, 9.0], "voxel_mm": 2.0, "registration": True, "slab_size": 3}
    parts = {"some": every.where("vec_id < 96"), "rest": every.where("vec_id >= 96 AND vec_id < 230"), "all": every.where("vec_id < 230")}
    for name, df in parts.items():
        df.write.parquet(f"{tmp_path}/{name}")
    made = {}
    for name, inputs in {"split": ["some", "rest"], "whole": ["all"], "again": ["all", "all", "some"]}.items():
        for i in inputs:
            got = scan_volumes.run(spark, f"{tmp_path}/{i}", f"{tmp_path}/{name}-v", f"{tmp_path}/{name}-r", **small)
            assert got["vectors"] == parts[i].count()
        made[name] = rows_of(spark.read.parquet(f"{tmp_path}/{name}-v")), rows_of(spark.read.parquet(f"{tmp_path}/{name}-r"))
    assert made["split"] == made["whole"] == made["again"] and got["scans"] == 1 and len(made["whole"][1]) == 3


def test_small_partitions_are_written_by_many_tasks(spark, tmp_path):
    """A partition of a few rows costs a file; folders are dealt out to tasks by their number, however few bytes they hold."""
    spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 230").write.parquet(f"{tmp_path}/in")
    made = scan_volumes.run(spark, f"{tmp_path}/in", f"{tmp_path}/v", f"{tmp_path}/r", frames_per_scan=2, depths_mm=[8.0], voxel_mm=2.0, registration=False, slab_size=3)
    for out, folders in ("r", made["scans"]), ("v", made["scans"] + 1):
        files = [f for _, _, names in os.walk(tmp_path / out) for f in names if f.startswith("part-")]
        assert len(files) >= folders >= 8 and len({f.split("-")[1] for f in files}) > 1


def test_volumes_of_hard_rows(spark, tmp_path):
    """Missing vectors and values count 0, a row without an id is left out, no rows give nothing."""
    rows = [(0, [1.0, 2.0, None, 4.0], 1), (1, None, None), (5, [1.0, 1.0, 1.0, 1.0], 0), (None, [9.0], 0), (7, [2.0], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/in")
    got = scan_volumes.run(spark, f"{tmp_path}/in", f"{tmp_path}/v", f"{tmp_path}/r", vectors_per_frame=2, frames_per_scan=4, depths_mm=[4.0], voxel_mm=0.5, registration=False)
    assert got["vectors"] == 4 and got["scans"] == 1
    assert spark.read.parquet(f"{tmp_path}/v").where("v IS NULL OR isnan(v)").isEmpty()
    coarse = scan_volumes.run(spark, f"{tmp_path}/in", f"{tmp_path}/cv", f"{tmp_path}/cr", vectors_per_frame=2, frames_per_scan=4, depths_mm=[4.0], voxel_mm=2.0, registration=False)
    assert coarse["voxels"] == 0 and coarse["scans"] == 1 and spark.read.parquet(f"{tmp_path}/cr").first()["cells"] is None
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none")
    assert scan_volumes.run(spark, f"{tmp_path}/none", f"{tmp_path}/v", f"{tmp_path}/r")["voxels"] == 0
    assert spark.read.parquet(f"{tmp_path}/v").count() > 0


@pytest.fixture
def growing(tmp_path):
    """A folder to which files of pages are copied, one after the other."""
    con = duckdb.connect()
    os.makedirs(tmp_path / "ready")
    os.makedirs(tmp_path / "in")
    pages = f"SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN 'the same' WHEN page_id % 31 = 0 THEN NULL ELSE html END AS html FROM read_parquet('{DATA}/pages.parquet')"
    for i in range(3):
        con.execute(f"COPY (SELECT * FROM ({pages}) WHERE page_id % 3 = {2 - i}) TO '{tmp_path}/ready/{i}.parquet' (FORMAT parquet)")
    return lambda i: shutil.copy(tmp_path / "ready" / f"{i}.parquet", tmp_path / "in" / f"{i}.parquet")


def catalogue(spark, at):
    return page_catalogue.catalogue_of(spark, f"{at}/catalogue")


def take(spark, at):
    return page_catalogue.run(spark, f"{at}/in", f"{at}/catalogue", f"{at}/hosts", f"{at}/checkpoint")


def check(spark, at):
    """Each content is new once, later pages point at the first batch's smallest page, and hosts add up."""
    rows = [r.asDict() for r in catalogue(spark, at).collect()]
    by = {}
    for r in rows:
        by.setdefault(r["digest"], []).append(r)
    for same in by.values():
        first = min((r["batch"], r["page_id"]) for r in same)[1]
        assert all(r["first_id"] == first and r["is_new"] == (r["page_id"] == first) for r in same)
    hosts = {r["host"]: (r["pages"], r["new_contents"], r["n_bytes"]) for r in spark.read.parquet(f"{at}/hosts").collect()}
    want = {h: (sum(1 for r in rows if r["host"] == h), sum(r["is_new"] for r in rows if r["host"] == h), sum(r["n_bytes"] for r in rows if r["host"] == h)) for h in {r["host"] for r in rows}}
    assert hosts == want
    return rows


def test_catalogue_takes_only_what_is_new(spark, tmp_path, growing):
    growing(0)
    first = take(spark, tmp_path)
    before = rows_of(catalogue(spark, tmp_path))
    assert first["batches"] == 1 and first["pages"] == len(before) == len(check(spark, tmp_path))
    assert take(spark, tmp_path) == {"batches": 0, "pages": 0} and rows_of(catalogue(spark, tmp_path)) == before
    growing(1)
    growing(2)
    second = take(spark, tmp_path)
    after = check(spark, tmp_path)
    assert second["batches"] == 1 and len(after) == first["pages"] + second["pages"] == len({r["page_id"] for r in after}) == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert set(before) < set(rows_of(catalogue(spark, tmp_path)))  # what was told is not told again
    assert any(r["batch"] > 0 and not r["is_new"] and r["digest"] == page_digest(spark, "the same") for r in after)


def page_digest(spark, text):
    return spark.range(1).select(F.substring(F.sha1(F.lit(text).cast("binary")), 1, 12)).first()[0]


@pytest.mark.parametrize("where", ["add_batch", "update_hosts"])
def test_catalogue_goes_on_after_a_failure(spark, tmp_path, growing, monkeypatch, where):
    """A batch that fails after it has written is taken again and replaces what it wrote."""
    growing(0)
    take(spark, tmp_path)
    growing(1)
    real = getattr(page_catalogue, where)

    def fails(*a):
        real(*a)
        raise RuntimeError("lost")

    monkeypatch.setattr(page_catalogue, where, fails)
    with pytest.raises(Exception, match="lost"):
        take(spark, tmp_path)
    monkeypatch.setattr(page_catalogue, where, real)
    growing(2)  # arrives before the batch is taken again
    take(spark, tmp_path)
    rows = check(spark, tmp_path)
    assert len(rows) == len({r["page_id"] for r in rows}) == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 3}))
    assert common.read_json(spark, str(tmp_path / "c.json"), page_catalogue.DEFAULTS) == {"buckets": 3}
    (tmp_path / "c.json").write_text(json.dumps({"bucket": 3}))
    with pytest.raises(ValueError, match="bucket"):
        common.read_json(spark, str(tmp_path / "c.json"), page_catalogue.DEFAULTS)
    for job in ("scan_volumes", "page_catalogue"):
        defaults = {"scan_volumes": scan_volumes, "page_catalogue": page_catalogue}[job].DEFAULTS
        assert json.load(open(f"{ROOT}/jobs/{job}.json", encoding="utf-8")) == defaults


def test_command_line(tmp_path, growing):
    growing(0)
    paths = {"pages": "in", "catalogue": "catalogue", "hosts": "hosts", "checkpoint": "checkpoint"}
    args = [x for k, v in paths.items() for x in (f"--{k}", f"{tmp_path}/{v}")]
    done = subprocess.run([sys.executable, "-m", "jobs.page_catalogue", *args, "--config", f"{ROOT}/jobs/page_catalogue.json"], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0 and "took" in done.stderr, done.stderr[-2000:]
    assert duckdb.connect().execute(f"SELECT count(*) FROM read_parquet('{tmp_path}/catalogue/*/*/*.parquet')").fetchone()[0] > 0
