"""NRRD volumes as a Spark data source: ``spark.read.format("nrrd")``, and ``write_nrrd``.

Reading gives (vol_id, ix, iy, iz, v). A volume is one file, which tasks write and read by segments of its cells: each
segment is compressed by itself and ends on a byte, all follow each other in one gzip stream that any reader
takes, and the header says where each begins. A compressed file of another program is read by one task.
"""

from __future__ import annotations

import gzip
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.session import cut

SCHEMA = "vol_id string, ix int, iy int, iz int, v double"
#: Names of the format's sample types.
KINDS = {"float": "<f4", "double": "<f8", "uint8": "u1", "unsigned char": "u1", "uchar": "u1", "uint16": "<u2", "unsigned short": "<u2", "ushort": "<u2", "int16": "<i2", "short": "<i2"}


#: Cells of a segment, which is what one task holds.
SEGMENT = 1 << 18
#: The header's key for cells of a segment and bytes of each, and the fixed start of a gzip stream.
INDEX, GZIP = "sweepgrid segments", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"


def header(kind: str, sizes: tuple[int, ...], spacing: tuple[float, ...], origin: tuple[float, ...], compress: bool, index: str = "") -> bytes:
    """The header of a volume, with the blank line that ends it."""
    n = sizes
    head = ["NRRD0004", f"type: {kind}", "dimension: 3", "space: left-posterior-superior", f"sizes: {n[0]} {n[1]} {n[2]}", f"space directions: ({spacing[0]},0,0) (0,{spacing[1]},0) (0,0,{spacing[2]})"]
    head += ["kinds: domain domain domain", "endian: little", f"encoding: {'gzip' if compress else 'raw'}", f"space origin: ({origin[0]},{origin[1]},{origin[2]})"]
    return ("\n".join(head + ([f"{INDEX}:={index}"] if index else [])) + "\n\n").encode()


def encode(values: np.ndarray, spacing: tuple[float, float, float], origin: tuple[float, float, float], compress: bool = True) -> bytes:
    """An array indexed (x, y, z) as an NRRD file, the first axis fastest."""
    kind = {"float32": "float", "float64": "double", "uint8": "uint8", "uint16": "uint16"}[values.dtype.name]
    body = np.ascontiguousarray(values.T.astype(values.dtype.newbyteorder("<"))).tobytes()
    return header(kind, values.shape, spacing, origin, compress) + (gzip.compress(body, 6, mtime=0) if compress else body)


def deflated(raw: bytes) -> bytes:
    """raw as a piece of a deflate stream that ends on a byte and needs nothing of what stands before it."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush(zlib.Z_FULL_FLUSH)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def joined_crc(first: int, second: int, n: int) -> int:
    """CRC-32 of two pieces, the second of n bytes, from those of each: the first moved on by n zero bytes, by squaring."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [_times(step, r) for r in step]
    while n:
        if n & 1:
            first = _times(step, first)
        step, n = [_times(step, r) for r in step], n >> 1
    return first ^ second


def decode(raw: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """Array (x, y, z) and header fields."""
    head, _, body = raw.partition(b"\n\n")
    lines = head.decode("ascii", "replace").split("\n")
    if not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x and not x.startswith("#"))
    if fields.get("encoding", "raw") in ("gzip", "gz"):
        body = gzip.decompress(body)
    kind = np.dtype(KINDS[fields["type"]])
    if fields.get("endian") == "big":
        kind = kind.newbyteorder(">")
    return np.frombuffer(body, kind).reshape([int(x) for x in fields["sizes"].split()][::-1]).T, fields


@dataclass
class _Part(InputPartition):
    """A file, or of a file with known segments one: its place and bytes, its first cell and its number of cells."""

    path: str
    at: int = 0
    n_bytes: int | None = None
    first: int = 0
    cells: int = 0


def _head(path: str) -> tuple[dict[str, str], str, int]:
    """Header fields, the index of segments or nothing, and where the data begins."""
    raw = b""
    with open(path, "rb") as f:
        while b"\n\n" not in raw and (more := f.read(1 << 16)):
            raw += more
    head = raw.partition(b"\n\n")[0]
    lines = head.decode("ascii", "replace").split("\n")
    if not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    index = next((x.removeprefix(f"{INDEX}:=") for x in lines if x.startswith(f"{INDEX}:=")), "")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x and not x.startswith("#")), index, len(head) + 2


def _kind(fields: dict[str, str]) -> np.dtype:
    kind = np.dtype(KINDS[fields["type"]])
    return kind.newbyteorder(">") if fields.get("endian") == "big" else kind


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.keep_zeros = options.get("keepzeros", "false") == "true"

    def partitions(self):
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, x) for x in os.listdir(self.path) if x.endswith(".nrrd"))
        return [p for x in files for p in self.parts(x)]

    def parts(self, path: str) -> list[_Part]:
        fields, index, at = _head(path)
        n, size = int(np.prod([int(x) for x in fields["sizes"].split()], dtype=object)), _kind(fields).itemsize
        if fields.get("encoding", "raw") == "raw":
            step = SEGMENT
            lengths = [min(step, n - i) * size for i in range(0, n, step)]
        elif index:
            step, *lengths = map(int, index.split())
            at += len(GZIP)
        else:
            return [_Part(path, cells=n)]
        starts = np.cumsum([at, *lengths]).tolist()
        return [_Part(path, starts[i], length, i * step, min(step, n - i * step)) for i, length in enumerate(lengths)]

    def read(self, partition: _Part):
        with open(partition.path, "rb") as f:
            if partition.n_bytes is None:
                a, fields = decode(f.read())
                values = a.T.ravel()
            else:
                fields = _head(partition.path)[0]
                f.seek(partition.at)
                raw = f.read(partition.n_bytes)
                values = np.frombuffer(raw if fields.get("encoding", "raw") == "raw" else zlib.decompressobj(-15).decompress(raw), _kind(fields))
        name = os.path.basename(partition.path).removesuffix(".nrrd")
        nx, ny = (int(x) for x in fields["sizes"].split()[:2])
        for i in range(0, len(values), 1 << 16):
            some = values[i : i + (1 << 16)]
            found = np.arange(len(some)) if self.keep_zeros else np.nonzero(some)[0]
            if not len(found):
                continue
            cell = found + (partition.first + i)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *(pa.array(c.astype(np.int32)) for c in (cell % nx, cell // nx % ny, cell // (nx * ny))), pa.array(some[found].astype(float))], names=["vol_id", "ix", "iy", "iz", "v"])


@dataclass
class _Done(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    """Rows (vol_id, at, body): bytes and their places in the volumes' files, in any order and in many tasks at once."""

    def __init__(self, options: dict):
        self.path, self.run = options["path"].removeprefix("file://"), options["run"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        made = set()
        os.makedirs(self.path, exist_ok=True)
        for b in batches:
            for name, at, body in zip(*(b.column(i) for i in range(3)), strict=True):
                to = os.path.join(self.path, f"{name.as_py()}.nrrd")
                f = os.open(f"{to}.{self.run}.part", os.O_WRONLY | os.O_CREAT, 0o666)
                try:
                    left, place = memoryview(body.as_py()), at.as_py()
                    while left:
                        n = os.pwrite(f, left, place)
                        left, place = left[n:], place + n
                finally:
                    os.close(f)
                made.add(to)
        return _Done(sorted(made))

    def files(self, messages) -> list[str]:
        return sorted({x for m in messages if m for x in m.files})

    def commit(self, messages):
        for x in self.files(messages):
            os.replace(f"{x}.{self.run}.part", x)

    def abort(self, messages):
        for x in self.files(messages):
            if os.path.exists(f"{x}.{self.run}.part"):
                os.remove(f"{x}.{self.run}.part")


class NrrdDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nrrd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options)


def write_nrrd(voxels: DataFrame, path: str, sizes: tuple[int, int, int], voxel_mm: float, bits: int = 32, vol_id: str | None = None, origin: tuple[float, float, float] | None = None, compress: bool = True, segment: int = SEGMENT) -> None:
    """Writes volumes as NRRD. The origin puts the middle of x and y and the start of z at 0 unless given.

    Segments are packed by one task each and written in place by another; only their sizes and sums meet, by volume.
    """
    spark, n = voxels.sparkSession, sizes[0] * sizes[1] * sizes[2]
    spark.dataSource.register(NrrdDataSource)
    origin = origin or (-(sizes[0] // 2) * voxel_mm, -(sizes[1] // 2) * voxel_mm, 0.0)
    kind, stored = {8: ("uint8", "u1"), 16: ("uint16", "<u2")}.get(bits, ("float", "<f4"))
    rows = voxels.withColumn("vol_id", F.lit(vol_id)) if vol_id else voxels
    inside = F.lit(True)
    for a, m in zip(("ix", "iy", "iz"), sizes, strict=True):
        inside = inside & F.col(a).between(0, m - 1)
    cell = F.when(inside, (F.col("iz").cast("long") * sizes[1] + F.col("iy")) * sizes[0] + F.col("ix")).otherwise(F.raise_error(F.lit("a cell outside of its volume")).cast("long"))
    cells = rows.select("vol_id", cell.alias("cell"), F.col("v").cast("double").alias("v")).withColumn("seg", F.expr(f"cell div {segment}"))
    # A segment without cells is all zeros and is packed too.
    every = rows.select("vol_id").distinct().select("vol_id", F.lit(None).cast("long").alias("cell"), F.lit(None).cast("double").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // segment).cast("long"))).alias("seg"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        first = key[1].as_py() * segment
        a, real = np.zeros(min(segment, n - first), stored), t.column("cell").is_valid()
        t = t.filter(real)
        a[t.column("cell").to_numpy() - first] = t.column("v").to_numpy()
        raw = a.tobytes()
        return pa.table({"vol_id": pa.array([key[0].as_py()], pa.string()), "seg": [key[1].as_py()], "raw": [len(raw)], "crc": pa.array([zlib.crc32(raw)], pa.int64()), "body": pa.array([deflated(raw) if compress else raw], pa.binary())})

    packed = cut(cells.unionByName(every).groupBy("vol_id", "seg").applyInArrow(pack, "vol_id string, seg long, raw long, crc long, body binary"))

    def ends(key: tuple, t: pa.Table) -> pa.Table:
        """Of a volume: its header, and what ends its gzip stream."""
        t = t.sort_by("seg")
        lengths, total, crc = t.column("size").to_pylist(), 0, 0
        for raw, c in zip(t.column("raw").to_pylist(), t.column("crc").to_pylist(), strict=True):
            crc, total = joined_crc(crc, c, raw), total + raw
        head = header(kind, sizes, (voxel_mm,) * 3, origin, compress, f"{segment} " + " ".join(map(str, lengths)) if compress else "") + (GZIP if compress else b"")
        tail = b"\x03\x00" + crc.to_bytes(4, "little") + (total & 0xFFFFFFFF).to_bytes(4, "little")
        pieces = [(0, head), *([(len(head) + sum(lengths), tail)] if compress else [])]
        return pa.table({"vol_id": pa.array([key[0].as_py()] * len(pieces), pa.string()), "at": [p for p, _ in pieces], "body": pa.array([b for _, b in pieces], pa.binary()), "start": pa.array([len(head)] * len(pieces), pa.int64())})

    sized = packed.select("vol_id", "seg", "raw", "crc", F.length("body").cast("long").alias("size"))
    around = cut(sized.groupBy("vol_id").applyInArrow(ends, "vol_id string, at long, body binary, start long"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("vol_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sized.select("vol_id", "seg", before.alias("at")).join(around.where("at = 0").select("vol_id", "start"), "vol_id").select("vol_id", "seg", (F.col("at") + F.col("start")).alias("at"))
    pieces = packed.join(places, ["vol_id", "seg"]).select("vol_id", "at", "body").unionByName(around.select("vol_id", "at", "body"))
    pieces.write.format("nrrd").mode("append").options(path=path, run=uuid.uuid4().hex).save()


def read_nrrd(spark, path: str) -> DataFrame:
    spark.dataSource.register(NrrdDataSource)
    return spark.read.format("nrrd").option("path", path).load()
