"""Stencils over volumes in blocks with halos.

A volume is packed into dense blocks, one row each. For a stencil of some reach every block is sent to its own place
and its faces, edges and corners, as thick as the reach, to the neighbours that read them; what a task puts together is a
block with its halo, on which the stencil runs in NumPy. So the shuffle is about the volume plus its blocks' surface,
whatever the size of the stencil, and no task holds more than a few blocks. Beyond the border of the volume stands the nearest
cell inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut

#: Cells of a block along an axis; the last one of an axis takes what is over, so that none is thinner.
EDGE = 24
AXES = ("ix", "iy", "iz")


class Grid:
    """How a shape is cut into blocks."""

    def __init__(self, shape: Sequence[int]):
        self.shape, self.edge = tuple(shape), EDGE
        self.count = tuple(max(1, n // EDGE) for n in shape)

    def place(self, block: int) -> tuple[int, int, int]:
        _, b, c = self.count
        return block // (b * c), block // c % b, block % c

    def number(self, at: Sequence[int]) -> int:
        return (at[0] * self.count[1] + at[1]) * self.count[2] + at[2]

    def span(self, axis: int, i: int) -> tuple[int, int]:
        return i * self.edge, self.shape[axis] if i == self.count[axis] - 1 else (i + 1) * self.edge

    def sides(self, block: int) -> tuple[int, ...]:
        return tuple(b - a for a, b in (self.span(x, i) for x, i in enumerate(self.place(block))))

    def neighbours(self, block: int) -> Iterator[tuple[tuple[int, int, int], int]]:
        """(offset, block) of all blocks around a block and of itself."""
        at = self.place(block)
        for o in product((-1, 0, 1), repeat=3):
            to = [a + d for a, d in zip(at, o, strict=True)]
            if all(0 <= t < n for t, n in zip(to, self.count, strict=True)):
                yield o, self.number(to)


def pack(voxels: DataFrame, shape: Sequence[int]) -> DataFrame:
    """(block, data) of all blocks of a volume (ix, iy, iz, v); absent cells are 0, voxels outside the shape are left out."""
    g = Grid(shape)
    at = [F.least(F.floor(F.col(a) / g.edge), F.lit(n - 1)).cast("long") for a, n in zip(AXES, g.count, strict=True)]
    inside = " AND ".join(f"{a} >= 0 AND {a} < {n}" for a, n in zip(AXES, shape, strict=True))
    rows = voxels.where(inside).select(((at[0] * g.count[1] + at[1]) * g.count[2] + at[2]).alias("block"), *(F.col(a).cast("int").alias(a) for a in AXES), F.col("v").cast("double").alias("v"))
    every = voxels.sparkSession.range(int(np.prod(g.count))).select(F.col("id").alias("block"), *(F.lit(None).cast("int").alias(a) for a in AXES), F.lit(None).cast("double").alias("v"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        block = key[0].as_py()
        out = np.zeros(g.sides(block))
        t = t.filter(t.column("ix").is_valid())
        start = [g.span(x, i)[0] for x, i in enumerate(g.place(block))]
        out[tuple(t.column(a).to_numpy() - s for a, s in zip(AXES, start, strict=True))] = t.column("v").fill_null(0.0).to_numpy()
        return pa.table({"block": pa.array([block], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    return rows.unionByName(every).groupBy("block").applyInArrow(run, "block long, data binary")


def unpack(blocks: DataFrame, shape: Sequence[int]) -> DataFrame:
    """All cells (ix, iy, iz, v) of packed blocks."""
    g = Grid(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sides = g.sides(block)
                cells = np.indices(sides, np.int32).reshape(3, -1)
                index = [pa.array(c + np.int32(g.span(x, i)[0])) for x, (c, i) in enumerate(zip(cells, g.place(block), strict=True))]
                yield pa.RecordBatch.from_arrays([*index, pa.array(np.frombuffer(data.as_buffer(), np.float64))], names=[*AXES, "v"])

    return blocks.select("block", "data").mapInArrow(run, "ix int, iy int, iz int, v double")


def stencil(blocks: DataFrame, shape: Sequence[int], reach: int, f: Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, ...]], outputs: int = 1) -> DataFrame:
    """(block, data, data1, ...): what f makes of each block with its halo of reach cells on all sides, one array of the block's size for each output."""
    if not 0 < reach <= EDGE:
        raise ValueError(f"a reach of {reach} cells does not fit blocks of {EDGE}")
    g = Grid(shape)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = np.frombuffer(data.as_buffer(), np.float64).reshape(g.sides(block))
                dest, part, pieces = [], [], []
                for o, to in g.neighbours(block):
                    # The receiver finds this block on its other side.
                    cut_ = tuple(slice(None) if d == 0 else slice(-reach, None) if d > 0 else slice(0, reach) for d in o)
                    dest.append(to)
                    part.append(sum((1 - d) * 3 ** (2 - x) for x, d in enumerate(o)))
                    pieces.append(np.ascontiguousarray(a[cut_]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(part, pa.int32()), pa.array(pieces, pa.binary())], names=["block", "part", "piece"])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        block = key[0].as_py()
        sides = g.sides(block)
        held = {p: v.as_buffer() for p, v in zip(t.column("part").to_pylist(), t.column("piece"), strict=True)}
        here = [[d for d in (-1, 0, 1) if 0 <= i + d < n] for i, n in zip(g.place(block), g.count, strict=True)]
        whole = np.zeros([n + reach * (len(h) - 1) for n, h in zip(sides, here, strict=True)])
        for o in product(*here):
            size = tuple(n if d == 0 else reach for n, d in zip(sides, o, strict=True))
            first = [reach * (-1 in h) for h in here]
            at = tuple(slice(s, s + n) if d == 0 else slice(0, reach) if d < 0 else slice(s + n, s + n + reach) for d, n, s in zip(o, sides, first, strict=True))
            whole[at] = np.frombuffer(held[sum((1 + d) * 3 ** (2 - x) for x, d in enumerate(o))], np.float64).reshape(size)
        whole = np.pad(whole, [(0 if -1 in h else reach, 0 if 1 in h else reach) for h in here], mode="edge")
        got = f(whole)
        got = got if isinstance(got, tuple) else (got,)
        return pa.table({"block": pa.array([block], pa.int64()), **{n: pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary()) for n, x in zip(names, got, strict=True)}})

    names = ["data", *(f"data{i}" for i in range(1, outputs))]
    sent = blocks.select("block", "data").mapInArrow(send, "block long, part int, piece binary")
    return sent.groupBy("block").applyInArrow(run, ", ".join(["block long", *(f"{n} binary" for n in names)]))


def shifted(a: np.ndarray, reach: int, o: Sequence[int]) -> np.ndarray:
    """The block's cells as seen at an offset in the array with its halo."""
    return a[tuple(slice(reach + d, n - reach + d) for d, n in zip(o, a.shape, strict=True))]


def running(a: np.ndarray, reach: int, best: Callable[..., np.ndarray]) -> np.ndarray:
    """Extremes over a cube around each cell, one axis after the other."""
    for axis in range(3):
        a = best(np.lib.stride_tricks.sliding_window_view(a, 2 * reach + 1, axis), axis=-1)
    return a


def medians(a: np.ndarray, reach: int) -> np.ndarray:
    """Medians over a cube around each cell, a plane at a time."""
    planes = []
    for x in range(a.shape[0] - 2 * reach):
        w = np.lib.stride_tricks.sliding_window_view(a[x : x + 2 * reach + 1], (2 * reach + 1,) * 3)[0]
        planes.append(np.median(w.reshape(*w.shape[:2], -1), axis=-1))
    return np.stack(planes)


def gradient_length(a: np.ndarray, spacing: Sequence[float]) -> np.ndarray:
    unit = [tuple(int(i == x) for i in range(3)) for x in range(3)]
    parts = [(shifted(a, 1, u) - shifted(a, 1, tuple(-i for i in u))) / (2.0 * h) for u, h in zip(unit, spacing, strict=True)]
    return np.sqrt(parts[0] ** 2 + parts[1] ** 2 + parts[2] ** 2)


def curvature_flow(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell its value, the flow by curvature and the squared gradient."""
    at = lambda *o: shifted(a, 1, o)
    unit = [tuple(int(i == x) for i in range(3)) for x in range(3)]
    minus = lambda o: tuple(-x for x in o)
    plus = lambda a_, b: tuple(x + y for x, y in zip(a_, b, strict=True))
    c = at(0, 0, 0)
    d1 = [(at(*u) - at(*minus(u))) / 2.0 for u in unit]
    d2 = [at(*u) - 2.0 * c + at(*minus(u)) for u in unit]
    size2 = d1[0] ** 2 + d1[1] ** 2 + d1[2] ** 2
    bend = sum(d2[i] * (size2 - d1[i] ** 2) for i in range(3))
    for i, j in ((0, 1), (0, 2), (1, 2)):
        p, q = unit[i], unit[j]
        mixed = (at(*plus(p, q)) - at(*plus(p, minus(q))) - at(*plus(minus(p), q)) + at(*plus(minus(p), minus(q)))) / 4.0
        bend = bend - 2.0 * d1[i] * d1[j] * mixed
    flow = np.divide(bend, size2, out=np.zeros_like(bend), where=size2 > 1e-12)
    return c, flow, size2


def mean_of(blocks: DataFrame, column: str = "data") -> float:
    """Mean of all cells: a sum and a count a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(x.as_buffer(), np.float64) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([float(x.sum()) for x in got]), pa.array([len(x) for x in got], pa.int64())], names=["s", "n"])

    s, n = blocks.select(column).mapInArrow(run, "s double, n long").agg(F.sum("s"), F.sum("n")).first()
    return s / n


def diffused(voxels: DataFrame, shape: Sequence[int], rounds: int, conductance: float, step: float) -> DataFrame:
    """Rounds of flow by curvature, slowed where the gradient is large against its mean over the volume; packed between rounds."""
    now = pack(voxels, shape)
    for _ in range(rounds):
        parts = cut(stencil(now, shape, 1, curvature_flow, 3))
        scale = max(2.0 * conductance**2 * mean_of(parts, "data2"), 1e-12)

        def run(batches: Iterator[pa.RecordBatch], scale: float = scale) -> Iterator[pa.RecordBatch]:
            for b in batches:
                some = [[np.frombuffer(x.as_buffer(), np.float64) for x in b.column(i)] for i in (1, 2, 3)]
                moved = [(c + step * np.exp(-size2 / scale) * flow).tobytes() for c, flow, size2 in zip(*some, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(moved, pa.binary())], names=["block", "data"])

        now = parts.mapInArrow(run, "block long, data binary")
    return unpack(now, shape)
