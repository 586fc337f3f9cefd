"""Graphs and grids: connected components and shortest paths by iterated joins, and within parts by a heap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import along_curve
from ..functions.session import afresh, cut

ROUNDS = 64


def hook_components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, label): the smallest node of each component of edges (u, v), by alternating stars.

    Rounds are logarithmic in the longest path; each is written and read again.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = afresh(small.where("u <> v").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
        before = state
    raise RuntimeError("components did not settle")


def grid_components(cells: DataFrame, axes: list[str], shape: list[int], diagonal: bool) -> DataFrame:
    """cells (axes) with label: the smallest linear index of the component that each belongs to.

    diagonal: all neighbours of a cell count (8 or 26), else only those that share a face. Cells in a row along the last
    axis are one run from the start: only links between runs are hooked, so their number goes with the surface of
    what is joined and not with its cells.
    """
    index = F.lit(0).cast("long")
    for a, n in zip(axes, shape, strict=True):
        index = index * n + F.col(a)
    *others, last = axes
    line = Window.partitionBy(*others).orderBy(last)
    begins = F.when(F.coalesce(F.col(last) - F.lag(last).over(line), F.lit(2)) != 1, F.col("node"))
    rows = cells.select(*axes).distinct().withColumn("node", index)
    rows = rows.withColumn("begin", begins).withColumn("run", F.max("begin").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = cut(rows.select(*axes, "run"))
    steps = [()]
    for _ in axes:
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    steps = [s for s in steps if s[:-1] > (0,) * len(others) and (diagonal or sum(map(abs, s)) == 1)]
    if not steps:
        return rows.withColumnRenamed("run", "label")
    offsets = F.array(*[F.struct(*(F.lit(d).alias(f"d{a}") for a, d in zip(axes, s, strict=True))) for s in steps])
    sent = rows.withColumn("o", F.explode(offsets)).select(F.col("run").alias("u"), *((F.col(a) + F.col(f"o.d{a}")).alias(a) for a in axes))
    edges = sent.join(rows.withColumnRenamed("run", "v"), axes).select("u", "v").distinct()
    labels = hook_components(edges)
    return rows.join(labels, F.col("run") == F.col("node"), "left").select(*axes, F.coalesce("label", "run").alias("label"))


def largest_component(cells: DataFrame, axes: list[str], shape: list[int], diagonal: bool) -> DataFrame:
    """The cells of the largest component, the first in scan order among equals."""
    placed = grid_components(cells, axes, shape, diagonal)
    size = placed.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    best = size.agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("first"))).alias("label"))
    return placed.join(F.broadcast(best), "label").select(*axes)


#: Vertices of a part of a graph: what one task holds and searches with a heap.
PART = 16_384


def space_parts(points: DataFrame, axes: Sequence[str], size: int = PART) -> DataFrame:
    """(vid, part): parts of size points each along a space-filling curve; points without a number are left out.

    All axes have one scale: parts are compact as distances are, so that a way seldom crosses the same border again.
    """
    return along_curve(points.where("vid IS NOT NULL").select("vid", *axes), axes, size, "part", one_scale=True).select("vid", "part")


def _links_of_part(key: tuple, t: pa.Table) -> pa.Table:
    """The edges that leave the vertices of a part, grouped by their start; an edge without end stands for a vertex alone."""
    src, dst, w, there = (t.column(c).combine_chunks() for c in ("src", "dst", "w", "there"))
    start, real = src.to_numpy(), dst.is_valid().to_numpy(zero_copy_only=False)
    vids = np.unique(start)
    start, ends = start[real], dst.drop_null().to_numpy()
    order = np.argsort(start, kind="stable")
    first = np.searchsorted(start[order], np.append(vids, vids[-1]), "left")
    first[-1] = len(order)
    cols = {"vids": vids, "first": first, "ends": ends[order], "there": there.drop_null().to_numpy()[order], "w": w.drop_null().to_numpy()[order]}
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), **{n: pa.array([np.ascontiguousarray(a, np.float64 if n == "w" else np.int64).tobytes()], pa.binary()) for n, a in cols.items()}})


def _searched(row: dict) -> tuple[np.ndarray, tuple[list, list, list]]:
    """Distances of a part's vertices once all that came in has been followed inside it, and what crosses its border."""
    read = lambda n, kind=np.int64: np.frombuffer(row[n], kind)
    part, vids, first, ends, there, w = row["part"], read("vids"), read("first"), read("ends"), read("there"), read("w", np.float64)
    d = np.full(len(vids), np.inf) if row["d"] is None else read("d", np.float64).copy()
    inside = there == part
    local = np.where(inside, np.searchsorted(vids, ends), -1)
    best, heap, moved = d.tolist(), [], set()
    for vid, x in zip(row["vid"], row["x"], strict=True):
        i = int(np.searchsorted(vids, vid))
        if x < best[i]:
            best[i] = x
            heappush(heap, (x, i))
            moved.add(i)
    starts, near, far = first.tolist(), local.tolist(), w.tolist()
    while heap:
        x, i = heappop(heap)
        if x > best[i]:
            continue
        for e in range(starts[i], starts[i + 1]):
            j, y = near[e], x + far[e]
            if j >= 0 and y < best[j]:
                best[j] = y
                heappush(heap, (y, j))
                moved.add(j)
    out: tuple[list, list, list] = ([], [], [])
    for i in sorted(moved):
        for e in range(starts[i], starts[i + 1]):
            if near[e] < 0:
                for held, value in zip(out, (there[e], ends[e], best[i] + far[e]), strict=True):
                    held.append(value)
    return np.asarray(best), out


def shortest_paths(edges: DataFrame, seeds: DataFrame, parts: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(vid, d): distance of each reached vertex from the nearest seed (vid) over edges (src, dst, w) with w of 0 or more.

    parts (vid, part): every vertex is in one part; seeds and edges of other vertices, and edges with a null, are left out.
    A round searches each part that got something, with a heap, from all that came over its border, and sends on what
    leaves it: the shortest way into each vertex of another part. So there are about as many rounds as parts that the
    longest of the shortest ways crosses, not as it has edges; parts that got nothing are neither read nor searched again.
    """
    here = parts.select(F.col("vid").alias("src"), "part")
    there = parts.select(F.col("vid").alias("dst"), F.col("part").alias("there"))
    known = edges.where("src IS NOT NULL AND w IS NOT NULL").join(here, "src").join(there, "dst").select("part", "src", "dst", F.col("w").cast("double").alias("w"), "there")
    alone = here.select("part", "src", *(F.lit(None).cast(kind).alias(n) for n, kind in (("dst", "long"), ("w", "double"), ("there", "long"))))
    links = cut(known.select("part", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w", "there").unionByName(alone.withColumn("src", F.col("src").cast("long"))).groupBy("part").applyInArrow(_links_of_part, "part long, vids binary, first binary, ends binary, there binary, w binary"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (r for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                d, (to, vid, x) = _searched(row)
                cols = [pa.array([v], kind) for v, kind in ((row["part"], pa.int64()), (row["vids"], pa.binary()), (d.tobytes(), pa.binary()), (to, pa.list_(pa.int64())), (vid, pa.list_(pa.int64())), (x, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "vids", "d", "to", "vid", "x"])

    kind = "part long, vids binary, d binary, to array<long>, vid array<long>, x array<double>"
    came = seeds.select("vid").distinct().join(parts, "vid").select("part", F.col("vid").cast("long").alias("vid"), F.lit(0.0).alias("x"))
    state = links.sparkSession.createDataFrame([], kind)
    for _ in range(rounds):
        least = came.groupBy("part", "vid").agg(F.min("x").alias("x"))
        inbox = least.groupBy("part").agg(F.collect_list(F.struct("vid", "x")).alias("m")).select("part", F.col("m.vid").alias("vid"), F.col("m.x").alias("x"))
        asked = links.join(inbox, "part").join(state.select("part", "d"), "part", "left")
        idle = state.join(inbox, "part", "left_anti").select("part", "vids", "d", *(F.array().cast(f"array<{t}>").alias(n) for n, t in (("to", "long"), ("vid", "long"), ("x", "double"))))
        state = afresh(asked.mapInArrow(search, kind).unionByName(idle))
        came = state.where("size(to) > 0").select(F.explode(F.arrays_zip("to", "vid", "x")).alias("m")).select(F.col("m.to").alias("part"), F.col("m.vid").alias("vid"), F.col("m.x").alias("x"))
        if came.isEmpty():
            return state.select("vids", "d").mapInArrow(_distances, "vid long, d double")
    raise RuntimeError("paths did not settle")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reached vertices of searched parts."""
    for b in batches:
        for vids, d in zip(b.column(0), b.column(1), strict=True):
            v, x = np.frombuffer(vids.as_buffer(), np.int64), np.frombuffer(d.as_buffer(), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(v[np.isfinite(x)]), pa.array(x[np.isfinite(x)])], names=["vid", "d"])
