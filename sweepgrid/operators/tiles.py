"""Resampling by tiles: stack and samples are laid out in the same tiles, and values are read inside a tile.

A line is all values of a depth row of a frame. Linear sampling needs the lines of two rows of two frames: they travel
together once, and each sample meets them by one equi-join on (frame, row), whatever the number of its corners. Splines
need more lines around a sample, so tiles of eight by eight lines with a margin as wide as the spline are read in NumPy.
No task holds more than a tile and its samples, and nothing reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import lines

#: Lines of a tile in depth and along the sweep, without its margin.
SIDE = 8


def _values(line: Column, i: Column) -> Column:
    return F.coalesce(F.get(line, i), F.lit(0.0))


def linear(samples: DataFrame, polar: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, keys and v: order-1 samples at (r_idx, p_idx, k_idx). A corner outside the stack counts 0."""
    around = F.array(*[F.struct(F.lit(a).alias("dk"), F.lit(b).alias("dr")) for a in (0, 1) for b in (0, 1)])
    sent = lines(polar, "p", [*by, "k", "r"]).select(*by, "k", "r", "line", F.explode(around).alias("o"))
    sent = sent.select(*by, (F.col("k") - F.col("o.dk")).alias("k"), (F.col("r") - F.col("o.dr")).alias("r"), "o", "line")
    pick = lambda a, b: F.first(F.when((F.col("o.dk") == a) & (F.col("o.dr") == b), F.col("line")), ignorenulls=True).alias(f"l{a}{b}")
    tiles = sent.groupBy(*by, "k", "r").agg(*[pick(a, b) for a in (0, 1) for b in (0, 1)])
    at = samples.select(*by, *keys, *(F.col(f"{x}_idx") for x in "rpk"), *(F.floor(f"{x}_idx").cast("int").alias(x) for x in "rpk"))
    at = at.select(*by, *keys, "k", "r", "p", *((F.col(f"{x}_idx") - F.col(x)).alias(f"f{x}") for x in "rpk"))
    met = at.join(tiles, [*by, "k", "r"], "left")
    share = lambda x, one: F.col(f"f{x}") if one else 1.0 - F.col(f"f{x}")
    total = F.lit(0.0)
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                w = share("r", b) * share("p", c) * share("k", a)
                total = total + F.when(w != 0, w * _values(F.col(f"l{a}{b}"), F.col("p") + c)).otherwise(0.0)
    return met.select(*by, *keys, total.alias("v"))


def _filtered(stack: DataFrame, axis: str, others: list[str], n: int, order: int) -> DataFrame:
    """Spline coefficients along one axis: lines are independent, each travels whole and is filtered with others of its batch."""
    from .recon import spline_coefficients

    whole = lines(stack, axis, others, F.lit(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line = b.column(b.num_columns - 1)
            for at in range(0, b.num_rows, 1024):
                some = line.slice(at, 1024)
                got = spline_coefficients(some.flatten().to_numpy(zero_copy_only=False).reshape(-1, n), order, 1)
                offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, 1024) for i in range(b.num_columns - 1)), pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))], names=b.schema.names)

    schema = ", ".join(f"{c} {kind}" for c, kind in whole.dtypes)
    return whole.mapInArrow(run, schema).select(*others, F.posexplode("line").alias(axis, "v"))


def spline(samples: DataFrame, polar: DataFrame, shape: tuple[int, int, int], keys: Sequence[str], order: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """by, keys and v by spline interpolation of an order from 1 to 5, nearest at the borders; shape: rows, columns and frames.

    The recursive filter that gives the coefficients (orders of 3 and more) runs along depth, angle and sweep in turn.
    """
    from .recon import sample_stack

    rows, cols, frames = shape
    now = polar.select(*by, "k", "r", "p", F.col("v").cast("double").alias("v"))
    if order >= 3:
        for axis, n in (("r", rows), ("k", frames), ("p", cols)):
            now = _filtered(now, axis, [*by, *(c for c in ("k", "r", "p") if c != axis)], n, order)
    base = lambda x: F.floor(F.col(f"{x}_idx") + (0.0 if order % 2 else 0.5)).cast("int") - order // 2
    tile = lambda x: F.floor(x / SIDE).cast("int")
    named = samples.select(*by, *keys, "r_idx", "p_idx", "k_idx", tile(base("k")).alias("kt"), tile(base("r")).alias("rt"))

    def spread(df: DataFrame, x: str, n: int) -> DataFrame:
        """Lines in all tiles that read them; the outermost stand for what lies beyond."""
        low = F.when(F.col(x) == 0, F.lit(-order)).otherwise(F.col(x))
        high = F.when(F.col(x) == n - 1, F.col(x) + order).otherwise(F.col(x))
        return df.withColumn(f"{x}t", F.explode(F.sequence(tile(low - order), tile(high))))

    sent = lines(now, "p", [*by, "k", "r"], F.lit(cols))
    sent = spread(spread(sent, "k", frames), "r", rows)
    kinds = dict(samples.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*by, *keys)), "v double"])

    def run(_: tuple, at: pa.Table, held: pa.Table) -> pa.Table:
        position = np.array([at.column(f"{x}_idx").to_numpy() for x in "rpk"])
        value = np.zeros(at.num_rows)
        if at.num_rows and held.num_rows:
            k, r = held.column("k").to_numpy(), held.column("r").to_numpy()
            k0, r0 = int(k.min()), int(r.min())
            stack = np.zeros((int(r.max()) - r0 + 1, cols, int(k.max()) - k0 + 1))
            stack[r - r0, :, k - k0] = np.concatenate([c.flatten().to_numpy() for c in held.column("line").chunks]).reshape(-1, cols)
            value = sample_stack(stack, position - np.array([[r0], [0], [k0]]), order)
        return pa.table({**{c: at.column(c) for c in (*by, *keys)}, "v": value})

    groups = [*by, "kt", "rt"]
    return named.groupBy(*groups).cogroup(sent.groupBy(*groups)).applyInArrow(run, schema)
