"""Running sums and folds over ordered rows that no single task could hold: ranges in parallel, states carried across their borders."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import SETTINGS_ROWS, cut

#: Rows of a range. There are never more ranges than a table of settings may have rows, so one state a range can be broadcast.
RANGE_ROWS = 1_000_000


def ranges(df: DataFrame, order: Sequence[str], size: int = RANGE_ROWS) -> DataFrame:
    """df with __part, the number of its range of the order, written in that order."""
    parts = min(max(-(-df.count() // size), 1), SETTINGS_ROWS)
    placed = df.repartitionByRange(parts, *order) if parts > 1 else df.coalesce(1)
    return cut(placed.sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))


class Total:
    """A sum with what its roundings lost, kept beside it (Neumaier): the error does not grow with the number of terms."""

    def __init__(self, s: float = 0.0, lost: float = 0.0):
        self.s, self.lost = s, lost

    def add(self, x: float) -> None:
        t = self.s + x
        self.lost += (self.s - t) + x if abs(self.s) >= abs(x) else (x - t) + self.s
        self.s = t

    def value(self) -> float:
        return self.s + self.lost if math.isfinite(self.lost) else self.s


def running_sum(df: DataFrame, value: str, order: Sequence[str], out: str, size: int = RANGE_ROWS) -> DataFrame:
    """df with the sum of value over all rows up to each in an order that tells rows apart; nulls count as 0.

    Ranges are read as a stream twice, for their sums, of which the driver gets one a range, and to add up from what came
    before them. All sums are compensated: a plain one is off by about a rounding a row, which showed in rounded results.
    """
    rows = ranges(df.withColumn("__v", F.col(value).cast("double")), order, size)
    part, v = rows.columns.index("__part"), rows.columns.index("__v")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, Total()
        for b in batches:
            for x in b.column(v).drop_null().to_pylist():
                total.add(x)
            place = b.column(part)[0].as_py() if place is None and b.num_rows else place
        if place is not None:
            yield pa.RecordBatch.from_pylist([{"part": place, "s": total.s, "lost": total.lost}], schema)

    schema = pa.schema([("part", pa.int32()), ("s", pa.float64()), ("lost", pa.float64())])
    came, total = {}, Total()
    # One row a range, of which there are at most SETTINGS_ROWS.
    for r in rows.mapInArrow(totals, "part int, s double, lost double").orderBy("part").collect():
        came[r["part"]] = total.s, total.lost
        total.add(r["s"])
        total.lost += r["lost"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            done = []
            for x in b.column(v).to_pylist():
                total = Total(*came[b.column(part)[0].as_py()]) if total is None else total
                if x is not None:
                    total.add(x)
                done.append(total.value())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(done, pa.float64())], names=[*kept, out])

    kept = [c for c in rows.columns if c not in ("__part", "__v", out)]
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(sums, f"{kinds}`{out}` double")


class Rise:
    """What a run of values does to the last value before it: below `edge` the run ends at `low`, else `steps` steps are added.

    Such runs compose to such runs, so states of ranges can be joined without their rows.
    """

    def __init__(self, edge: float, low: float, steps: int):
        self.edge, self.low, self.steps = edge, low, steps

    def then(self, x: float, eps: float) -> None:
        if self.edge + self.steps * eps < x:
            self.edge = x - self.steps * eps
        self.low = x if self.low < x else self.low + eps
        self.steps += 1

    def after(self, last: float | None, eps: float) -> float:
        return self.low if last is None or last < self.edge else last + self.steps * eps


def increasing(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], out: str, position: str, eps: float = 1e-6, size: int = RANGE_ROWS) -> DataFrame:
    """df with out, value made strictly increasing within each series (by) in an order that tells rows apart: a value that does not
    exceed the one before it becomes that plus eps; and with position, the row's place in its series from 0.

    Nulls stay null and are passed over. A series may hold any share of the rows: it is cut into ranges, of each of which the
    first pass keeps its effect and the second runs the fold from what came in. Both read rows as a stream. A tie across
    the border of a range is decided by a sum of steps instead of one step after the other, so up to rounding.
    """
    data = df.withColumn("__v", F.col(value).cast("double"))
    rows = ranges(data, [*by, *order], size)
    at = [rows.columns.index(b) for b in by]
    part, v = rows.columns.index("__part"), rows.columns.index("__v")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a range: whether one series fills it, and the effect of its last series."""
        first = key = rise = place = None
        n = 0
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in at), strict=True) if at else ((),) * b.num_rows
            for k, x in zip(keys, b.column(v).to_pylist(), strict=True):
                first = k if place is None else first
                if place is None or k != key:
                    key, rise, n = k, None, 0
                place, n = b.column(part)[0].as_py() if place is None else place, n + 1
                if x is not None and rise is None:
                    rise = Rise(x, x, 1)
                elif x is not None:
                    rise.then(x, eps)
        if place is not None:
            yield pa.RecordBatch.from_pylist([{"part": place, "whole": key == first, "first": repr(first), "last": repr(key), "n": n, "edge": rise and rise.edge, "low": rise and rise.low, "steps": rise and rise.steps}], schema)

    schema = pa.schema([("part", pa.int32()), ("whole", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("n", pa.int64()), ("edge", pa.float64()), ("low", pa.float64()), ("steps", pa.int64())])
    came: dict[int, tuple[float | None, int]] = {}
    series, last, n = None, None, 0
    # One row a range, of which there are at most SETTINGS_ROWS.
    for r in rows.mapInArrow(effects, "part int, whole boolean, first string, last string, n long, edge double, low double, steps long").orderBy("part").collect():
        if series is not None and r["first"] == series:
            came[r["part"]] = (last, n)
        if not (r["whole"] and series == r["last"]):
            last, n = None, 0
        if r["steps"]:
            last = Rise(r["edge"], r["low"], r["steps"]).after(last, eps)
        series, n = r["last"], n + r["n"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, last, n = None, False, None, 0
        for b in batches:
            done, places = [], []
            keys = zip(*(b.column(i).to_pylist() for i in at), strict=True) if at else ((),) * b.num_rows
            for k, x in zip(keys, b.column(v).to_pylist(), strict=True):
                if not begun:
                    last, n = came.get(b.column(part)[0].as_py(), (None, 0))
                elif k != key:
                    last, n = None, 0
                key, begun = k, True
                if x is not None:
                    last = x if last is None or x > last else last + eps
                done.append(None if x is None else last)
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.float64()), pa.array(places, pa.int64())], names=[*b.schema.names, out, position])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(fold, f"{kinds}, `{out}` double, `{position}` long").drop("__part", "__v")

