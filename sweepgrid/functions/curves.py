"""Order along a space-filling curve: what lies near in it lies near in space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import ranked


def along_curve(points: DataFrame, axes: Sequence[str], size: int, out: str, bits: int = 20, one_scale: bool = False) -> DataFrame:
    """points (vid unique and not null) with out: parts of size points each, from 0, in Morton order of their box.

    one_scale: of a cube around them, so that parts of a long sheet are short pieces of it and not long strips.

    Ranks make the parts equally large however points crowd; points of one cell are told apart by vid. A missing
    coordinate counts as the lowest.
    """
    lows = points.agg(*(f(F.col(a).cast("double")).alias(f"{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    spans = [(lows[f"hi{a}"] or 0.0) - (lows[f"lo{a}"] or 0.0) for a in axes]
    scaled = {}
    for i, a in enumerate(axes):
        span = max(spans) if one_scale else spans[i]
        at = (F.col(a) - F.lit(lows[f"lo{a}"])) / F.lit(span) * (2**bits - 1) if span else F.lit(0.0)
        scaled[f"__c{i}"] = F.floor(F.coalesce(at, F.lit(0.0))).cast("long")
    code = F.lit(0).cast("long")
    for b in range(bits):
        for i in range(len(axes)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(f"__c{i}", b).bitwiseAND(F.lit(1).cast("long")), b * len(axes) + i))
    coded = points.withColumns(scaled).withColumn("__code", code).drop(*scaled)
    placed = ranked(coded, ["__code", "vid"], "__rank")
    return placed.withColumn(out, F.floor((F.col("__rank") - 1) / size).cast("long")).drop("__code", "__rank")
