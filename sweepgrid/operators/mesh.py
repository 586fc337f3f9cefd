"""Triangle meshes: vertices (vid, x, y, z) and faces (fid, v0, v1, v2)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip, cross, dot, norm
from ..functions.scans import running_sum
from ..functions.session import afresh, cut
from .graph import PART, shortest_paths, space_parts

XYZ = ("x", "y", "z")


def face_corners(faces: DataFrame, vertices: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """faces with ax..cz: the coordinates (and extra columns) of their corners, by one join on exploded corners."""
    corner = faces.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("i", "vid")).join(vertices.select("vid", *XYZ, *extra), "vid")
    cols = [*XYZ, *extra]
    wide = corner.groupBy("fid").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{n}{c}") for i, n in enumerate("abc") for c in cols])
    return faces.join(wide, "fid")


def edges(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions; an edge of two faces stands twice in each."""
    sides = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"), ("v1", "v0"), ("v2", "v1"), ("v0", "v2"))])
    pairs = faces.select(F.explode(sides).alias("e")).select("e.src", "e.dst")
    a = vertices.select(F.col("vid").alias("src"), *(F.col(c).alias(f"a{c}") for c in XYZ))
    b = vertices.select(F.col("vid").alias("dst"), *(F.col(c).alias(f"b{c}") for c in XYZ))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", norm([F.col(f"a{c}") - F.col(f"b{c}") for c in XYZ]).alias("w"))


def boundary(faces: DataFrame) -> DataFrame:
    """(vid): ends of edges that belong to one face only."""
    sides = F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    once = faces.select(F.explode(sides).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.select(F.explode(F.array("a", "b")).alias("vid")).distinct()


def face_areas(faces: DataFrame, vertices: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """face_corners with area."""
    rows = face_corners(faces, vertices, extra)
    u, v = ([F.col(f"{n}{c}") - F.col(f"a{c}") for c in XYZ] for n in "bc")
    return rows.withColumn("area", norm(cross(u, v)) / 2.0)


def patch_area(faces: DataFrame, vertices: DataFrame, patch: DataFrame) -> DataFrame:
    """One row (area, n): faces whose corners all lie in the patch (vid)."""
    marked = vertices.join(patch.select("vid").distinct().withColumn("keep", F.lit(1)), "vid", "left").withColumn("keep", F.coalesce("keep", F.lit(0)))
    whole = face_areas(faces, marked, ("keep",)).where("akeep = 1 AND bkeep = 1 AND ckeep = 1")
    return whole.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.count(F.lit(1)).alias("n"))


def geodesic(faces: DataFrame, vertices: DataFrame, seeds: DataFrame, size: int = PART) -> DataFrame:
    """(vid, d): shortest way along edges from the nearest seed (vid); vertices that none reaches are missing.

    The mesh is cut into parts of about size vertices along a space-filling curve, each searched as a whole.
    """
    links = edges(faces, vertices).groupBy("src", "dst").agg(F.min("w").alias("w"))
    return shortest_paths(links, seeds, cut(space_parts(vertices, XYZ, size)))


def area_by_radius(faces: DataFrame, vertices: DataFrame, distances: DataFrame) -> DataFrame:
    """(radius, area): area of the faces that lie wholly within each distance, as a running sum over faces.

    Faces are summed by distance before the ordered sum, which ranges of distances make side by side.
    """
    placed = face_areas(faces, vertices.join(distances, "vid"), ("d",)).where("ad IS NOT NULL AND bd IS NOT NULL AND cd IS NOT NULL")
    steps = placed.groupBy(F.greatest("ad", "bd", "cd").alias("radius")).agg(F.sum("area").alias("a"))
    return running_sum(steps, "a", ["radius"], "area").select("radius", "area")


def radius_for_area(table: DataFrame, target: float, steps: int = 18) -> float:
    """The radius that bisection finds for an area: half of the last bracket's sum, or the largest radius if all is too little."""
    top = table.agg(F.max("radius").alias("r"), F.max("area").alias("a")).first()
    if top["r"] is None:
        return 0.0
    if top["a"] < target:
        return float(top["r"])
    # The table is a step function: the radius of the step that reaches the target is all that bisection can see of it.
    edge = float(table.where(F.col("area") >= target).agg(F.min("radius").alias("r")).first()["r"])
    lo, hi = 0.0, float(top["r"])
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if mid >= edge else (mid, hi)
    return (lo + hi) / 2


def one_ring(faces: DataFrame) -> DataFrame:
    """(vid, near): neighbours along edges, as often as faces have the edge."""
    sides = F.array(*[F.struct(F.col(a).alias("vid"), F.col(b).alias("near")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"), ("v1", "v0"), ("v2", "v1"), ("v0", "v2"))])
    return faces.select(F.explode(sides).alias("e")).select("e.vid", "e.near")


def ring_median(faces: DataFrame, values: DataFrame) -> DataFrame:
    """(vid, v): median over a vertex and its ring."""
    ring = one_ring(faces).unionByName(values.select("vid", F.col("vid").alias("near")))
    met = ring.join(values.select(F.col("vid").alias("near"), "v"), "near")
    return met.groupBy("vid").agg(F.median("v").alias("v"))


def smooth_scalar(faces: DataFrame, values: DataFrame, rounds: int = 5, alpha: float = 0.5) -> DataFrame:
    """(vid, v): moved by alpha to the mean of the ring, round by round; vertices without a ring stay."""
    ring, now = cut(one_ring(faces)), values.select("vid", F.col("v").cast("double").alias("v"))
    for _ in range(rounds):
        mean = ring.join(now.withColumnRenamed("vid", "near"), "near").groupBy("vid").agg(F.avg("v").alias("m"))
        now = afresh(now.join(mean, "vid", "left").select("vid", (F.col("v") + alpha * (F.coalesce("m", "v") - F.col("v"))).alias("v")))
    return now


def mean_curvature(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, h): dihedral angle times edge length over the area around a vertex, for edges of two faces.

    Positive where the surface is convex against its face normals; 1 / R on a fine sphere.
    """
    f = face_areas(faces, vertices)
    u, v = ([F.col(f"{n}{c}") - F.col(f"a{c}") for c in XYZ] for n in "bc")
    n = cross(u, v)
    size = F.when(norm(n) > 0, norm(n)).otherwise(1.0)
    f = cut(f.withColumns({f"n{c}": e / size for c, e in zip(XYZ, n, strict=True)}))
    corner = {"v0": "a", "v1": "b", "v2": "c"}
    sides = F.array(*[F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"), (F.col(p) < F.col(q)).alias("up"), F.col(o).alias("o"), *(F.col(f"{corner[o]}{c}").alias(f"o{c}") for c in XYZ), *(F.col(f"{corner[p]}{c}").alias(f"p{c}") for c in XYZ), norm([F.col(f"{corner[p]}{c}") - F.col(f"{corner[q]}{c}") for c in XYZ]).alias("length")) for p, q, o in (("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1"))])
    each = f.select("fid", "nx", "ny", "nz", F.explode(sides).alias("e")).select("fid", "nx", "ny", "nz", "e.*")
    pair = each.alias("a").join(each.alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q")) & (F.col("a.fid") < F.col("b.fid")))
    na, nb = [F.col(f"a.n{c}") for c in XYZ], [F.col(f"b.n{c}") for c in XYZ]
    angle = F.acos(clip(dot(na, nb), -1.0, 1.0))
    # Convex if the far corner of the other face lies below this face.
    below = dot([F.col(f"b.o{c}") - F.col(f"a.p{c}") for c in XYZ], na)
    bend = pair.select(F.col("a.p").alias("p"), F.col("a.q").alias("q"), (F.when(below <= 0, angle).otherwise(-angle) * F.col("a.length")).alias("bend"))
    at = bend.select(F.explode(F.array("p", "q")).alias("vid"), "bend").groupBy("vid").agg(F.sum("bend").alias("bend"))
    area = f.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), (F.col("area") / 3.0).alias("area")).groupBy("vid").agg(F.sum("area").alias("area"))
    return at.join(area, "vid").where("area > 0").select("vid", (F.col("bend") / (4.0 * F.col("area"))).alias("h"))


def sinc_weights(rounds: int, pass_band: float) -> list[float]:
    """Chebyshev coefficients of the low-pass filter, with a Hamming window (Taubin, Zhang and Golub 1996)."""
    theta = math.acos(1 - pass_band / 2)
    w = [(theta / math.pi) if i == 0 else 2 * math.sin(i * theta) / (i * math.pi) for i in range(rounds + 1)]
    w = [c * (0.54 + 0.46 * math.cos(i * math.pi / (rounds + 1))) for i, c in enumerate(w)]
    total = sum(w)  # the filter's value at frequency 0, where every Chebyshev polynomial is 1
    return [c / total for c in w]


def windowed_sinc(faces: DataFrame, vertices: DataFrame, rounds: int = 15, pass_band: float = 0.1) -> DataFrame:
    """Vertices smoothed by a windowed-sinc filter of the ring Laplacian; boundary vertices move along with it.

    One ring join for each round, which is written and read again.
    """
    c = sinc_weights(rounds, pass_band)
    ring = cut(one_ring(faces))

    def mean_step(df: DataFrame, cols: list[str]) -> DataFrame:
        """cols -> x - Laplacian / 2 applied to them, as m_<col>: the mean of a vertex and its ring mean."""
        around = ring.join(df.select(F.col("vid").alias("near"), *cols), "near").groupBy("vid").agg(*[F.avg(x).alias(f"r_{x}") for x in cols])
        met = df.join(around, "vid", "left")
        return met.withColumns({f"m_{x}": (F.col(x) + F.coalesce(f"r_{x}", x)) / 2.0 for x in cols}).drop(*[f"r_{x}" for x in cols])

    # T0 x = x and T1 x = (I - K) x with K in [0, 2]; I - K is twice the mean step less the identity.
    cols = list(XYZ)
    now = mean_step(vertices.select("vid", *cols), cols)
    state = now.select("vid", *cols, *(F.col(x).alias(f"p_{x}") for x in cols), *((2.0 * F.col(f"m_{x}") - F.col(x)).alias(f"q_{x}") for x in cols))
    state = state.withColumns({f"s_{x}": c[0] * F.col(f"p_{x}") + c[1] * F.col(f"q_{x}") for x in cols})
    for i in range(2, rounds + 1):
        nxt = mean_step(state, [f"q_{x}" for x in cols])
        nxt = nxt.withColumns({f"t_{x}": 2.0 * (2.0 * F.col(f"m_q_{x}") - F.col(f"q_{x}")) - F.col(f"p_{x}") for x in cols})
        state = afresh(nxt.select("vid", *(F.col(f"q_{x}").alias(f"p_{x}") for x in cols), *(F.col(f"t_{x}").alias(f"q_{x}") for x in cols), *((F.col(f"s_{x}") + c[i] * F.col(f"t_{x}")).alias(f"s_{x}") for x in cols)))
    return state.select("vid", *(F.col(f"s_{x}").alias(x) for x in cols))


def farthest_from_boundary(faces: DataFrame, vertices: DataFrame, side: DataFrame, rim: DataFrame, least: int = 50) -> DataFrame:
    """One row (vid, d): the vertex of a side (vid) that is farthest from the boundary; of all vertices if the side is
    too small. rim: what stands for the boundary where the mesh has fewer than ten boundary vertices."""
    seeds = boundary(faces)
    if seeds.count() < 10:
        seeds = rim.select("vid")
    d = cut(geodesic(faces, vertices, seeds))
    near = d.join(side.select("vid").distinct(), "vid", "left_semi")
    pick = near if near.count() >= least else d
    return pick.agg(F.max(F.struct(F.col("d"), (-F.col("vid")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("vid"), F.col("b.d").alias("d"))
