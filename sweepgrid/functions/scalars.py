"""Scalar formulas as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PI2 = 6.283185307179586


def num(x: float | int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    return F.least(F.greatest(x, num(lo)), num(hi))


def ang_norm(a: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(a + F.pi(), F.lit(2.0) * F.pi()) - F.pi()


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def linspace(i: Column, lo: float | Column, hi: float | Column, n: int | Column) -> Column:
    """The i-th of n points from lo to hi, both included."""
    last = F.greatest(num(n) - 1.0, F.lit(1.0))
    return num(lo) + (num(hi) - num(lo)) * i.cast("double") / last


def line_intersection(l1: Sequence[Column], l2: Sequence[Column], eps: float = 1e-9) -> Column:
    """Where lines (x, y, vx, vy) meet, as a struct; null where they are parallel."""
    (x1, y1, a1, b1), (x2, y2, a2, b2) = l1, l2
    cross = a1 * b2 - b1 * a2
    along = ((x2 - x1) * b2 - (y2 - y1) * a2) / cross
    return F.when(F.abs(cross) >= eps, F.struct((x1 + along * a1).alias("x"), (y1 + along * b1).alias("y")))


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * num(b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * num(y)
    return out


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def fixed_text(v: Column, digits: int) -> Column:
    """v with a fixed number of decimals, rounded by its exact binary value, a tie to even; as C and Python print it.

    v * 10**digits is held as the sum of a double and its error (a product of split halves), so that its place
    against the half is known exactly. Beyond 2**52 nothing is left to round.
    """
    v, m = v.cast("double"), float(10**digits)
    x = F.when(F.abs(v) * m < 2.0**52, F.abs(v))
    p = x * m
    c = x * 134217729.0
    high = c - (c - x)
    error = (high * m - p) + (x - high) * m
    n = F.floor(p).cast("long")
    over = (p - (n + 0.5)) + error
    # The product itself may have been rounded up to a whole number.
    n = F.when((p == n.cast("double")) & (error < 0), n - 1).otherwise(n)
    over = F.when((p == (n + 1).cast("double")) & (error < 0), F.lit(0.5)).otherwise(over)
    k = n + F.when((over > 0) | ((over == 0) & (F.pmod(n, F.lit(2)) == 1)), 1).otherwise(0)
    whole = F.floor(k / F.lit(10**digits)).cast("long") if digits else k
    rest = F.concat(F.lit("."), F.lpad((k - whole * 10**digits).cast("string"), digits, "0")) if digits else F.lit("")
    minus = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
    usual = F.concat(minus, whole.cast("string"), rest)
    return F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.concat(minus, F.lit("inf"))).when(p.isNotNull(), usual).otherwise(F.format_string(f"%.{digits}f", v))


def hms(seconds: Column) -> Column:
    """Whole seconds as H:MM:SS, with days before them as timedelta prints them."""
    s = F.floor(seconds).cast("long")
    day = F.floor(s / 86400)
    rest = F.pmod(s, F.lit(86400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
    return F.when(day == 0, clock).otherwise(F.concat(day.cast("string"), F.when(F.abs(day) == 1, " day, ").otherwise(" days, "), clock))


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, the largest first (trigonometric form, Smith 1961)."""
    q = (xx + yy + zz) / 3.0
    p2 = (xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2.0 * (xy**2 + xz**2 + yz**2)
    p = F.sqrt(p2 / 6.0)
    safe = F.when(p > 0, p).otherwise(1.0)
    a, b, c = (xx - q) / safe, (yy - q) / safe, (zz - q) / safe
    d, e, f = xy / safe, xz / safe, yz / safe
    half_det = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2.0
    phi = F.acos(clip(half_det, -1.0, 1.0)) / 3.0
    top = q + 2.0 * p * F.cos(phi)
    low = q + 2.0 * p * F.cos(phi + 2.0943951023931953)
    return top, 3.0 * q - top - low, low


def affine(row: Sequence[float], x: Column, y: Column, z: Column) -> Column:
    """One row of a 4 x 4 index-to-space matrix."""
    return num(row[0]) * x + num(row[1]) * y + num(row[2]) * z + num(row[3])


def ijk_to_ras(spacing: Sequence[float], origin: Sequence[float], direction: Sequence[Sequence[float]] | None = None) -> list[list[float]]:
    """4 x 4 matrix from spacing, origin and direction in LPS: signs of x and y flip."""
    direction = direction or [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    sign = (-1.0, -1.0, 1.0)
    rows = [[sign[i] * direction[i][j] * spacing[j] for j in range(3)] + [sign[i] * origin[i]] for i in range(3)]
    return [*rows, [0.0, 0.0, 0.0, 1.0]]
