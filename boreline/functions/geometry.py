"""Well-path geometry as column expressions (radians, metres; north, east, down)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586

# Fixed values of the published formulas: WGS84 semi-major axis and first eccentricity squared.
WGS84_A = 6378137.0
WGS84_E2 = 0.00669437999014


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def wrap_positive(angle) -> Column:
    """Angle in [0, 2*pi)."""
    a = col(angle)
    return a - F.lit(2.0) * F.pi() * F.floor(a / (F.lit(2.0) * F.pi()))


def wrap_signed(angle) -> Column:
    """Angle in (-pi, pi]."""
    a = col(angle)
    return a - F.lit(2.0) * F.pi() * F.ceil((a - F.pi()) / (F.lit(2.0) * F.pi()))


def clamp(value, low: float, high: float) -> Column:
    return F.least(F.greatest(col(value), F.lit(low)), F.lit(high))


def tangent(inc, az) -> tuple[Column, Column, Column]:
    i, a = col(inc), col(az)
    return F.sin(i) * F.cos(a), F.sin(i) * F.sin(a), F.cos(i)


def dogleg(i1, a1, i2, a2) -> Column:
    """Angle between two directions, half-angle form."""
    i1, a1, i2, a2 = map(col, (i1, a1, i2, a2))
    half_i, half_a = F.sin((i2 - i1) / 2.0), F.sin((a2 - a1) / 2.0)
    return F.lit(2.0) * F.asin(
        F.least(F.lit(1.0), F.sqrt(half_i * half_i + F.sin(i1) * F.sin(i2) * half_a * half_a))
    )


def ratio_factor(dl) -> Column:
    """Arc-over-chord factor, by its series below 0.02 rad."""
    d = col(dl)
    q = d * d
    series = F.lit(1.0) + q / 12.0 * (1.0 + q / 10.0 * (1.0 + q / 168.0 * (1.0 + 31.0 * q / 18.0)))
    return F.when(d < 0.02, series).otherwise(F.lit(2.0) / d * F.tan(d / 2.0))


def norm(*parts) -> Column:
    total = None
    for p in parts:
        p = col(p)
        total = p * p if total is None else total + p * p
    return F.sqrt(total)


def distance3(a: Sequence, b: Sequence) -> Column:
    return norm(*[col(x) - col(y) for x, y in zip(a, b)])


def dot(a: Sequence, b: Sequence) -> Column:
    total = None
    for x, y in zip(a, b):
        term = col(x) * col(y)
        total = term if total is None else total + term
    return total


def polar_xy(radius, toolface) -> tuple[Column, Column]:
    return col(radius) * F.sin(col(toolface)), col(radius) * F.cos(col(toolface))


def quad_form(t: Sequence, c: Sequence) -> Column:
    """t' C t for C given as (c00, c01, c02, c11, c12, c22)."""
    x, y, z = map(col, t)
    c00, c01, c02, c11, c12, c22 = map(col, c)
    return x * x * c00 + y * y * c11 + z * z * c22 + 2.0 * (x * y * c01 + x * z * c02 + y * z * c12)


def bilinear(u: Sequence, v: Sequence, c: Sequence) -> Column:
    """u' C v."""
    c00, c01, c02, c11, c12, c22 = map(col, c)
    rows = ((c00, c01, c02), (c01, c11, c12), (c02, c12, c22))
    return dot(u, [dot(row, v) for row in rows])


def lerp(a, b, u) -> Column:
    a, b = col(a), col(b)
    return a + col(u) * (b - a)


def lerp_or_either(a, b, u) -> Column:
    """Linear between both ends; the defined end when the other is null."""
    return F.coalesce(lerp(a, b, u), col(a), col(b))


def radius_from_diameter(diameter) -> Column:
    d = col(diameter)
    return F.when(d > 0, 0.5 * d)


def finite(value) -> Column:
    """Null for NaN and infinities."""
    v = col(value)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def is_defined(value) -> Column:
    v = col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def meridian_radius(lat) -> Column:
    s = F.sin(col(lat))
    return F.lit(WGS84_A * (1.0 - WGS84_E2)) / F.pow(1.0 - WGS84_E2 * s * s, F.lit(1.5))


def parallel_radius(lat) -> Column:
    s = F.sin(col(lat))
    return F.lit(WGS84_A) * F.cos(col(lat)) / F.sqrt(1.0 - WGS84_E2 * s * s)


def meridian_arc(lat) -> Column:
    """Distance along the meridian from the equator (series of the ellipsoid to the sixth power of eccentricity)."""
    f, e2 = col(lat), WGS84_E2
    e4, e6 = e2 * e2, e2 * e2 * e2
    return F.lit(WGS84_A) * (
        F.lit(1.0 - e2 / 4.0 - 3.0 * e4 / 64.0 - 5.0 * e6 / 256.0) * f
        - F.lit(3.0 * e2 / 8.0 + 3.0 * e4 / 32.0 + 45.0 * e6 / 1024.0) * F.sin(2.0 * f)
        + F.lit(15.0 * e4 / 256.0 + 45.0 * e6 / 1024.0) * F.sin(4.0 * f)
        - F.lit(35.0 * e6 / 3072.0) * F.sin(6.0 * f)
    )


def north_of(lat) -> Column:
    return meridian_arc(lat)


def east_of(lat, lon) -> Column:
    return parallel_radius(lat) * col(lon)


def boxes_overlap(left: str, right: str, axes: Sequence[str] = ("n", "e", "t")) -> Column:
    """Overlap of boxes stored as ``<prefix><axis>_lo`` and ``<prefix><axis>_hi``."""
    test = F.lit(True)
    for a in axes:
        test = (
            test
            & (F.col(f"{left}{a}_lo") <= F.col(f"{right}{a}_hi"))
            & (F.col(f"{left}{a}_hi") >= F.col(f"{right}{a}_lo"))
        )
    return test


def box_gap(left: str, right: str, axes: Sequence[str] = ("n", "e", "t")) -> Column:
    """Smallest distance between two boxes."""
    return norm(
        *[
            F.greatest(
                F.lit(0.0),
                F.col(f"{left}{a}_lo") - F.col(f"{right}{a}_hi"),
                F.col(f"{right}{a}_lo") - F.col(f"{left}{a}_hi"),
            )
            for a in axes
        ]
    )


def segment_parameters(p1: Sequence, q1: Sequence, p2: Sequence, q2: Sequence) -> dict[str, Column]:
    """Building blocks of the closest points between segments p1-q1 and p2-q2 (both of positive length).

    Returns the dot products; ``segment_solution`` turns them into parameters.  Two steps keep each expression small.
    """
    d1 = [col(q) - col(p) for p, q in zip(p1, q1)]
    d2 = [col(q) - col(p) for p, q in zip(p2, q2)]
    r = [col(a) - col(b) for a, b in zip(p1, p2)]
    return {
        "_a": dot(d1, d1),
        "_b": dot(d1, d2),
        "_c": dot(d1, r),
        "_e": dot(d2, d2),
        "_f": dot(d2, r),
    }


def segment_solution() -> list[dict[str, Column]]:
    """Stages giving the clamped parameters ``_s`` (first segment) and ``_t`` (second)."""
    a, b, c, e, f = (F.col(n) for n in ("_a", "_b", "_c", "_e", "_f"))
    den = a * e - b * b
    parallel = den <= 1e-12 * a * e
    s0 = F.when(parallel, F.lit(0.0)).otherwise(clamp((b * f - c * e) / den, 0.0, 1.0))
    s = (
        F.when(F.col("_t0") < 0.0, clamp(-c / a, 0.0, 1.0))
        .when(F.col("_t0") > 1.0, clamp((b - c) / a, 0.0, 1.0))
        .otherwise(F.col("_s0"))
    )
    return [{"_s0": s0}, {"_t0": (b * F.col("_s0") + f) / e}, {"_s": s, "_t": clamp("_t0", 0.0, 1.0)}]


def apply_steps(df, stages):
    """Apply successive stages of ``{name: expression}``; a stage may use the columns of earlier ones."""
    for stage in stages:
        df = df.withColumns(stage)
    return df


def arc_steps(md, a: str = "a_", b: str = "b_") -> list[dict[str, Column]]:
    """Stages giving the station at ``md`` on the circular arc between rows ``a`` and ``b``.

    Needs ``md, inc, az, north, east, tvd`` under both prefixes; adds north, east, tvd, inc, az and the columns of
    ``ARC_HELPERS`` (drop them afterwards).  Values used more than once are columns of an earlier stage.
    """
    t1 = tangent(a + "inc", a + "az")
    t2 = tangent(b + "inc", b + "az")
    ds = F.col(b + "md") - F.col(a + "md")
    u, dl = F.col("_u"), F.col("_dl")
    straight = dl < 1e-9
    along = ("_tn", "_te", "_tt")
    unit = [F.col(t) / F.col("_len") for t in along]
    return [
        {
            "_u": F.when(ds > 0, (col(md) - F.col(a + "md")) / ds).otherwise(F.lit(0.0)),
            "_dl": dogleg(a + "inc", a + "az", b + "inc", b + "az"),
        },
        {
            "_w1": F.when(straight, 1.0 - u).otherwise(F.sin((1.0 - u) * dl) / F.sin(dl)),
            "_w2": F.when(straight, u).otherwise(F.sin(u * dl) / F.sin(dl)),
            "_udl": u * dl,
        },
        {
            **{t: F.col("_w1") * x + F.col("_w2") * y for t, x, y in zip(along, t1, t2)},
            "_half": 0.5 * u * ds * ratio_factor("_udl"),
        },
        {"_len": norm(*along)},
        {
            **{
                axis: F.col(a + axis) + F.col("_half") * (x + t)
                for axis, x, t in zip(("north", "east", "tvd"), t1, unit)
            },
            "inc": F.acos(clamp(unit[2], -1.0, 1.0)),
            "az": wrap_positive(F.atan2(unit[1], unit[0])),
        },
    ]


ARC_HELPERS = ("_u", "_dl", "_udl", "_w1", "_w2", "_tn", "_te", "_tt", "_len", "_half")


def ellipse_2x2(a, b, c, k) -> tuple[Column, Column, Column]:
    """Semi-axes (major, minor) and major-axis angle of k^2-scaled covariance [[a, b], [b, c]]."""
    a, b, c, k = map(col, (a, b, c, k))
    mean = (a + c) / 2.0
    spread = F.sqrt(F.pow((a - c) / 2.0, F.lit(2.0)) + b * b)
    major = k * F.sqrt(F.greatest(mean + spread, F.lit(0.0)))
    minor = k * F.sqrt(F.greatest(mean - spread, F.lit(0.0)))
    return major, minor, 0.5 * F.atan2(2.0 * b, a - c)
