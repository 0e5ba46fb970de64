"""Plane fits and four-corner reconstruction of planar clouds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.formulas import radical_inverse, square
from cumulo.operators.grouping import attach

AXES = ("x", "y", "z")
MOMENTS = tuple(f"c{a}{b}" for i, a in enumerate(AXES) for b in AXES[i:])


def plane_moments(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Centroid and covariance of each cloud in one map-side fold."""
    return points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{a}") for a in AXES],
        *[F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]],
    )


def with_eigenvalues(moments: DataFrame) -> DataFrame:
    """Adds ``e1 >= e2 >= e3`` of the covariance by the trigonometric formula."""
    c = F.col
    off = square(c("cxy")) + square(c("cxz")) + square(c("cyz"))
    stage = moments.withColumn("_q", (c("cxx") + c("cyy") + c("czz")) / F.lit(3.0))
    spread = square(c("cxx") - c("_q")) + square(c("cyy") - c("_q")) + square(c("czz") - c("_q")) + F.lit(2.0) * off
    stage = stage.withColumn("_p", F.sqrt(spread / F.lit(6.0)))
    a, b, d = c("cxx") - c("_q"), c("cyy") - c("_q"), c("czz") - c("_q")
    det = a * (b * d - square(c("cyz"))) - c("cxy") * (c("cxy") * d - c("cyz") * c("cxz")) + c("cxz") * (c("cxy") * c("cyz") - b * c("cxz"))
    cosine = F.when(c("_p") > 0, det / (F.lit(2.0) * c("_p") * c("_p") * c("_p"))).otherwise(F.lit(0.0))
    stage = stage.withColumn("_t", F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))) / F.lit(3.0))
    stage = stage.withColumn("e1", c("_q") + F.lit(2.0) * c("_p") * F.cos("_t"))
    stage = stage.withColumn("e3", c("_q") + F.lit(2.0) * c("_p") * F.cos(c("_t") + F.lit(2.0 * math.pi / 3.0)))
    return stage.withColumn("e2", F.lit(3.0) * c("_q") - c("e1") - c("e3")).drop("_q", "_p", "_t")


def _axis(moments: DataFrame, eigenvalue: str, name: str) -> DataFrame:
    """Unit eigenvector: the longest cross product of two rows of C - e I."""
    c = F.col
    e = c(eigenvalue)
    rows = (
        (c("cxx") - e, c("cxy"), c("cxz")), (c("cxy"), c("cyy") - e, c("cyz")), (c("cxz"), c("cyz"), c("czz") - e),
    )

    def cross(u: tuple, v: tuple) -> Column:
        x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        return F.struct((square(x) + square(y) + square(z)).alias("n"), x.alias("x"), y.alias("y"), z.alias("z"))

    best = F.greatest(cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2]))
    picked = moments.withColumn("_v", best)
    length = F.sqrt("_v.n")
    return picked.withColumns({f"{name}{a}": F.col(f"_v.{a}") / length for a in AXES}).drop("_v")


def fit_planes(points: DataFrame, *, max_rmse: float | None = None, key: str = "cloud_id") -> tuple[DataFrame, DataFrame]:
    """Centroid, principal axes ``u``, ``v`` and plane RMSE per cloud; and rejects.

    Eigenvector signs are arbitrary. Clouds with fewer than four points, no
    two-dimensional extent, or an RMSE above the limit are rejected.
    """
    solved = with_eigenvalues(plane_moments(points, key)).withColumn("plane_rmse", F.sqrt(F.greatest("e3", F.lit(0.0))))
    flat = F.sqrt(F.greatest(F.col("e2"), F.lit(0.0)) * F.col("n")) <= F.lit(2.220446049250313e-16)
    reason = F.when(F.col("n") < 4, "fewer than four points").when(flat, "no two-dimensional extent")
    if max_rmse is not None:
        reason = reason.when(F.col("plane_rmse") > max_rmse, "plane error above the limit")
    judged = solved.withColumn("reason", reason)
    good = _axis(_axis(judged.filter("reason IS NULL"), "e1", "u"), "e3", "w")
    # v completes the frame, so it is exact even when the smaller roots are close.
    good = good.withColumns({
        "vx": F.col("wy") * F.col("uz") - F.col("wz") * F.col("uy"), "vy": F.col("wz") * F.col("ux") - F.col("wx") * F.col("uz"),
        "vz": F.col("wx") * F.col("uy") - F.col("wy") * F.col("ux"),
    })
    return good.drop("reason"), judged.filter("reason IS NOT NULL").select(key, "reason")


def _along(axis: str) -> Column:
    return sum(((F.col(a) - F.col(f"m{a}")) * F.col(f"{axis}{a}") for a in AXES[1:]), (F.col("x") - F.col("mx")) * F.col(f"{axis}x"))


def plane_corners(points: DataFrame, *, max_rmse: float | None = None, key: str = "cloud_id") -> tuple[DataFrame, DataFrame]:
    """Four corners of the principal rectangle of each cloud (corner, x, y, z)."""
    planes, rejected = fit_planes(points, max_rmse=max_rmse, key=key)
    placed = attach(points, planes, key).withColumns({"_a": _along("u"), "_b": _along("v")})
    box = placed.groupBy(key).agg(F.min("_a").alias("lu"), F.max("_a").alias("hu"), F.min("_b").alias("lv"), F.max("_b").alias("hv"))
    corners = F.array(*[
        F.struct(F.lit(i).alias("corner"), F.col(a).alias("s"), F.col(b).alias("t"))
        for i, (a, b) in enumerate((("lu", "lv"), ("hu", "lv"), ("hu", "hv"), ("lu", "hv")))
    ])
    spread = planes.join(box, key).select("*", F.inline(corners))
    return spread.select(
        key, "corner", *[(F.col(f"m{a}") + F.col("s") * F.col(f"u{a}") + F.col("t") * F.col(f"v{a}")).alias(a) for a in AXES]
    ), rejected


def cyclic_corners(corners: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Corners numbered by angle around their centroid, whatever their stored order."""
    planes, _ = fit_planes(corners, key=key)
    turned = corners.join(planes, key).withColumn("_angle", F.atan2(_along("v"), _along("u")))
    # Four rows per cloud.
    order = F.row_number().over(Window.partitionBy(key).orderBy("_angle")) - 1
    return turned.select(key, order.alias("corner"), *AXES)


def square_samples(count: int) -> Column:
    """Array of (u, v) samples of the unit square, symmetric under relabelled corners.

    Low-discrepancy seeds in bases 2 and 3, each repeated in all eight symmetries
    of the square; four leftovers go to the corners, the rest to the centre.
    """
    orbits, rest = divmod(count, 8)

    def point(u: Column, v: Column) -> Column:
        return F.struct(u.alias("u"), v.alias("v"))

    one = F.lit(1.0)
    groups = []
    if orbits:
        seeds = F.transform(F.sequence(F.lit(1), F.lit(orbits)), lambda i: F.struct(
            radical_inverse(i, 2).alias("u"), radical_inverse(i, 3).alias("v")
        ))
        groups.append(F.flatten(F.transform(seeds, lambda p: F.array(*[
            point(a, b)
            for first, second in ((p["u"], p["v"]), (p["v"], p["u"]))
            for a in (first, one - first) for b in (second, one - second)
        ]))))
    if rest >= 4:
        groups.append(F.array(*[point(F.lit(a), F.lit(b)) for a in (0.0, 1.0) for b in (0.0, 1.0)]))
        rest -= 4
    if rest:
        groups.append(F.array(*[point(F.lit(0.5), F.lit(0.5))] * rest))
    return F.concat(*groups)


def decode_corners(corners: DataFrame, count: int, key: str = "cloud_id") -> DataFrame:
    """Blend four corners bilinearly at the fixed samples: (point_id, x, y, z)."""
    if count < 1:
        raise ValueError("count must be positive")
    ordered = cyclic_corners(corners, key).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("corner", *AXES))).alias("_c")
    )
    spread = ordered.select(key, "_c", F.posexplode(square_samples(count)).alias("point_id", "_s"))
    u, v, one = F.col("_s.u"), F.col("_s.v"), F.lit(1.0)
    weights = ((one - u) * (one - v), u * (one - v), u * v, (one - u) * v)
    return spread.select(key, F.col("point_id").cast("bigint").alias("point_id"), *[
        sum((w * F.col("_c")[i + 1][a] for i, w in enumerate(weights[1:])), weights[0] * F.col("_c")[0][a]).alias(a) for a in AXES
    ])


def corner_plane_error(points: DataFrame, corners: DataFrame, key: str = "cloud_id") -> DataFrame:
    """RMSE of points to the plane through a cloud's four corners."""
    planes, _ = fit_planes(corners, key=key)
    return attach(points, planes, key).groupBy(key).agg(F.sqrt(F.avg(square(_along("w")))).alias("corner_plane_rmse"))
