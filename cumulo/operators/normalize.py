"""Centering, scaling and rigid motion. Per-cloud constants are aggregated and
joined back, so no cloud is ever gathered into a window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.formulas import square
from cumulo.operators.grouping import attach, by_cloud


def _shift(points: DataFrame, origin: DataFrame, key: str) -> DataFrame:
    return attach(points, origin, key).select(
        *[c for c in points.columns if c not in ("x", "y", "z")],
        (F.col("x") - F.col("_ox")).alias("x"),
        (F.col("y") - F.col("_oy")).alias("y"),
        (F.col("z") - F.col("_oz")).alias("z"),
    )


def _radius(points: DataFrame, key: str) -> DataFrame:
    reach = F.sqrt(square(F.col("x")) + square(F.col("y")) + square(F.col("z")))
    return points.groupBy(key).agg(F.max(reach).alias("_radius"))


def _scale(points: DataFrame, radius: DataFrame, key: str, sized: DataFrame) -> DataFrame:
    scaled = attach(points, radius, key, sized=sized)
    for axis in ("x", "y", "z"):
        scaled = scaled.withColumn(axis, F.col(axis) / F.col("_radius"))
    return scaled.drop("_radius")


def center_unit_radius(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Mean-centre each cloud and divide by its largest radius (floored at 1e-8).

    Normals, when present, are rescaled to unit length with the same floor.
    """
    points = by_cloud(points, key)
    origin = points.groupBy(key).agg(F.avg("x").alias("_ox"), F.avg("y").alias("_oy"), F.avg("z").alias("_oz"))
    shifted = _shift(points, origin, key)
    radius = _radius(shifted, key).withColumn("_radius", F.greatest("_radius", F.lit(1e-8)))
    result = _scale(shifted, radius, key, points)
    if "nx" in points.columns:
        length = F.greatest(
            F.sqrt(square(F.col("nx")) + square(F.col("ny")) + square(F.col("nz"))), F.lit(1e-8)
        )
        result = result.withColumn("_len", length)
        for axis in ("nx", "ny", "nz"):
            result = result.withColumn(axis, F.col(axis) / F.col("_len"))
        result = result.drop("_len")
    return result.select(*points.columns)


def box_center_unit_radius(vertices: DataFrame, key: str = "mesh_id") -> tuple[DataFrame, DataFrame]:
    """Move the bounding-box centre to the origin, then scale to unit radius.

    Returns the normalized vertices and the meshes without spatial extent.
    """
    origin = vertices.groupBy(key).agg(
        *[(F.lit(0.5) * (F.min(a) + F.max(a))).alias(f"_o{a}") for a in ("x", "y", "z")]
    )
    shifted = _shift(vertices, origin, key)
    radius = _radius(shifted, key)
    flat = radius.filter(F.col("_radius") <= 1e-12).select(key, F.lit("mesh has no spatial extent").alias("reason"))
    result = _scale(shifted, radius.filter(F.col("_radius") > 1e-12), key, vertices)
    return result.select(*vertices.columns), flat


def rigid_transform(points: DataFrame, motions: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Rotate and translate each cloud.

    ``motions`` has one row per cloud: ``r00 .. r22`` and ``tx, ty, tz``. Normals
    are rotated only.
    """
    joined = attach(points, motions, key)

    def turned(row: int, axes: tuple[str, str, str]) -> Column:
        return sum(
            (F.col(f"r{row}{i}") * F.col(a) for i, a in enumerate(axes[1:], 1)),
            F.col(f"r{row}0") * F.col(axes[0]),
        )

    axes, normals = ("x", "y", "z"), ("nx", "ny", "nz")
    changed = {a: turned(i, axes) + F.col(f"t{a}") for i, a in enumerate(axes)}
    if "nx" in points.columns:
        changed |= {a: turned(i, normals) for i, a in enumerate(normals)}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in points.columns])


def first_points(points: DataFrame, size: int, order: str = "point_ix") -> DataFrame:
    """The leading ``size`` points of every cloud by their stored position."""
    return points.filter(F.col(order) < size)


def pick_role(points: DataFrame, training_target: str = "source") -> DataFrame:
    """Rows tagged for each use: ``source``, ``target`` and ``fresh``.

    The training target repeats the source sample or takes the independent one;
    the fresh sample is always the independent one.
    """
    if training_target not in ("source", "independent"):
        raise ValueError("training_target must be 'source' or 'independent'")
    sampled = F.when(F.col("role") == "source", F.array(F.lit("source"), *(
        [F.lit("target")] if training_target == "source" else []
    ))).otherwise(F.array(*([F.lit("target")] if training_target == "independent" else []), F.lit("fresh")))
    return points.withColumn("role", F.explode(sampled))
