"""Farthest-point subsets and the operators built on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulo.functions.formulas import squared_distance
from cumulo.functions.lattice import snap
from cumulo.operators.anchors import assign
from cumulo.operators.grouping import attach, by_size, per_cloud
from cumulo.session import cut_lineage

AXES = ("x", "y", "z")
# Rounds between folding the chosen anchors into a stored running minimum.
FOLD_EVERY = 16


def _schema(points: DataFrame) -> T.StructType:
    fields = {f.name: f.dataType for f in points.schema.fields}
    return T.StructType([
        T.StructField("cloud_id", fields["cloud_id"]),
        T.StructField("slot", T.IntegerType()),
        T.StructField("point_id", fields["point_id"]),
        *[T.StructField(a, T.DoubleType()) for a in AXES],
    ])


def _in_task(points: DataFrame, size: int, total: int = 0) -> DataFrame:
    def pick(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("point_id").to_numpy(), kind="stable")
        x, y, z, start, weight = (rows.column(c).to_numpy()[order] for c in ("x", "y", "z", "_start", "_weight"))
        nearest = np.full(len(order), np.inf)
        current = int(start.argmax())
        chosen = []
        for _ in range(min(size, len(order))):
            chosen.append(current)
            nearest = np.minimum(nearest, (x - x[current]) ** 2 + (y - y[current]) ** 2 + (z - z[current]) ** 2)
            current = int((nearest * weight).argmax())
        taken = rows.select(["cloud_id", "point_id", "x", "y", "z"]).take(pa.array(order[chosen]))
        return taken.add_column(1, "slot", pa.array(range(len(chosen)), pa.int32()))

    return per_cloud(points, pick, _schema(points), total=total)


def _farthest_row(points: DataFrame, priority: Column, *more: Column) -> DataFrame:
    """The row of highest priority per cloud; ties take the lowest id."""
    held = F.struct("point_id", *AXES)
    return points.groupBy("cloud_id").agg(
        F.max_by(held, F.struct(priority, -F.col("point_id"))).alias("next"), *more
    )


def _spread(points: DataFrame, size: int) -> DataFrame:
    """One fold over the points per round; only the chosen anchors are carried."""
    # Read once per round, so whatever made the points runs only here.
    points = cut_lineage(points.withColumn("_near", F.lit(float("inf"))))
    counted = points.select("cloud_id")
    chosen = _farthest_row(points, F.col("_start")).select("cloud_id", F.array("next").alias("done"))
    pending = 0
    for _ in range(size - 1):
        pending += 1
        recent = F.slice("done", F.greatest(F.size("done") - F.lit(pending - 1), F.lit(1)), pending)
        near = F.least("_near", F.array_min(F.transform(recent, lambda a: squared_distance(
            F.col("x"), F.col("y"), F.col("z"), a["x"], a["y"], a["z"]
        ))))
        met = attach(points, chosen, sized=counted).withColumn("_now", near)
        # The chosen list rides through the fold, so each round reads its predecessor once.
        picked = _farthest_row(met, F.col("_now") * F.col("_weight"), F.any_value("done").alias("done"))
        extended = picked.select("cloud_id", F.concat("done", F.array("next")).alias("done"))
        if pending == FOLD_EVERY:
            points = cut_lineage(met.withColumn("_near", F.col("_now")).drop("done", "_now"))
            extended = cut_lineage(extended)
            pending = 0
        chosen = extended
    return chosen.select("cloud_id", F.posexplode("done").alias("slot", "a")).select("cloud_id", "slot", "a.*")


def _pick(points: DataFrame, size: int, start: Column, weight: Column, bound: int | None) -> DataFrame:
    ready = points.select(
        "cloud_id", "point_id", *AXES, start.alias("_start"), weight.alias("_weight")
    )
    options = {} if bound is None else {"bound": bound}
    sizes = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("_n"))

    def spread(large: DataFrame) -> DataFrame:
        picked = _spread(large, size)
        return picked.join(sizes, "cloud_id").filter(F.col("slot") < F.col("_n")).drop("_n")

    return by_size(ready, lambda d, n: _in_task(d, size, n), spread, sized=points, **options)


def farthest_points(points: DataFrame, size: int, *, bound: int | None = None) -> DataFrame:
    """Start farthest from the centroid, then repeatedly farthest from the chosen set.

    Order of choice is (distance, lowest ``point_id``). Returns one row per
    (cloud, slot) with the chosen ``point_id`` and coordinates.
    """
    centre = points.groupBy("cloud_id").agg(*[F.avg(a).alias(f"_c{a}") for a in AXES])
    placed = attach(points, centre)
    start = squared_distance(*[F.col(a) for a in AXES], *[F.col(f"_c{a}") for a in AXES])
    return _pick(placed, size, start, F.lit(1.0), bound)


def normal_aware_points(points: DataFrame, size: int, *, bound: int | None = None) -> DataFrame:
    """Farthest points with distances weighted by ``1 + variation``.

    ``points`` must hold ``variation``; the first pick has the largest one.
    """
    return _pick(points, size, F.col("variation"), F.lit(1.0) + F.col("variation"), bound)


def seeded_merge(points: DataFrame, size: int, bits: int) -> DataFrame:
    """Merge each cloud into ``size`` group means on the lattice.

    Groups are seeded by farthest points; every point joins its nearest seed and
    every seed stays in its own group.
    """
    seeds = farthest_points(points, size)
    own = seeds.select("cloud_id", "point_id", F.col("slot").alias("_own"))
    joined = assign(points.select("cloud_id", "point_id", *AXES), seeds, size)
    placed = joined.join(own, ["cloud_id", "point_id"], "left").withColumn(
        "slot", F.coalesce("_own", "slot")
    )
    means = placed.groupBy("cloud_id", "slot").agg(*[F.avg(a).alias(a) for a in AXES])
    return means.withColumns({a: snap(F.col(a), bits) for a in AXES})


def merge_path(points: DataFrame, sizes: Sequence[int], bits: int) -> DataFrame:
    """Staged merge through decreasing sizes; one set per stage, keyed by ``k``."""
    if any(a <= b for a, b in zip(sizes, sizes[1:])):
        raise ValueError("stage sizes must decrease")
    current = farthest_points(points, sizes[0])
    current = current.select("cloud_id", "slot", *[snap(F.col(a), bits).alias(a) for a in AXES])
    stages = [current.withColumn("k", F.lit(sizes[0]))]
    for size in sizes[1:]:
        current = cut_lineage(current)
        current = seeded_merge(current.withColumnRenamed("slot", "point_id"), size, bits)
        stages.append(current.withColumn("k", F.lit(size)))
    result = stages[0].select("cloud_id", "k", "slot", *AXES)
    for stage in stages[1:]:
        result = result.unionByName(stage.select("cloud_id", "k", "slot", *AXES))
    return result
