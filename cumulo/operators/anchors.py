"""Everything that compares a cloud with a small anchor set, in one pass.

An anchor set has a fixed size K, so each cloud's anchors travel as one array
row. Points meet that row once, the K distances are plain columns, and results
are folded map-side: no point-anchor pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.formulas import let, square, squared_distance
from cumulo.operators.grouping import attach
from cumulo.operators.ranking import quantiles

# Up to this size the K distances are unrolled into generated code.
UNROLLED = 32

KEY = ("cloud_id",)


def anchor_rows(anchors: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per set: ``anchors`` array ordered by slot, and its size ``k``."""
    packed = F.array_sort(F.collect_list(F.struct("slot", "x", "y", "z")))
    return anchors.groupBy(*keys).agg(packed.alias("anchors"), F.count(F.lit(1)).alias("k"))


def _distance(a: Column) -> Column:
    return squared_distance(F.col("x"), F.col("y"), F.col("z"), a["x"], a["y"], a["z"])


def distance_array(size: int | None) -> Column:
    """Squared distance to every anchor; unrolled when the size is known and small."""
    if size is not None and size <= UNROLLED:
        return F.array(*[_distance(F.get("anchors", F.lit(i))) for i in range(size)])
    return F.transform("anchors", _distance)


def with_distances(points: DataFrame, anchors: DataFrame, size: int | None, keys: Sequence[str] = KEY) -> DataFrame:
    """Points with ``k``, ``anchors`` and ``d2s``. Points are matched on ``cloud_id``;
    further ``keys`` tell several sets of one cloud apart."""
    return attach(points, anchor_rows(anchors, keys)).withColumn("d2s", distance_array(size))


def nearest_slot(dists: Column = None) -> Column:
    """Index of the first smallest distance."""
    dists = F.col("d2s") if dists is None else dists
    return F.array_position(dists, F.array_min(dists)).cast("int") - F.lit(1)


def assign(points: DataFrame, anchors: DataFrame, size: int | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Nearest anchor of each point: ``slot`` and ``d2``. Ties take the lowest slot."""
    extra = [k for k in keys if k not in points.columns]
    met = with_distances(points, anchors, size, keys)
    return met.select(
        *extra, *points.columns,
        F.get(F.col("anchors"), nearest_slot())["slot"].alias("slot"),
        F.array_min("d2s").alias("d2"),
    )


def _per_slot_minimum(met: DataFrame, size: int | None, keys: Sequence[str], extra: list[Column]) -> DataFrame:
    """Fold to one row per set: ``slot_min`` array plus the ``extra`` aggregates."""
    if size is not None and size <= UNROLLED:
        lows = [F.min(F.get("d2s", F.lit(i))).alias(f"_m{i}") for i in range(size)]
        folded = met.groupBy(*keys).agg(*lows, *extra)
        packed = F.filter(F.array(*[F.col(f"_m{i}") for i in range(size)]), lambda v: v.isNotNull())
        return folded.withColumn("slot_min", packed).drop(*[f"_m{i}" for i in range(size)])
    lows = (
        met.select(*keys, F.posexplode("d2s").alias("slot", "_d"))
        .groupBy(*keys, "slot").agg(F.min("_d").alias("_d"))
        .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "_d"))), lambda s: s["_d"]).alias("slot_min"))
    )
    return lows.join(met.groupBy(*keys).agg(*extra), list(keys))


def _mean(values: Column) -> Column:
    return total(values) / F.size(values)


def set_quality(points: DataFrame, anchors: DataFrame, size: int | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Per set: Chamfer, surface, coverage, Hausdorff and anchor separation.

    ``surface`` runs from anchors to the cloud, ``coverage`` from the cloud to
    anchors. One scan of the points, one row per (map task, set) shuffled.
    """
    met = with_distances(points, anchors, size, keys)
    nearest = F.array_min("d2s")
    folded = _per_slot_minimum(met, size, keys, [
        F.count(F.lit(1)).alias("n"),
        F.avg(nearest).alias("coverage"),
        F.max(nearest).alias("_far"),
    ])
    surface = _mean(F.col("slot_min"))
    scored = folded.select(
        *keys, "n", F.size("slot_min").alias("k"), "coverage", surface.alias("surface"),
        F.sqrt(F.greatest(F.col("_far"), F.array_max("slot_min"))).alias("hausdorff"),
    )
    scored = scored.withColumn("chamfer_mse", F.lit(0.5) * (F.col("surface") + F.col("coverage")))
    return scored.join(separation(anchors, keys), list(keys)).withColumn("chamfer_rmse", F.sqrt("chamfer_mse"))


def chamfer(points: DataFrame, anchors: DataFrame, size: int | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Chamfer mean squared error of each anchor set against its cloud."""
    met = with_distances(points, anchors, size, keys)
    folded = _per_slot_minimum(met, size, keys, [F.avg(F.array_min("d2s")).alias("coverage")])
    return folded.select(
        *keys, (F.lit(0.5) * (_mean(F.col("slot_min")) + F.col("coverage"))).alias("chamfer_mse")
    )


def _others(rows: Column, i: Column) -> Column:
    return F.filter(rows, lambda _, j: j != i)


def _between(a: Column, b: Column) -> Column:
    return squared_distance(a["x"], a["y"], a["z"], b["x"], b["y"], b["z"])


def separation(anchors: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean distance from each anchor to its nearest other anchor."""
    nearest = F.transform(
        "anchors",
        lambda a, i: F.sqrt(F.array_min(F.transform(_others(F.col("anchors"), i), lambda b: _between(a, b)))),
    )
    return anchor_rows(anchors, keys).select(
        *keys, F.when(F.col("k") > 1, _mean(nearest)).alias("separation")
    )


def repulsion(anchors: DataFrame, margin: float = 0.1, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean hinge ``max(margin^2 - d^2, 0)`` over the K x K pairs; the diagonal adds nothing."""
    hinge = F.transform("anchors", lambda a, i: F.aggregate(
        _others(F.col("anchors"), i), F.lit(0.0),
        lambda so_far, b: so_far + F.greatest(F.lit(margin * margin) - _between(a, b), F.lit(0.0)),
    ))
    return anchor_rows(anchors, keys).select(*keys, (total(hinge) / (F.col("k") * F.col("k"))).alias("repulsion"))


def set_loss(points: DataFrame, anchors: DataFrame, *, size: int | None = None, surface_weight: float = 0.1,
             repulsion_weight: float = 0.01, margin: float = 0.1) -> DataFrame:
    """Weighted composite of Chamfer, surface and repulsion per cloud."""
    quality = set_quality(points, anchors, size).select("cloud_id", F.col("chamfer_mse").alias("chamfer"), "surface")
    return quality.join(repulsion(anchors, margin), "cloud_id").withColumn(
        "loss",
        F.col("chamfer") + F.lit(surface_weight) * F.col("surface") + F.lit(repulsion_weight) * F.col("repulsion"),
    )


def tail_distances(points: DataFrame, anchors: DataFrame, size: int | None = None) -> DataFrame:
    """p95, p99 and maximum of the pooled two-way Euclidean nearest distances."""
    met = with_distances(points, anchors, size)
    to_anchor = met.select("cloud_id", F.sqrt(F.array_min("d2s")).alias("d"), F.col("point_id").cast("string").alias("tie"))
    to_cloud = _per_slot_minimum(met, size, KEY, [F.count(F.lit(1)).alias("n")]).select(
        "cloud_id", F.posexplode(F.transform("slot_min", lambda v: F.sqrt(v))).alias("tie", "d")
    ).select("cloud_id", "d", F.concat(F.lit("slot"), F.col("tie").cast("string")).alias("tie"))
    pooled = to_anchor.unionByName(to_cloud)
    tails = quantiles(pooled, ["cloud_id"], "d", "tie", (0.95, 0.99), ("p95", "p99"), sized=points)
    return tails.join(pooled.groupBy("cloud_id").agg(F.max("d").alias("hausdorff")), "cloud_id")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def softmax(scores: Column) -> Column:
    """Normalized exponentials of an array, shifted by its maximum."""
    def raised(values: Column) -> Column:
        return let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))

    return let(scores, lambda values: let(raised(values), lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t))))
