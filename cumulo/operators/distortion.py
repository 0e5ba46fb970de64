"""Distances between two clouds of comparable size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulo.functions.formulas import GOLDEN_ANGLE, psnr, sphere_direction, square
from cumulo.operators.grouping import by_size, dealt_if_many, per_cloud
from cumulo.operators.neighbors import AXES, nearest
from cumulo.operators.ranking import quantiles, spread_rank
from cumulo.session import cut_lineage

NORMALS = ("nx", "ny", "nz")


def _along(normal: tuple[str, ...], sign: float) -> Column:
    """Offset between matched points measured along a normal."""
    return sum(
        (F.lit(sign) * (F.col(a) - F.col(f"t{a}")) * F.col(n) for a, n in zip(AXES[1:], normal[1:])),
        F.lit(sign) * (F.col("x") - F.col("tx")) * F.col(normal[0]),
    )


def geometry_metrics(reconstruction: DataFrame, target: DataFrame, *, peak: float = 2.0) -> DataFrame:
    """Chamfer, point-to-point, point-to-plane, tails and Hausdorff per cloud.

    Only the target carries normals: forward matches use the matched target
    point's normal, backward matches the target point's own.
    """
    keys = ["cloud_id", "point_id"]

    def matched(rows: DataFrame, found: DataFrame) -> DataFrame:
        total = rows.count()
        return dealt_if_many(rows, keys, total).join(dealt_if_many(found, keys, total), keys)

    forward = matched(reconstruction.select(*keys, *AXES), nearest(reconstruction, target, carry=NORMALS))
    backward = matched(target.select(*keys, *AXES, *NORMALS), nearest(target, reconstruction))
    # Stored, as the means and the tails read different columns of it: the clouds would be matched for each.
    both = cut_lineage(forward.select("cloud_id", "point_id", "d2", _along(NORMALS, 1.0).alias("plane"), F.lit("f").alias("way")).unionByName(
        backward.select("cloud_id", "point_id", "d2", _along(NORMALS, 1.0).alias("plane"), F.lit("b").alias("way"))
    ))

    def mean(value: Column, way: str) -> Column:
        return F.avg(F.when(F.col("way") == way, value))

    folded = both.groupBy("cloud_id").agg(
        mean(F.col("d2"), "f").alias("_f"), mean(F.col("d2"), "b").alias("_b"),
        mean(square(F.col("plane")), "f").alias("_pf"), mean(square(F.col("plane")), "b").alias("_pb"),
        F.sqrt(F.max("d2")).alias("hausdorff"),
    )
    pooled = both.select("cloud_id", F.sqrt("d2").alias("d"), F.concat("way", F.col("point_id").cast("string")).alias("tie"))
    tails = quantiles(pooled, ["cloud_id"], "d", "tie", (0.95, 0.99), ("p95", "p99"),
                      sized=reconstruction.select("cloud_id").unionByName(target.select("cloud_id")))
    mse, d1, d2 = F.lit(0.5) * (F.col("_f") + F.col("_b")), F.greatest("_f", "_b"), F.greatest("_pf", "_pb")
    return folded.join(tails, "cloud_id").select(
        "cloud_id", mse.alias("chamfer_mse"), F.sqrt(mse).alias("chamfer_rmse"),
        d1.alias("d1_mse"), psnr(d1, peak).alias("d1_psnr_db"), d2.alias("d2_mse"), psnr(d2, peak).alias("d2_psnr_db"),
        "p95", "p99", "hausdorff",
    )


def sliced_wasserstein(reconstruction: DataFrame, target: DataFrame, directions: int = 32) -> DataFrame:
    """RMS gap between sorted projections, averaged over fixed directions.

    Unequal sizes read the target's sorted values at evenly spaced fractional
    ranks. Small clouds are projected and sorted inside a task, so no row per
    point and direction is shuffled; the ranks of large ones come from range splits.
    """
    tagged = reconstruction.select("cloud_id", "point_id", *AXES, F.lit(True).alias("first")).unionByName(
        target.select("cloud_id", "point_id", *AXES, F.lit(False).alias("first"))
    )
    schema = T.StructType([tagged.schema["cloud_id"], T.StructField("sliced_wasserstein", T.DoubleType())])
    return by_size(
        tagged.filter("cloud_id IS NOT NULL"),
        lambda d, n: per_cloud(d, _projected_gap(schema, directions), schema, total=n),
        lambda d: _spread_gap(d, directions),
    )


def _projected_gap(schema: T.StructType, directions: int) -> Callable[[pa.Table], pa.Table]:
    """The gap of one cloud; the order is that of the spread form: nulls first, then by value and id."""
    i = np.arange(directions)
    z = 1.0 - 2.0 * (i + 0.5) / directions
    ring, turn = np.sqrt(np.maximum(1.0 - z * z, 0.0)), i * GOLDEN_ANGLE
    fan = (ring * np.cos(turn), ring * np.sin(turn), z)

    def ordered(xyz: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per direction: sorted values, which of them are missing, and the ids in that order."""
        start = np.lexsort((ids, ~missing))
        xyz, missing, ids = xyz[start], missing[start], ids[start]
        values = sum((xyz[None, :, k] * fan[k][:, None] for k in (1, 2)), xyz[None, :, 0] * fan[0][:, None])
        values[:, missing] = -np.inf
        order = np.argsort(values, axis=1, kind="stable")
        return np.take_along_axis(values, order, axis=1), missing[order], ids[order]

    def measure(rows: pa.Table) -> pa.Table:
        columns = [rows.column(a) for a in AXES]
        missing = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])
        xyz = np.stack([pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        ids = pc.rank(rows.column("point_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        first = rows.column("first").to_numpy(zero_copy_only=False)
        n, m = int(first.sum()), int((~first).sum())
        names = [f.name for f in schema.fields]
        if not n or not m:
            return pa.table({names[0]: rows.column("cloud_id").slice(0, 0), names[1]: pa.array([], pa.float64())})
        value, gone, own = ordered(xyz[first], missing[first], ids[first])
        other, absent, _ = ordered(xyz[~first], missing[~first], ids[~first])
        position = np.arange(n) * (m - 1) / max(n - 1, 1) if n != m else np.arange(n, dtype=float)
        low, high = np.floor(position).astype(int), np.ceil(position).astype(int)
        weight = position - low
        # A missing order statistic adds nothing; a position between two of them is missing where both are.
        below = np.where(absent[:, low], 0.0, (1.0 - weight) * np.where(absent[:, low], 0.0, other[:, low]))
        above = np.where((high == low) | absent[:, high], 0.0, weight * np.where(absent[:, high], 0.0, other[:, high]))
        read, unread = below + above, absent[:, low] & absent[:, high]
        # Rows of one id count as one, with the sum of what they read.
        kept, place = np.unique(own, return_inverse=True)
        if len(kept) < n:
            line = np.arange(directions)[:, None] * len(kept) + place.reshape(own.shape)
            size = directions * len(kept)
            sums = np.bincount(line.ravel(), np.where(unread, 0.0, read).ravel(), size)
            unread = np.bincount(line.ravel(), ~unread.ravel(), size) == 0
            one, empty = np.zeros(size), np.zeros(size, bool)
            one[line.ravel()], empty[line.ravel()] = value.ravel(), gone.ravel()
            value, gone, read = one, empty, sums
        there = ~(gone | unread)
        gap = np.sqrt(np.mean((value[there] - read[there]) ** 2)) if there.any() else None
        return pa.table({names[0]: rows.column("cloud_id").slice(0, 1), names[1]: pa.array([gap], pa.float64())})

    return measure


def _spread_gap(tagged: DataFrame, directions: int) -> DataFrame:
    """The gap of large clouds by ranks over range splits.

    Rows per point and direction are far more than their table's size tells the
    planner, so they are sorted and merged, never broadcast.
    """
    fan = F.explode(F.array(*[
        F.struct(F.lit(i).alias("direction"), *[v.alias(f"v{a}") for a, v in zip(AXES, sphere_direction(F.lit(i), directions))])
        for i in range(directions)
    ]))
    shadow = F.col("x") * F.col("v.vx") + F.col("y") * F.col("v.vy") + F.col("z") * F.col("v.vz")
    cast = tagged.withColumn("v", fan).select("cloud_id", "point_id", "first", F.col("v.direction").alias("direction"), shadow.alias("value"))
    ranked = spread_rank(cast, ["cloud_id", "direction", "first"], ["value", "point_id"])
    sizes = tagged.groupBy("cloud_id").agg(F.count_if("first").alias("n_first"), F.count_if(~F.col("first")).alias("n_second"))
    first = ranked.filter("first").join(sizes.hint("merge"), "cloud_id").withColumn(
        "position",
        F.when(F.col("n_first") == F.col("n_second"), F.col("rank").cast("double"))
        .when(F.col("n_first") == 1, F.lit(0.0))
        .otherwise(F.col("rank") * (F.col("n_second") - 1) / (F.col("n_first") - 1)),
    )
    low = F.floor("position")
    # One join row per needed order statistic, weighted, then folded back.
    needed = first.select(
        "cloud_id", "direction", "point_id", "value",
        F.explode(F.when(F.ceil("position") == low, F.array(F.struct(low.alias("rank"), F.lit(1.0).alias("w")))).otherwise(F.array(
            F.struct(low.alias("rank"), (F.lit(1.0) - (F.col("position") - low)).alias("w")),
            F.struct((low + 1).alias("rank"), (F.col("position") - low).alias("w")),
        ))).alias("need"),
    ).select("cloud_id", "direction", "point_id", "value", "need.rank", "need.w")
    second = ranked.filter(~F.col("first")).select("cloud_id", "direction", "rank", F.col("value").alias("other"))
    matched = needed.join(second.hint("merge"), ["cloud_id", "direction", "rank"]).groupBy("cloud_id", "direction", "point_id").agg(
        F.any_value("value").alias("value"), F.sum(F.col("w") * F.col("other")).alias("other")
    )
    return matched.groupBy("cloud_id").agg(F.sqrt(F.avg(square(F.col("value") - F.col("other")))).alias("sliced_wasserstein"))
