"""One-to-one assignments between small sets and clouds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulo.functions.lattice import snap
from cumulo.operators.neighbors import AXES, nearest


def unique_projection(anchors: DataFrame, points: DataFrame, size: int, bits: int | None = None) -> DataFrame:
    """Give every anchor its own input point, globally nearest pairs first.

    At most ``size - 1`` points are taken before a slot is served, so its answer
    is among its ``size`` nearest points: only those size x size pairs per cloud
    are ordered in one place.
    """
    id_type = points.schema["point_id"].dataType
    source = anchors.select("cloud_id", F.col("slot").cast(id_type).alias("point_id"), *AXES)
    pairs = nearest(source, points, k=size).select(
        "cloud_id", F.col("point_id").cast("int").alias("slot"), F.col("target_id").alias("point_id"),
        F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"), "d2",
    )
    schema = pairs.schema

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["d2", "slot", "point_id"], kind="stable")
        slots, taken, keep = set(), set(), []
        for i, (slot, point) in enumerate(zip(rows["slot"], rows["point_id"])):
            if slot not in slots and point not in taken:
                slots.add(slot)
                taken.add(point)
                keep.append(i)
        return rows.iloc[keep]

    served = pairs.groupBy("cloud_id").applyInPandas(serve, schema)
    return served if bits is None else served.withColumns({a: snap(F.col(a), bits) for a in AXES})


def _cheapest(cost: np.ndarray) -> float:
    """Total of the cheapest perfect matching, by shortest augmenting paths."""
    size = len(cost)
    row_of = np.full(size, -1)
    price = np.zeros(size)
    for start in range(size):
        reach = cost[start] - price
        via = np.full(size, -1)
        settled = np.zeros(size, dtype=bool)
        while True:
            column = int(np.where(settled, np.inf, reach).argmin())
            settled[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
            slack = cost[row] - price
            step = reach[column] + slack - slack[column]
            better = ~settled & (step < reach)
            reach[better] = step[better]
            via[better] = column
        goal = reach[column]
        price[settled] += reach[settled] - goal
        while via[column] >= 0:
            row_of[column] = row_of[via[column]]
            column = via[column]
        row_of[column] = start
    return float(cost[row_of, np.arange(size)].sum())


@F.pandas_udf(T.DoubleType())
def _matched_rmse(first: pd.Series, second: pd.Series) -> pd.Series:
    def one(a, b) -> float:
        a, b = np.stack(a).astype(np.float64), np.stack(b).astype(np.float64)
        cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return float(np.sqrt(_cheapest(cost) / len(cost)))

    return pd.Series([one(a, b) for a, b in zip(first, second)], dtype="float64")


def coordinate_rows(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per set with ``coords``: an array of [x, y, z] in slot order."""
    packed = F.transform(
        F.array_sort(F.collect_list(F.struct("slot", *AXES))), lambda p: F.array(p["x"], p["y"], p["z"])
    )
    return sets.groupBy(*keys).agg(packed.alias("coords"))


def matched_rmse(first: Column, second: Column) -> Column:
    """RMS separation of two equal-size coordinate arrays under the best matching."""
    return _matched_rmse(first, second)


def matched_set_rmse(first: DataFrame, second: DataFrame, keys: Sequence[str] = ("cloud_id",)) -> DataFrame:
    a = coordinate_rows(first, keys).withColumnRenamed("coords", "_a")
    b = coordinate_rows(second, keys).withColumnRenamed("coords", "_b")
    return a.join(b, list(keys)).select(*keys, matched_rmse(F.col("_a"), F.col("_b")).alias("matched_rmse"))


def multimodality(sets: DataFrame, losses: DataFrame, *, tolerance: float = 0.03, separation: float = 0.05) -> DataFrame:
    """Per cloud: restarts comparable with the best, and how far apart they lie.

    ``sets`` is keyed by (cloud_id, candidate_id), ``losses`` holds ``loss`` per
    key. The number of restarts is a design constant; only comparable restarts of
    one cloud are paired.
    """
    best = losses.groupBy("cloud_id").agg(F.min("loss").alias("best_loss"))
    near = losses.join(best, "cloud_id").filter(
        F.col("loss") <= F.col("best_loss") * F.lit(1.0 + tolerance) + F.lit(1e-12)
    ).select("cloud_id", "candidate_id", "best_loss")
    packed = coordinate_rows(sets, ("cloud_id", "candidate_id")).join(near, ["cloud_id", "candidate_id"])
    gathered = packed.groupBy("cloud_id").agg(
        F.max("best_loss").alias("best_loss"), F.count(F.lit(1)).alias("comparable"),
        F.array_sort(F.collect_list(F.struct("candidate_id", "coords"))).alias("_sets"),
    )
    paired = gathered.withColumn("_pair", F.explode_outer(F.flatten(F.transform(
        "_sets", lambda a: F.transform(
            F.filter("_sets", lambda b: b["candidate_id"] > a["candidate_id"]),
            lambda b: F.struct(a["coords"].alias("a"), b["coords"].alias("b")),
        )
    ))))
    apart = paired.withColumn(
        "_gap", F.when(F.col("_pair").isNotNull(), matched_rmse(
            F.coalesce("_pair.a", F.array(F.array(F.lit(0.0)))), F.coalesce("_pair.b", F.array(F.array(F.lit(0.0))))
        )).otherwise(F.lit(0.0))
    )
    return apart.groupBy("cloud_id").agg(
        F.max("best_loss").alias("best_loss"), F.max("comparable").alias("comparable"),
        F.max("_gap").alias("separation"),
    ).withColumn("multimodal", (F.col("comparable") >= 2) & (F.col("separation") >= F.lit(separation)))


def multimodality_gate(report: DataFrame, minimum_fraction: float = 0.25) -> DataFrame:
    return report.agg(
        F.avg(F.col("multimodal").cast("double")).alias("fraction"), F.count(F.lit(1)).alias("clouds")
    ).withColumn("passed", F.col("fraction") >= F.lit(minimum_fraction))
