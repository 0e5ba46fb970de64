"""Samplers and objectives by name, for jobs that take the choice as a parameter.

A sampler maps (points, size, seed) to anchor rows; an objective maps (points,
anchors) to one ``loss`` per cloud.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.operators import anchors as an
from cumulo.operators import folds as fo
from cumulo.operators.farthest import farthest_points, normal_aware_points
from cumulo.operators.neighbors import normal_variation
from cumulo.operators.sampling import random_subset
from cumulo.operators.transport import transport_cost

COLUMNS = ("cloud_id", "slot", "point_id", "x", "y", "z")

SAMPLERS: dict[str, Callable[[DataFrame, int, object], DataFrame]] = {
    "fps": lambda points, size, seed: farthest_points(points, size),
    "random": lambda points, size, seed: random_subset(points, size, seed).select(*COLUMNS),
    "normal_fps": lambda points, size, seed: normal_aware_points(normal_variation(points), size),
}

OBJECTIVES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "chamfer": lambda points, anchors: an.chamfer(points, anchors).withColumnRenamed("chamfer_mse", "loss"),
    "density_aware": lambda points, anchors: fo.density_aware_chamfer(points, anchors).withColumnRenamed("density_aware_chamfer", "loss"),
    "balanced_transport": lambda points, anchors: transport_cost(points, anchors).withColumnRenamed("transport_cost", "loss"),
}


def sample(points: DataFrame, size: int, sampler: str, seed: object = 0) -> DataFrame:
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler!r}; known: {sorted(SAMPLERS)}")
    return SAMPLERS[sampler](points, size, seed)


def objective(points: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    if name not in OBJECTIVES:
        raise ValueError(f"unknown objective {name!r}; known: {sorted(OBJECTIVES)}")
    return OBJECTIVES[name](points, anchors).select("cloud_id", F.col("loss"))
