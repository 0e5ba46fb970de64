"""Balanced entropic transport between an anchor set and its cloud.

The state of the scaling iteration is one potential per anchor. Given it, each
point's share follows from that point alone, so a sweep is one fold over blocks
of points that keeps K numbers a cloud, and the plan itself is never stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cumulo.operators.anchors import softmax, with_distances
from cumulo.operators.folds import anchor_state, fold, joined_log_sums, log_sum_parts, log_sums, point_blocks, shares, state_entries
from cumulo.operators.grouping import attach, by_size, per_cloud
from cumulo.session import cut_lineage

AXES = ("x", "y", "z")
#: Sums of shares down to this lose nothing to underflow.
SAFE = 1e-150


def _in_task(points: DataFrame, anchors: DataFrame, epsilon: float, iterations: int, total: int = 0) -> DataFrame:
    schema = T.StructType([
        T.StructField("cloud_id", points.schema["cloud_id"].dataType),
        T.StructField("potential", T.ArrayType(T.DoubleType())),
    ])
    # Both sides travel in one shuffle; anchors of clouds handled elsewhere drop out below.
    both = points.select("cloud_id", *AXES, F.lit(None).cast("int").alias("slot")).unionByName(
        anchors.select("cloud_id", *AXES, F.col("slot").cast("int").alias("slot"))
    )

    def lse(values: np.ndarray, axis: int) -> np.ndarray:
        top = values.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))

    def solve(rows: pa.Table) -> pa.Table:
        slots = rows.column("slot").to_pandas().to_numpy(dtype=float)
        xyz = np.stack([rows.column(c).to_numpy() for c in ("x", "y", "z")], axis=1)
        mine = np.flatnonzero(~np.isnan(slots))
        a, p = xyz[mine[np.argsort(slots[mine], kind="stable")]], xyz[np.isnan(slots)]
        found = []
        if len(a) and len(p):
            kernel = -((a[:, None, :] - p[None, :, :]) ** 2).sum(axis=2) / epsilon
            row_mass, column_mass = -np.log(len(a)), -np.log(len(p))
            v = np.zeros(len(p))
            for _ in range(iterations):
                u = row_mass - lse(kernel + v[None, :], 1)
                v = column_mass - lse(kernel + u[:, None], 0)
            found = [u.tolist()]
        return pa.table({
            "cloud_id": rows.column("cloud_id").slice(0, len(found)), "potential": pa.array(found, pa.list_(pa.float64())),
        })

    return per_cloud(both, solve, schema, total=total)


def _spread(points: DataFrame, anchors: DataFrame, epsilon: float, iterations: int, tolerance: float) -> DataFrame:
    """Sweeps as folds over stored blocks of points: each keeps one potential per anchor."""
    blocks, fixed = point_blocks(points), anchor_state(anchors)
    entries, state = state_entries(fixed), fixed
    for sweep in range(iterations):

        def task(_: np.ndarray, d2: np.ndarray, row: dict) -> list[np.ndarray]:
            scores = -d2 / epsilon
            if "potential" in row:  # the column scaling that the last potentials ask for
                pulled = scores + row["potential"]
                top = pulled.max(axis=1, keepdims=True)
                share = np.exp(pulled - top)
                whole = share.sum(axis=1, keepdims=True)
                mass = (share / whole).sum(axis=0)
                if (mass > SAFE).all():  # the shares are the sums' terms, up to a factor of each anchor
                    return [-np.log(row["n"]) - row["potential"], mass]
                scores = scores - np.log(row["n"]) - top - np.log(whole)
            return log_sum_parts(scores)

        swept = log_sums(fold(blocks, state, ["top", "rest"], task, entries, joined_log_sums), "_sum")
        new = cut_lineage(fixed.join(swept, "cloud_id").withColumn(
            "potential", F.transform("_sum", lambda v: -F.log(F.col("k").cast("double")) - v)).drop("_sum"))
        moved = None
        if tolerance and sweep:
            # A change of the log scaling is the relative error of the anchors' masses.
            change = F.array_max(F.zip_with("potential", "_last", lambda a, b: F.abs(a - b)))
            moved = new.join(state.select("cloud_id", F.col("potential").alias("_last")), "cloud_id").agg(F.max(change)).first()[0]
        state = new
        if moved is not None and moved <= tolerance:
            break
    return state.select("cloud_id", "potential")


def anchor_potentials(points: DataFrame, anchors: DataFrame, *, epsilon: float = 0.05, iterations: int = 40,
                      tolerance: float = 0.0, bound: int | None = None) -> DataFrame:
    """Log scaling per anchor after the given number of sweeps: (cloud_id, potential).

    With a ``tolerance`` large clouds stop as soon as no anchor's mass is further
    from its due, as a share of it. A cloud of at most ``bound`` points per anchor
    matrix is solved inside one task.
    """
    if epsilon <= 0 or iterations < 1:
        raise ValueError("epsilon must be positive and iterations at least 1")
    options = {} if bound is None else {"bound": bound}
    return by_size(
        points,
        lambda d, n: _in_task(d, anchors, epsilon, iterations, n),
        lambda d: _spread(d, anchors, epsilon, iterations, tolerance),
        **options,
    )


def _balanced(points: DataFrame, anchors: DataFrame, epsilon: float, options: dict) -> tuple[DataFrame, DataFrame]:
    state = anchor_state(anchors).join(anchor_potentials(points, anchors, epsilon=epsilon, **options), "cloud_id")
    return point_blocks(points), cut_lineage(state)


def anchor_mass(points: DataFrame, anchors: DataFrame, *, epsilon: float = 0.05, **options) -> DataFrame:
    """(cloud_id, slot, mass): what the balanced plan gives each anchor, near 1/K."""
    blocks, state = _balanced(points, anchors, epsilon, options)
    parts = fold(blocks, state, ["mass"], lambda _, d2, row: [shares(d2, epsilon, row["potential"]).sum(axis=0) / row["n"]])
    return parts.groupBy("cloud_id", F.col("_slot").alias("slot")).agg(F.sum("mass").alias("mass"))


def transport_cost(points: DataFrame, anchors: DataFrame, *, epsilon: float = 0.05, **options) -> DataFrame:
    """Mean squared cost of the balanced plan per cloud."""
    blocks, state = _balanced(points, anchors, epsilon, options)
    parts = fold(blocks, state, ["cost"], lambda _, d2, row: [(shares(d2, epsilon, row["potential"]) * d2).sum(axis=0) / row["n"]])
    return parts.groupBy("cloud_id").agg(F.sum("cost").alias("transport_cost"))


def transport_plan(points: DataFrame, anchors: DataFrame, *, epsilon: float = 0.05, **options) -> DataFrame:
    """Plan entries (cloud_id, slot, point_id, mass), one per point and anchor; rows sum to 1/K, columns to 1/N."""
    potential = anchor_potentials(points, anchors, epsilon=epsilon, **options)
    counts = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("_n"))
    scaled = attach(with_distances(points, anchors, None), potential.join(counts, "cloud_id"), sized=points)
    share = softmax(F.zip_with("potential", "d2s", lambda u, d: u - d / F.lit(epsilon)))
    return scaled.select("cloud_id", "point_id", "_n", F.posexplode(share).alias("slot", "share")).select(
        "cloud_id", "slot", "point_id", (F.col("share") / F.col("_n")).alias("mass"))
