"""Choosing between one-task-per-cloud work and fully distributed work.

A cloud may be tiny or may hold a third of all rows. Clouds whose *counted*
size is below a bound are handled whole inside a task, where one shuffle
replaces many. Every larger cloud takes a path that never gathers it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_BOUND = 20_000
#: Rows of a task that sorts or gathers them, about, where a frame's rows are counted.
TASK_ROWS = 100_000


def task_count(rows: DataFrame, total: int) -> int:
    """Tasks for ``total`` rows: ``spark.sql.shuffle.partitions``, or as many as hold TASK_ROWS each."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))


def dealt(rows: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Rows by ``keys`` over as many tasks as their counted number asks for.

    The explicit count keeps adaptive coalescing, which sees bytes and not the
    cost of a task, from piling all groups onto one core.
    """
    return rows.repartition(task_count(rows, total), *keys)


def dealt_if_many(rows: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """``dealt`` where ``total`` rows need more tasks than ``spark.sql.shuffle.partitions``; else as they are."""
    return dealt(rows, keys, total) if task_count(rows, total) > task_count(rows, 0) else rows


def cloud_sizes(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def by_cloud(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Points co-located by key over as many tasks as their counted number asks for, so that no later sort,
    window or join by key holds more than about TASK_ROWS of them and one cloud.

    Frames that fit ``spark.sql.shuffle.partitions``, and those with a cloud beyond TASK_ROWS, which
    adaptive execution has to split, stay as they are.
    """
    total, largest = cloud_sizes(points, key).agg(F.sum("n"), F.max("n")).first()
    return points if (largest or 0) > TASK_ROWS else dealt_if_many(points, [key], total or 0)


def largest_group(points: DataFrame, key: str = "cloud_id") -> int:
    """Rows of the biggest group: one map-side fold over the key column."""
    return cloud_sizes(points, key).agg(F.max("n")).first()[0] or 0


def attach(points: DataFrame, per_key: DataFrame, key: str = "cloud_id", *, sized: DataFrame | None = None,
           hot_rows: int | None = None) -> DataFrame:
    """Join one or a few rows per key to all points of that key.

    Without ``hot_rows`` this is a plain key join: the points stay co-located by
    key, which later joins and folds reuse, and adaptive execution splits a key
    that turns out too large. With it, keys of more points are cut into slices
    and their rows repeated per slice inside the plan. Nothing is counted ahead.
    """
    counted = points if sized is None else sized
    if hot_rows is None:
        return points.join(per_key, key)
    slices = F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("_slices")
    hot = cloud_sizes(counted, key).filter(F.col("n") > hot_rows).select(key, slices)
    row = F.xxhash64("point_id") if "point_id" in points.columns else F.monotonically_increasing_id()
    salted = points.join(hot, key, "left").withColumn(
        "_slice", F.when(F.col("_slices").isNull(), F.lit(0)).otherwise(F.pmod(row, F.col("_slices")).cast("int"))
    ).drop("_slices")
    copies = per_key.join(hot, key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    ).drop("_slices")
    return salted.join(copies, [key, "_slice"]).drop("_slice")


#: A group with more than 1/HOT_SHARE of the rows is hot, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 256


def attach_counted(rows: DataFrame, groups: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Left join with one stored row per group, whose column ``n`` counts its rows and is not kept.

    The hot groups, fewer than HOT_SHARE, are broadcast, so their rows stay where
    they are; the rows of all others join by shuffle, none of them skewed.
    """
    keys = list(keys)
    extra = [c for c in groups.columns if c not in (*keys, "n")]
    hot = groups.filter(F.col("n") * HOT_SHARE > total).drop("n").withColumn("_hot", F.lit(True))
    tried = rows.join(F.broadcast(hot), keys, "left")
    rest = tried.filter("_hot IS NULL").drop("_hot", *extra).join(groups.filter(F.col("n") * HOT_SHARE <= total).drop("n"), keys, "left")
    return tried.filter("_hot").drop("_hot").unionByName(rest)


def per_cloud(rows: DataFrame, task: Callable[[pa.Table], pa.Table], schema: T.StructType, key: str = "cloud_id",
              total: int = 0) -> DataFrame:
    """Run ``task`` on each (small) group as an Arrow table; ``total`` counts the rows."""
    return dealt(rows, [key], total).groupBy(key).applyInArrow(task, schema)


def by_size(
    points: DataFrame,
    grouped: Callable[[DataFrame, int], DataFrame],
    spread: Callable[[DataFrame], DataFrame],
    *,
    sized: DataFrame | None = None,
    bound: int = GROUP_BOUND,
    key: str = "cloud_id",
) -> DataFrame:
    """Apply ``grouped`` to clouds of at most ``bound`` rows and ``spread`` to the rest.

    ``grouped`` also gets the number of all rows, by which it may deal its own.
    ``sized`` is the frame whose rows are counted (default: ``points``). Only
    the keys above the bound are looked at; there are at most rows / bound.
    """
    counted = sized if sized is not None else points
    total, largest = cloud_sizes(counted, key).agg(F.sum("n"), F.max("n")).first()
    total = total or 0
    if (largest or 0) <= bound:
        return grouped(points, total)
    oversized = cloud_sizes(counted, key).filter(F.col("n") > bound).select(key)
    small = points.join(oversized, key, "left_anti")
    large = points.join(oversized, key, "left_semi")
    return grouped(small, total).unionByName(spread(large))
