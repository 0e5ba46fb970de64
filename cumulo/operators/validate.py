"""Point checks that separate bad rows instead of failing on the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.operators.grouping import attach, by_cloud, cloud_sizes


def _finite(name: str) -> Column:
    value = F.col(name)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def point_reason(lower: float | None = -1.0, upper: float | None = 1.0) -> Column:
    """Why a row is unusable, or NULL."""
    finite = _finite("x") & _finite("y") & _finite("z")
    reason = F.when(~finite, F.lit("coordinate is not finite"))
    if lower is not None and upper is not None:
        inside = F.col("x").between(lower, upper) & F.col("y").between(lower, upper) & F.col("z").between(lower, upper)
        reason = reason.when(~inside, F.lit("coordinate outside the domain"))
    return reason


def check_points(points: DataFrame, *, minimum: int = 1, lower: float | None = -1.0,
                 upper: float | None = 1.0) -> tuple[DataFrame, DataFrame]:
    """Split into usable rows and quarantined rows with a ``reason``.

    A cloud with a bad row, or with fewer than ``minimum`` rows, is unusable as a
    whole: its good rows are quarantined too, naming the cloud as the cause.
    """
    marked = by_cloud(points).withColumn("reason", point_reason(lower, upper))
    state = marked.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("reason").alias("_bad")
    )
    judged = attach(marked, state).withColumn(
        "reason",
        F.coalesce(
            F.col("reason"),
            F.when(F.col("_bad") > 0, F.lit("cloud has an invalid coordinate")),
            F.when(F.col("_rows") < minimum, F.lit("cloud has too few points")),
        ),
    ).drop("_rows", "_bad")
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def check_minimum(points: DataFrame, minimum: int) -> DataFrame:
    """Clouds smaller than ``minimum`` with their size."""
    return cloud_sizes(points).filter(F.col("n") < minimum)
