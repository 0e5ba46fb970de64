"""Distance, error and relative-change expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A plain column referenced inside a lambda is computed again per element once
    the optimizer merges projections; a lambda argument is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def square(value: Column) -> Column:
    return value * value


def squared_distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Direct differences, always summed in x, y, z order so ties are stable."""
    return square(ax - bx) + square(ay - by) + square(az - bz)


def psnr(mse: Column, peak: float = 2.0) -> Column:
    """Decibels against the peak distance; a zero error is infinite."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(
        F.lit(10.0) * F.log10(F.lit(peak * peak) / mse)
    )


def improvement_percent(base: Column, candidate: Column) -> Column:
    """Positive when the candidate error is lower; the base is floored."""
    return F.lit(100.0) * (base - candidate) / F.greatest(base, F.lit(FLOOR))


def gap_percent(candidate: Column, base: Column) -> Column:
    """Unfloored relative gap; NULL over a zero base."""
    return F.try_divide(F.lit(100.0) * (candidate - base), base)


def out(value: Column, digits: int = 6) -> Column:
    """Report form of a derived double: rounded, without negative zero."""
    return F.round(value, digits) + F.lit(0.0)


GOLDEN_ANGLE = math.pi * (3.0 - math.sqrt(5.0))


def sphere_direction(index: Column, count: int) -> tuple[Column, Column, Column]:
    """Evenly spread unit vectors on a golden-angle spiral."""
    z = F.lit(1.0) - F.lit(2.0) * (index + F.lit(0.5)) / F.lit(float(count))
    ring = F.sqrt(F.greatest(F.lit(1.0) - z * z, F.lit(0.0)))
    turn = index * F.lit(GOLDEN_ANGLE)
    return ring * F.cos(turn), ring * F.sin(turn), z


def radical_inverse(index: Column, base: int, digits: int = 48) -> Column:
    """Van der Corput value: the digits of ``index`` mirrored behind the point."""
    start = F.struct(
        index.cast("bigint").alias("rest"), F.lit(1.0 / base).alias("unit"), F.lit(0.0).alias("total")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(digits), F.ceil(
            F.log(float(base), index + F.lit(1.0))).cast("int") + F.lit(1)))),
        start,
        lambda state, _: F.struct(
            F.floor(state["rest"] / F.lit(base)).cast("bigint").alias("rest"),
            (state["unit"] / F.lit(float(base))).alias("unit"),
            (state["total"] + state["unit"] * F.pmod(state["rest"], F.lit(base))).alias("total"),
        ),
        lambda state: state["total"],
    )


def square_grid(count: int) -> Column:
    """Array of (u, v): the first ``count`` points of the smallest even grid over [-1, 1]."""
    side = math.ceil(math.sqrt(count))
    at = lambda i: F.lit(-1.0) + i.cast("double") * F.lit(2.0 / max(side - 1, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(
        at(F.floor(i / F.lit(side))).alias("u"), at(F.pmod(i, F.lit(side))).alias("v")
    ))
