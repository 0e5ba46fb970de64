"""Uniform coordinate lattice, byte accounting and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cumulo.functions.hashing import hash_uniform

# Fixed values of the two stream formats.
CONSTELLATION_HEADER_BYTES = 14
FEATURE_HEADER_BYTES = 12
MIN_BITS, MAX_BITS, MAX_FEATURE_BITS = 2, 24, 16
MAX_SET_SIZE = 65535


def lattice_step(bits: int, lower: float = -1.0, upper: float = 1.0) -> float:
    if not MIN_BITS <= bits <= MAX_BITS:
        raise ValueError(f"bits must be in {MIN_BITS}..{MAX_BITS}, got {bits}")
    if upper <= lower:
        raise ValueError("upper bound must lie above lower bound")
    return (upper - lower) / (2**bits - 1)


def snap(value: Column, bits: int, lower: float = -1.0, upper: float = 1.0) -> Column:
    """Clamp, round half-to-even to the lattice, and return the coordinate."""
    step = lattice_step(bits, lower, upper)
    inside = F.greatest(F.least(value, F.lit(upper)), F.lit(lower))
    return F.rint((inside - F.lit(lower)) / F.lit(step)) * F.lit(step) + F.lit(lower)


def to_index(value: Column, bits: int) -> Column:
    """Lattice index of a coordinate in [-1, 1]."""
    lattice_step(bits)
    return F.rint((value + F.lit(1.0)) * F.lit(0.5) * F.lit(float(2**bits - 1))).cast("int")


def from_index(index: Column, bits: int) -> Column:
    lattice_step(bits)
    return index.cast("double") * F.lit(2.0 / (2**bits - 1)) - F.lit(1.0)


def index_error(value: Column, bits: int) -> Column:
    """Distance to the nearest lattice index, in lattice steps."""
    position = (value + F.lit(1.0)) / F.lit(lattice_step(bits))
    return F.abs(position - F.rint(position))


def jittered_snap(value: Column, bits: int, *key: object) -> Column:
    """Snap after a uniform shift of at most half a step, keyed by hash."""
    return snap(value + (hash_uniform(*key) - F.lit(0.5)) * F.lit(lattice_step(bits)), bits)


def payload_bits(size: Column, bits: Column | int) -> Column:
    bits = bits if isinstance(bits, Column) else F.lit(bits)
    return (F.lit(3) * size * bits).cast("int")


def stream_bytes(size: Column, bits: Column | int) -> Column:
    """Header plus packed coordinates, rounded up to whole bytes."""
    return (
        F.lit(CONSTELLATION_HEADER_BYTES) + F.ceil(payload_bits(size, bits) / F.lit(8.0))
    ).cast("int")


def feature_stream_bytes(length: Column, bits: Column | int) -> Column:
    bits = bits if isinstance(bits, Column) else F.lit(bits)
    return (F.lit(FEATURE_HEADER_BYTES) + F.ceil(length * bits / F.lit(8.0))).cast("int")


def bits_per_point(byte_count: Column, points: Column) -> Column:
    return F.lit(8.0) * byte_count / points


def short_decimal(value: Column, digits: int) -> Column:
    """Shortest text with ``digits`` significant digits, no trailing zeros."""
    text = F.format_string(f"%.{digits}g", value)
    return F.when(
        text.contains("."), F.regexp_replace(text, r"\.?0+(e|$)", "$1")
    ).otherwise(text)


def float_slug(value: Column) -> Column:
    """Condition label: six significant digits, ``.`` to ``p``, ``-`` to ``m``."""
    return F.translate(short_decimal(value, 6), ".-", "pm")


def pair_label(arm: Column, decoder_seed: Column, refiner_seed: Column) -> Column:
    return F.concat(
        arm, F.lit(":decoder_"), decoder_seed.cast("string"),
        F.lit(":refiner_"), refiner_seed.cast("string"),
    )
