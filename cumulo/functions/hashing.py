"""Seeded hash ranks and draws.

SHA-256 over ``:``-joined parts. The same text hashed anywhere gives the same
rank, so splits and samples do not depend on partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: object) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash_rank(*parts: object) -> Column:
    """Hex digest used as an ordering key; plain values become literals."""
    return F.sha2(F.concat_ws(":", *[_text(p) for p in parts]), 256)


def hash_int(*parts: object) -> Column:
    """First 60 digest bits as a BIGINT."""
    return F.conv(F.substring(hash_rank(*parts), 1, 15), 16, 10).cast("bigint")


def role_seed(*parts: object) -> Column:
    """First eight digest bytes as an unsigned decimal string (exceeds BIGINT)."""
    return F.conv(F.substring(hash_rank(*parts), 1, 16), 16, 10)


def hash_uniform(*parts: object) -> Column:
    """Uniform draw in the open unit interval, from as many bits as a double holds."""
    return (F.shiftright(hash_int(*parts), 8) + F.lit(0.5)) / F.lit(4503599627370496.0)


def hash_index(bound: Column | int, *parts: object) -> Column:
    """Draw in ``0 .. bound - 1``."""
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    return F.pmod(hash_int(*parts), bound.cast("bigint"))


def hash_normal(*parts: object) -> Column:
    """Standard normal draw (Box-Muller over two hash draws)."""
    u = hash_uniform(*parts, "r")
    v = hash_uniform(*parts, "t")
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * v)
