"""Ranks, top-k and exact quantiles that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cumulo.operators.grouping import GROUP_BOUND, by_size, dealt_if_many
from cumulo.session import cut_lineage

# Rows per window level when folding along an index.
LEVEL = 4096

# Spark trims row_number() <= k before the shuffle up to this k.
TRIMMED_LIMIT = 1000


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their 1-based rank.

    The filter on ``row_number`` is trimmed map-side, so each map task ships at
    most ``k`` rows per key. Above the trimming limit a salted first pass splits
    a hot key over many tasks.
    """
    keys = list(keys)
    if k > TRIMMED_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(256)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def hash_order(df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str], rank: str = "rank") -> DataFrame:
    """1-based rank by a hex digest column within each key, for every row.

    Digests are uniform, so the first three hex characters split a key into 4096
    even slices; slice counts give the offset and rows are only sorted per slice.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", F.substring(digest, 1, 3))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(digest, *ties)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(rank, (F.col("_offset") + F.row_number().over(inside)).cast("bigint"))
        .drop("_slice", "_offset")
    )


def spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rank") -> DataFrame:
    """0-based rank of every row within its key for groups of any size.

    Rows are range-partitioned on (key, order); the sampled bounds balance any
    value distribution, and ``order`` should end in an id so copies can be cut
    apart. The partitioned rows are checkpointed so that per-partition counts
    and row ranks see the same cut.
    """
    keys, order = list(keys), list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(
        df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    counts = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        cut.join(offsets, [*keys, "_part"])
        .withColumn(rank, (F.col("_offset") + F.row_number().over(inside) - 1).cast("bigint"))
        .drop("_part", "_offset")
    )


def grouped_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rank") -> DataFrame:
    """0-based rank within groups already known to be small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, (F.row_number().over(window) - 1).cast("bigint"))


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, sized: DataFrame | None = None,
                  bound: int = GROUP_BOUND, rank: str = "rank") -> DataFrame:
    """Rank rows, windowing small groups and range-splitting large ones.

    The first key decides the size; ``sized`` may be a cheaper frame to count.
    """
    keys = list(keys)
    return by_size(
        df,
        lambda d, n: grouped_rank(dealt_if_many(d, keys[:1], n), keys, order, rank),
        lambda d: spread_rank(d, keys, order, rank),
        sized=sized, bound=bound, key=keys[0],
    )


def _pick(probabilities: Sequence[float], names: Sequence[str], value: str) -> list[Column]:
    """Linear interpolation between the two order statistics around each rank."""
    picks = []
    for p, name in zip(probabilities, names):
        position = F.lit(p) * (F.col("_total") - F.lit(1))
        low = F.max(F.when(F.col("_rank") == F.floor(position), F.col(value)))
        high = F.max(F.when(F.col("_rank") == F.ceil(position), F.col(value)))
        weight = F.max(position - F.floor(position))
        picks.append((low + (high - low) * weight).alias(name))
    return picks


def spread_quantiles(df: DataFrame, keys: Sequence[str], value: str, tie: str,
                     probabilities: Sequence[float], names: Sequence[str]) -> DataFrame:
    keys = list(keys)
    ranked = spread_rank(df.select(*keys, value, tie), keys, [value, tie], "_rank")
    totals = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return ranked.join(totals, keys).groupBy(*keys).agg(*_pick(probabilities, names, value))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, tie: str, probabilities: Sequence[float],
              names: Sequence[str], *, sized: DataFrame | None = None, bound: int = GROUP_BOUND) -> DataFrame:
    """Exact linear-interpolated quantiles per key.

    ``percentile`` keeps every distinct value of a group in memory, so it is used
    only for groups of checked size.
    """
    keys = list(keys)

    def grouped(d: DataFrame, total: int) -> DataFrame:
        wanted = F.percentile(F.col(value), [float(p) for p in probabilities])
        folded = dealt_if_many(d, keys[:1], total).groupBy(*keys).agg(wanted.alias("_q"))
        return folded.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    return by_size(
        df, grouped,
        lambda d: spread_quantiles(d, keys, value, tie, probabilities, names),
        sized=sized, bound=bound, key=keys[0],
    )


def fold_before(df: DataFrame, keys: Sequence[str], index: str, value: str, name: str,
                fold: Callable[[Column], Column]) -> DataFrame:
    """Fold (``F.sum``, ``F.min``, ``F.max``) of all earlier rows by a whole-number index.

    Works in three levels of windows over at most 4096 index values each, so one
    long key is spread over many tasks. The first row of a key gets NULL.
    """
    keys = list(keys)
    placed = df.withColumn("_l1", F.floor(F.col(index) / LEVEL)).withColumn("_l2", F.floor(F.col(index) / (LEVEL * LEVEL)))

    def before(partition: list[str], order: str, column: str) -> Column:
        window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return fold(F.col(column)).over(window)

    level1 = placed.groupBy(*keys, "_l2", "_l1").agg(fold(F.col(value)).alias("_t"))
    level2 = level1.groupBy(*keys, "_l2").agg(fold(F.col("_t")).alias("_t"))
    level2 = level2.withColumn("_s2", before(keys, "_l2", "_t")).drop("_t")
    level1 = level1.withColumn("_s1", before([*keys, "_l2"], "_l1", "_t")).drop("_t")
    inside = placed.withColumn("_s0", before([*keys, "_l2", "_l1"], index, value))
    joined = inside.join(level1, [*keys, "_l2", "_l1"]).join(level2, [*keys, "_l2"])
    parts = [F.col("_s2"), F.col("_s1"), F.col("_s0")]
    if fold is F.sum:
        some = F.coalesce(*parts).isNotNull()
        total = F.when(some, sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))
    else:
        total = F.array_min(F.array(*parts)) if fold is F.min else F.array_max(F.array(*parts))
    return joined.withColumn(name, total).drop("_l1", "_l2", "_s0", "_s1", "_s2")
