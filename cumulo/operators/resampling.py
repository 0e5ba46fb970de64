"""Sums over multinomial resamples of many replicates, without a row per replicate and member.

A resample is a tree of counts. The draws of a group are first counted by slices of
its members: this needs the group's size only. Each slice then meets its counts,
deals them to its members, and adds one partial sum per replicate, for a block of
replicates at a time. So the members' values move once per block, a slice's work is
bounded, and what is shuffled besides are counts and sums per (slice, replicate).

``_cell`` is a text that names the cell in its streams of draws: a retry or another
partitioning sees the same resample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.draws import level_weights, replicate_names, tally

#: Members of a slice, and replicates of a block.
SLICE, BLOCK = 1024, 500
#: Draws of a task, about, where they are counted.
TASK_DRAWS = 1 << 23


def _lists(arrays: Sequence[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _deal(rows: DataFrame, *keys: str, total: int = 0) -> DataFrame:
    """Rows dealt to tasks by their keys, as many as the session shuffles to, or as ``total`` draws ask for.

    The rows are few and small but stand for many draws each. Adaptive coalescing
    sees bytes and not draws, and without an explicit count it puts them all into one task.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_DRAWS)), *keys)


def cell_name(seed: object, cell: Sequence[str]) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cell])


def replicate_blocks(rows: DataFrame, replicates: int, block: int = BLOCK) -> DataFrame:
    """Each row once per block of replicates: adds ``_first`` and ``_many``."""
    firsts = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(block))).alias("_first")
    return rows.select("*", firsts).withColumn("_many", F.least(F.lit(block), F.lit(replicates) - F.col("_first")))


def group_counts(cells: DataFrame, replicates: int, role: str) -> DataFrame:
    """(_cell, _group, _first, _n): how often each of a cell's ``_groups`` groups is drawn in as many draws.

    ``cells``: _cell, _groups. ``_n`` is an array over the replicates of a block.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, groups, first, many in zip(*(c.to_pylist() for c in batch.columns)):
                drawn = level_weights(cell, role, first, many, groups)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell] * groups, pa.string()), pa.array(np.arange(groups), pa.int64()), pa.array([first] * groups, pa.int32()),
                     _lists(list(drawn.T), pa.int64())], names=["_cell", "_group", "_first", "_n"])

    blocks = replicate_blocks(cells.select("_cell", F.col("_groups").cast("int").alias("_groups")), replicates)
    return _deal(blocks, "_cell", "_first").mapInArrow(count, "_cell string, _group long, _first int, _n array<long>")


def slice_counts(groups: DataFrame, width: int = SLICE, total: int = 0) -> DataFrame:
    """(_cell, _group, _slice, _first, _n): the draws of every replicate by slices of ``width`` members.

    ``groups``: _cell, _group, _size, _first, _n (draws of each replicate of a block). ``total`` is
    the number of all draws, if known.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, group, size, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                slices = -(-size // width)
                wanted = np.array(n, np.int64)
                names = replicate_names(cell, f"slice:{group}", first, len(n))
                counts = wanted[:, None] if slices == 1 else tally(names, wanted, size, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell] * slices, pa.string()), pa.array([group] * slices, pa.int64()), pa.array(np.arange(slices), pa.int64()),
                     pa.array([first] * slices, pa.int32()), _lists(list(counts.T), pa.int64())],
                    names=["_cell", "_group", "_slice", "_first", "_n"])

    rows = _deal(groups.select("_cell", "_group", F.col("_size").cast("long"), "_first", "_n"), "_cell", "_group", "_first", total=total)
    return rows.mapInArrow(count, "_cell string, _group long, _slice long, _first int, _n array<long>")


def drawn_sums(values: DataFrame, counts: DataFrame, fold: Callable[[str, int, np.ndarray, list[int]], np.ndarray], outputs: int,
               width: int = SLICE, total: int = 0) -> DataFrame:
    """(_cell, _r, _n, _sum_0, ...): folded sums over a replicate's drawn members, and the number of draws.

    ``values``: _cell, _group, _size, _levels (sizes of the cell's other factors), _member
    (0-based in its group), _values (as many doubles in every row of a cell). ``counts``: from
    ``slice_counts``. ``fold(cell, first, sums, levels)`` turns a block's sums of the values,
    one row per replicate, into ``outputs`` columns; it must be linear in the sums. ``total`` is
    the number of all draws, if known.
    """
    slices = values.withColumn("_slice", F.floor(F.col("_member") / width)).groupBy("_cell", "_group", "_slice").agg(
        F.any_value("_size").alias("_size"), F.any_value("_levels").alias("_levels"),
        F.collect_list(F.struct((F.col("_member") % width).cast("int").alias("at"), F.col("_values").alias("values"))).alias("_list"))
    met = slices.join(counts, ["_cell", "_group", "_slice"]).select(
        "_cell", "_group", "_slice", F.col("_size").cast("long"), "_first", F.col("_levels").cast("array<int>"), "_n",
        F.col("_list.at").alias("_at"), F.flatten("_list.values").alias("_flat"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell, group, part, size, first, levels = (batch.column(c)[k].as_py() for c in range(6))
                n, at, flat = (batch.column(c)[k].values.to_numpy() for c in (6, 7, 8))
                here = min(width, size - part * width)
                matrix = np.zeros((here, len(flat) // len(at)))
                matrix[at] = flat.reshape(len(at), -1)
                drawn = tally(replicate_names(cell, f"inside:{group}:{part}", first, len(n)), n, here)
                sums = fold(cell, first, drawn.astype(float) @ matrix, levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell] * len(n), pa.string()), pa.array(np.arange(first, first + len(n)), pa.int32()), pa.array(n, pa.int64()),
                     *(pa.array(np.ascontiguousarray(sums[:, k]), pa.float64()) for k in range(outputs))], names=names)

    columns = [f"_sum_{k}" for k in range(outputs)]
    names = ["_cell", "_r", "_n", *columns]
    dealt = _deal(met, "_cell", "_group", "_slice", "_first", total=total)
    parts = dealt.mapInArrow(add, "_cell string, _r int, _n long, " + ", ".join(f"{c} double" for c in columns))
    return parts.groupBy("_cell", "_r").agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in columns])


def design_statistic(cells: DataFrame, replicates: int, statistic: Callable[[str, int, int, dict], np.ndarray]) -> DataFrame:
    """(_cell, _r, _value): one number per replicate of small tables that travel whole.

    ``cells``: _cell and columns of at most design size. ``statistic(cell, first, many, row)``
    returns the values of a block of replicates.
    """
    columns = cells.columns

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                first, many = row["_first"], row["_many"]
                found = statistic(row["_cell"], first, many, row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["_cell"]] * many, pa.string()), pa.array(np.arange(first, first + many), pa.int32()), pa.array(found, pa.float64())],
                    names=["_cell", "_r", "_value"])

    blocks = _deal(replicate_blocks(cells, replicates).select(*columns, "_first", "_many"), "_cell", "_first")
    return blocks.mapInArrow(draw, "_cell string, _r int, _value double")
