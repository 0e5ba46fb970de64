"""Folds of a cloud's points against its K anchors that keep K numbers, for any K.

Points are packed once into blocks of bounded size, rows of coordinate arrays. A
fold meets each block with its cloud's state, one row of K-vectors, works on the
block as matrices of bounded size inside a task and emits one partial K-vector per
quantity. So rows grow with blocks, never with points times anchors, and
iterations reuse the same blocks with a new state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulo.functions.formulas import square
from cumulo.operators.anchors import anchor_rows
from cumulo.operators.grouping import attach_counted, cloud_sizes, task_count
from cumulo.session import cut_lineage

AXES = ("x", "y", "z")
#: Points of a block, entries of one matrix (a few of them fit a core's cache), and bytes of states that every executor may get.
BLOCK, MATRIX, SENT_BYTES = 8_192, 1 << 15, 64 << 20


def point_blocks(points: DataFrame, block: int | None = None) -> DataFrame:
    """(cloud_id, n, x, y, z): arrays of about ``block`` points at most, with the cloud's size; stored.

    Blocks are dealt out evenly, over as many tasks as the counted points ask for: they are small, but
    every fold works on all their points and anchors.
    """
    block = block or BLOCK
    rows = points.select("cloud_id", "point_id", *AXES)
    sizes = cut_lineage(cloud_sizes(rows).withColumn("size", F.col("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    sized = attach_counted(rows, sizes, ["cloud_id"], total)
    part = F.pmod(F.xxhash64("point_id"), F.ceil(F.col("size") / block))
    packed = sized.groupBy("cloud_id", F.col("size").alias("n"), part.alias("_part")).agg(F.collect_list(F.struct(*AXES)).alias("_p"))
    blocks = packed.select("cloud_id", "n", *[F.col(f"_p.{a}").alias(a) for a in AXES])
    return cut_lineage(blocks.repartition(task_count(rows, total)))


def anchor_state(anchors: DataFrame) -> DataFrame:
    """(cloud_id, k, ax, ay, az): the anchors of a cloud by slot; stored."""
    rows = anchor_rows(anchors)
    return cut_lineage(rows.select("cloud_id", "k", *[F.col(f"anchors.{a}").alias(f"a{a}") for a in AXES]))


def state_entries(state: DataFrame) -> int:
    return state.agg(F.sum("k")).first()[0] or 0


def added(parts: Sequence[Sequence[np.ndarray]]) -> list[np.ndarray]:
    """Sums of partial values that several matrices of a block gave."""
    return [np.sum(values, axis=0) for values in zip(*parts)]


def fold(blocks: DataFrame, state: DataFrame, names: Sequence[str],
         task: Callable[[np.ndarray, np.ndarray, dict], Sequence[np.ndarray]], entries: int | None = None,
         merge: Callable[[Sequence[Sequence[np.ndarray]]], Sequence[np.ndarray]] = added) -> DataFrame:
    """(cloud_id, _slot, names...): a block's partial values per anchor.

    ``task(points, d2, row)`` gets some points of a block (rows), their squared distances
    to the anchors (columns), and the block's n and the state's other columns; it
    returns one K-vector per name, and ``merge`` joins those of a block's matrices. ``state`` is stored; where its ``entries`` (anchors
    of all clouds, counted if not given) are few it travels to the blocks, otherwise
    both meet by key.
    """
    extra = [c for c in state.columns if c not in ("cloud_id", "k", *(f"a{a}" for a in AXES))]
    entries = state_entries(state) if entries is None else entries
    small = entries * (len(extra) + 3) * 8 <= SENT_BYTES
    met = blocks.join(F.broadcast(state) if small else state, "cloud_id").select("cloud_id", "n", *AXES, *[f"a{a}" for a in AXES], *extra)
    kind = blocks.schema["cloud_id"].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p, a = (np.stack([batch.column(c + i)[k].values.to_numpy() for i in range(3)], axis=1) for c in (2, 5))
                row = {"n": batch.column(1)[k].as_py(), **{c: batch.column(8 + i)[k].values.to_numpy() for i, c in enumerate(extra)}}
                step, parts = max(1, MATRIX // len(a)), []
                for at in range(0, len(p), step):
                    here = p[at:at + step]
                    d2 = np.zeros((len(here), len(a)))
                    for i in range(3):
                        d2 += (here[:, i, None] - a[None, :, i]) ** 2
                    parts.append(task(here, d2, row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k] * len(a))), pa.array(np.arange(len(a)), pa.int32()),
                     *(pa.array(np.asarray(f, float), pa.float64()) for f in merge(parts))], names=["cloud_id", "_slot", *names])

    return met.mapInArrow(partial, f"cloud_id {kind}, _slot int, " + ", ".join(f"{n} double" for n in names))


def _packed(folded: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = folded.groupBy("cloud_id").agg(F.array_sort(F.collect_list(F.struct("_slot", *names))).alias("_v"))
    return rows.select("cloud_id", *[F.col(f"_v.{n}").alias(n) for n in names])


def sums(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(cloud_id, names...): arrays by slot of the partial values' sums."""
    return _packed(parts.groupBy("cloud_id", "_slot").agg(*[F.sum(n).alias(n) for n in names]), names)


def log_sum_parts(scores: np.ndarray) -> list[np.ndarray]:
    """Per column the largest score, and the sum of exp(score - largest)."""
    top = scores.max(axis=0)
    return [top, np.exp(scores - top).sum(axis=0)]


def joined_log_sums(parts: Sequence[Sequence[np.ndarray]]) -> list[np.ndarray]:
    """One pair like those of ``log_sum_parts`` for several of them."""
    tops, rests = (np.stack(values) for values in zip(*parts))
    top = tops.max(axis=0)
    return [top, (rests * np.exp(tops - top)).sum(axis=0)]


def log_sums(parts: DataFrame, name: str) -> DataFrame:
    """(cloud_id, name): log of the sum of exp over all points, from partial values ``top`` and ``rest``."""
    grouped = parts.groupBy("cloud_id", "_slot").agg(F.max("top").alias("_m"), F.collect_list(F.struct("top", "rest")).alias("_parts"))
    whole = F.aggregate("_parts", F.lit(0.0), lambda total, part: total + part["rest"] * F.exp(part["top"] - F.col("_m")))
    return _packed(grouped.select("cloud_id", "_slot", (F.col("_m") + F.log(whole)).alias(name)), [name])


def shares(d2: np.ndarray, temperature: float, potential: np.ndarray | float = 0.0) -> np.ndarray:
    """Softmax over the anchors of potential - d2 / temperature, per point."""
    scores = potential - d2 / temperature
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def mass_imbalance(points: DataFrame, anchors: DataFrame, temperature: float = 0.05) -> DataFrame:
    """Relative RMS deviation of each anchor's soft mass from an equal share."""
    parts = fold(point_blocks(points), anchor_state(anchors), ["mass"], lambda _, d2, row: [shares(d2, temperature).sum(axis=0) / row["n"]])
    k = F.size("mass")
    off = F.aggregate("mass", F.lit(0.0), lambda s, m: s + (m * k - 1) * (m * k - 1))
    return sums(parts, ["mass"]).select("cloud_id", F.sqrt(off / k).alias("mass_imbalance"))


def soft_means(points: DataFrame, anchors: DataFrame, temperature: float) -> DataFrame:
    """One soft k-means step: responsibility-weighted mean of the points per anchor."""
    def task(p: np.ndarray, d2: np.ndarray, _: dict) -> list[np.ndarray]:
        w = shares(d2, temperature)
        return [*(w.T @ p).T, w.sum(axis=0)]

    parts = fold(point_blocks(points), anchor_state(anchors), [*AXES, "mass"], task)
    folded = parts.groupBy("cloud_id", F.col("_slot").alias("slot")).agg(*[F.sum(c).alias(c) for c in (*AXES, "mass")])
    whole = F.greatest("mass", F.lit(1e-8))
    return folded.select("cloud_id", "slot", *[(F.col(a) / whole).alias(a) for a in AXES], "mass")


def density_aware_chamfer(points: DataFrame, anchors: DataFrame, temperature: float = 0.05) -> DataFrame:
    """Density-aware discrepancy between an anchor set (first) and its cloud (second).

    Soft matches are discounted by how crowded their target is, in both directions:
    one fold for the anchor side's normalizer, one for occupancies and matches.
    """
    blocks, state = point_blocks(points), anchor_state(anchors)
    norm = log_sums(fold(blocks, state, ["top", "rest"], lambda _, d2, row: log_sum_parts(-d2 / temperature), merge=joined_log_sums), "norm")

    def task(_: np.ndarray, d2: np.ndarray, row: dict) -> list[np.ndarray]:
        share, back, near = shares(d2, temperature), np.exp(-d2 / temperature - row["norm"]), np.exp(-d2 / temperature)
        crowded = 1 / (1 + (back.sum(axis=1) / (d2.shape[1] / row["n"]) - 1) ** 2)
        return [(back * near * crowded[:, None]).sum(axis=0), share.sum(axis=0), (share * near).sum(axis=0), np.full(d2.shape[1], 1.0 * len(d2))]

    names = ["first", "crowd", "pull", "n"]
    folded = fold(blocks, cut_lineage(state.join(norm, "cloud_id")), names, task).groupBy("cloud_id", "_slot").agg(*[F.sum(c).alias(c) for c in names])
    k = F.count(F.lit(1)).over(Window.partitionBy("cloud_id"))
    discount = F.lit(1.0) / (F.lit(1.0) + square(F.col("crowd") / (F.col("n") / F.col("k")) - F.lit(1.0)))
    return folded.withColumn("k", k).groupBy("cloud_id").agg((F.lit(0.5) * (
        F.avg(F.lit(1.0) - F.col("first")) + (F.lit(1.0) - F.sum(F.col("pull") * discount) / F.max("n")))).alias("density_aware_chamfer"))
