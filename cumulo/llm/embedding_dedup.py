"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points in order. The inverted
lists of the index are keyed by two reference points, so two vectors meet in a
list exactly if they share that many of their nearest ones; each pair is
compared once, in the list of the two smallest references it shares. Cosines in
double precision verify every candidate.

Equal vectors are one row of the index. A long list is cut into blocks and every
two blocks meet in a task, so no list is capped and none is gathered whole. A
task returns link counts and a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import attach_groups, stored
from cumulo.llm.graph import components

#: Reference points of each dimension, chosen from at most SAMPLE vectors.
PIVOTS = 128
SAMPLE = 2048
#: Nearest references that describe a vector.
NEAREST = 5
#: Vectors of a list that meet in one task.
BLOCK = 2000


def _unit_rows(column: pa.Array) -> list[bytes | None]:
    """Double-precision unit vectors as raw bytes; None where null, empty, zero, or with a null or non-finite component."""
    column = column.cast(pa.list_(pa.float64()))
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become nan
    edges = column.offsets.to_numpy()
    rows: list[bytes | None] = []
    for k, there in enumerate(column.is_valid().to_pylist()):
        vector = values[edges[k]:edges[k + 1]]
        largest = np.abs(vector).max() if there and len(vector) else 0.0
        if not np.isfinite(largest) or largest == 0:
            rows.append(None)
            continue
        vector = vector / largest
        rows.append((vector / np.sqrt(vector @ vector)).astype("<f8").tobytes())
    return rows


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, digest, dim, unit), one row per input row; digest and unit are null where no link is possible."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            raw = [r if label is not None else None for r, label in zip(_unit_rows(batch.column(2)), labels)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([r and hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()),
                 pa.array([r and len(r) // 8 for r in raw], pa.int32()), pa.array(raw, pa.binary())],
                names=["vec_id", "label", "digest", "dim", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(convert, "vec_id long, label long, digest binary, dim int, unit binary")


def choose_pivots(classes: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Reference points by dimension: spread-out members of a sample bounded by ``sample``."""
    drawn: dict[int, list[np.ndarray]] = {}
    for row in classes.select("dim", "unit").orderBy(F.xxhash64("digest"), "digest").limit(sample).collect():
        drawn.setdefault(row["dim"], []).append(np.frombuffer(row["unit"], "<f8"))
    found = {}
    for dim, rows in drawn.items():
        pool = np.stack(rows)
        chosen = []
        nearest = np.full(len(pool), -np.inf)
        for k in range(len(pool)):
            if nearest[k] < 0.9 and len(chosen) < pivots:
                chosen.append(k)
                nearest = np.maximum(nearest, pool @ pool[k])
        found[dim] = pool[chosen]
    return found


def _describe(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """One row per class and inverted list: the two references (first, second) and the class's nearest ones."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        for batch in batches:
            rep, dims, units = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            out_row, out_first, out_second, out_near = [], [], [], []
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                matrix = np.stack([np.frombuffer(units[k], "<f8") for k in rows])
                own = points.get(int(dim))
                if own is None or len(own) < 2:
                    lists = [(k, -1, -1, []) for k in rows]
                else:
                    order = np.argsort(-(matrix @ own.T), axis=1, kind="stable")[:, :nearest]
                    lists = []
                    for k, near in zip(rows, np.sort(order, axis=1).tolist()):
                        lists += [(k, near[i], near[j], near) for i in range(len(near)) for j in range(i + 1, len(near))]
                for k, first, second, near in lists:
                    out_row.append(k)
                    out_first.append(first)
                    out_second.append(second)
                    out_near.append(near)
            yield pa.RecordBatch.from_arrays(
                [rep.take(pa.array(out_row, pa.int32())), pa.array(out_first, pa.int32()), pa.array(out_second, pa.int32()),
                 pa.array(out_near, pa.list_(pa.int32()))], names=["rep", "first", "second", "near"])

    return classes.select("rep", "dim", "unit").mapInArrow(listed, "rep long, first int, second int, near array<int>")


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> list[int]:
    """Positions of the links that join two trees, in the order given."""
    parent = list(range(size))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    kept = []
    for at, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = root(i), root(j)
        if i != j:
            parent[i] = j
            kept.append(at)
    return kept


def _meet(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of every list block in a sorted partition: (a, b, 0) for the forest, (a, null, n) for counts."""
    held: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        keys = table.column("list").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        rep = table.column("rep").to_numpy()
        copies, block = table.column("copies").to_numpy(), table.column("block").to_numpy()
        second = table.column("second").to_numpy()
        first = table.column("first").to_numpy()
        pair_x, pair_y = table.column("x").to_numpy(), table.column("y").to_numpy()
        units, near = table.column("unit"), table.column("near")
        left, right, count = [], [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo < 2:
                continue
            matrix = np.stack([np.frombuffer(units[k].as_py(), "<f8") for k in range(lo, hi)])
            good = matrix @ matrix.T >= least
            np.fill_diagonal(good, False)
            if pair_x[lo] != pair_y[lo]:
                good &= block[lo:hi, None] != block[None, lo:hi]
            if second[lo] >= 0:
                lower = np.zeros((hi - lo, second[lo] + 1), np.float32)
                for k in range(lo, hi):
                    for p in near[k].as_py():
                        if p < second[lo] and p != first[lo]:
                            lower[k - lo, p] = 1
                good &= lower @ lower.T == 0  # else the pair belongs to another list
            total = (good.astype(np.float64) @ copies[lo:hi]).astype(np.int64)
            some = np.flatnonzero(total)
            left += rep[lo:hi][some].tolist()
            right += [None] * len(some)
            count += total[some].tolist()
            i, j = np.nonzero(np.triu(good))
            kept = _forest(i, j, hi - lo)
            left += rep[lo:hi][i[kept]].tolist()
            right += rep[lo:hi][j[kept]].tolist()
            count += [0] * len(kept)
        return pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(count, pa.int64())], names=["a", "b", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("list").to_numpy()
        edge = int(np.searchsorted(keys, keys[-1], side="left"))  # the last list may go on
        if edge:
            held.append(batch.slice(0, edge))
            yield links(pa.Table.from_batches(held).combine_chunks())
            held = [batch.slice(edge)]
        elif held and held[-1].column("list")[-1].as_py() != keys[0]:
            yield links(pa.Table.from_batches(held).combine_chunks())
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield links(pa.Table.from_batches(held).combine_chunks())


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, pivots: int = PIVOTS, nearest: int = NEAREST, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are compared only when labels are equal and not null, and lengths are
    equal. Null or zero vectors and those with null or non-finite components link
    with nothing and are kept, each in its own component. Rows that repeat a
    vec_id count as vectors of their own. An empty table gives no rows.
    """
    units = stored(unit_vectors(vectors))
    same = ["label", "dim", "digest"]
    classes = stored(units.where("digest IS NOT NULL").groupBy(*same).agg(
        F.min("vec_id").alias("lowest"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
        .withColumn("rep", F.monotonically_increasing_id()))
    lists = _describe(classes, choose_pivots(classes, pivots), nearest).join(
        classes.select("rep", "label", "dim", "copies", "unit"), "rep")
    key = ["label", "dim", "first", "second"]
    lists = stored(lists)
    sizes = stored(lists.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
                   .withColumn("list_id", F.monotonically_increasing_id()))
    total = lists.count()
    placed = attach_groups(lists, sizes, key, "size", total).where("size IS NOT NULL")
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"x": F.least("block", "other").cast("int"), "y": F.greatest("block", "other").cast("int")})
    met = met.withColumn("list", F.xxhash64("list_id", "x", "y")).select(
        "list", "x", "y", "block", "first", "second", "rep", "copies", "near", "unit")
    found = stored(met.repartition("list").sortWithinPartitions("list").mapInArrow(
        lambda batches: _meet(batches, least), "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    of = components(found.where("b IS NOT NULL"))
    joined = classes.join(counts, "rep", "left").join(of, classes["rep"] == of["node"], "left").drop("node")
    joined = stored(joined.withColumn("component", F.coalesce("component", "rep")))
    lowest = joined.groupBy("component").agg(F.min("lowest").alias("component_id"))
    table = stored(joined.join(lowest, "component").select(
        *same, "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    return attach_groups(units.select("vec_id", *same), table, same, "copies", units.count()).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
