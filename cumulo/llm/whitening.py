"""Whitening of embeddings by QDWH spectral divide and conquer.

Two scans sum the fit list: first the integer vectors, exactly, then the products
of their centred entries. The covariance is then split on the driver, where it is
one matrix of dimension squared, whatever the number of rows: the unitary polar
factor U of V - s*I, found by the dynamically weighted Halley iteration (QDWH),
gives the projector (U + I) / 2 on the invariant subspace of the eigenvalues
above s. Orthonormal bases of it and of its complement reduce V to two smaller
matrices, each split again until single components are left. The components go
to all tasks with their scales, and one more scan whitens the rows.

A third scan before that measures the whitened rows' own covariance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of a vector count as this much at most, so that their sums stay in a long.
LIMIT = 1 << 30
COMPONENTS = 8
#: Rows that one matrix product takes.
ROWS = 4096


def _polar(matrix: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by QDWH: three or so QR steps, then Cholesky steps."""
    size = len(matrix)
    eye = np.eye(size)
    x = matrix / np.linalg.norm(matrix)
    lower = 1e-16
    for _ in range(40):
        square = lower * lower
        root = (4 * (1 - square) / square ** 2) ** (1 / 3) if lower < 1 else 0.0
        a = np.sqrt(1 + root) + 0.5 * np.sqrt(max(0.0, 8 - 4 * root + 8 * (2 - square) / (square * np.sqrt(1 + root))))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            following = b / c * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        else:
            z = eye + c * (x.T @ x)
            following = b / c * x + (a - b / c) * np.linalg.solve(z, x.T).T
        following = (following + following.T) / 2
        moved = np.linalg.norm(following - x)
        x = following
        lower = min(1.0, lower * (a + b * square) / (1 + c * square))
        if moved < 1e-13 * np.sqrt(size) and abs(1 - lower) < 1e-12:
            break
    return x


def _shifts(matrix: np.ndarray) -> Iterator[float]:
    """Places to cut the spectrum: the middle of the diagonal first, then points between its bounds."""
    diagonal = np.sort(np.diag(matrix))
    yield float(np.median(diagonal))
    yield float(np.mean(diagonal))
    spread = np.linalg.norm(matrix - np.diag(np.diag(matrix)))
    low, high = diagonal[0] - spread, diagonal[-1] + spread
    for parts in (2, 3, 5, 7, 11, 13, 17, 29, 41):
        for k in range(1, parts):
            yield float(low + (high - low) * k / parts)


def _split(matrix: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above a shift and of the others; None where no shift parts them."""
    size = len(matrix)
    best = None
    for shift in _shifts(matrix):
        moved = matrix - shift * np.eye(size)
        if not np.linalg.norm(moved):
            continue
        projector = (_polar(moved) + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        # The longest remaining column joins the basis; a second pass makes both bases orthonormal to rounding.
        held, order = projector.copy(), []
        for _ in range(rank):
            at = int(np.argmax((held * held).sum(axis=0)))
            order.append(at)
            unit = held[:, at] / np.linalg.norm(held[:, at])
            held -= np.outer(unit, unit @ held)
        rest = [k for k in range(size) if k not in set(order)]
        whole, _ = np.linalg.qr(np.hstack([projector @ projector[:, order], np.eye(size)[:, rest]]))
        upper, lower = whole[:, :rank], whole[:, rank:]
        leak = np.linalg.norm(lower.T @ matrix @ upper)
        if best is None or leak < best[0]:
            best = leak, upper, lower
        if leak <= noise:
            break
    return None if best is None else best[1:]


def spectrum(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue.

    Of equal eigenvalues any orthonormal basis is right.
    """
    size = len(matrix)
    matrix = (matrix + matrix.T) / 2
    noise = 8 * size * np.finfo(float).eps * np.linalg.norm(matrix)
    values, vectors = np.zeros(size), np.zeros((size, size))
    work, done = [np.eye(size)], 0
    while work:
        basis = work.pop()
        own = basis.T @ matrix @ basis
        own = (own + own.T) / 2
        width = len(own)
        centre = np.trace(own) / width
        halves = None
        if width > 1 and np.linalg.norm(own - centre * np.eye(width)) > noise / 8:
            halves = _split(own, noise)
        if halves is None:
            values[done:done + width], vectors[:, done:done + width] = np.diag(own), basis
            done += width
        else:
            work += [basis @ half for half in halves]
    # Residues left by the splits are removed to second order.
    own = vectors.T @ matrix @ vectors
    gap = np.diag(own)[None, :] - np.diag(own)[:, None]
    turn = np.divide(own, gap, out=np.zeros_like(own), where=np.abs(gap) > 1e3 * np.abs(own) + noise)
    np.fill_diagonal(turn, 0.0)
    vectors, upper = np.linalg.qr(vectors @ (np.eye(size) + turn))
    vectors = vectors * np.sign(np.diag(upper))
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _lists(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, x): rows whose vector has no null or non-finite entry."""
    return rows.select(F.col("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") > 0)
        & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors of a batch of lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(SCALE * np.clip(flat, -LIMIT, LIMIT)).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n; the whole part is taken off in integers."""
    return (x - sums // n) - (sums % n) / n


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _whole(part.column(part.num_columns - 1), width)


def _folded(rows: DataFrame, of: Callable, shape: tuple[int, int], kind: str) -> np.ndarray:
    """Sum over all rows of ``of(piece)``, a matrix of ``shape``: one per task, then one row of it per key."""
    height, width = shape
    lines = rows.mapInArrow(lambda batches: _partial(batches, of, shape, kind), f"line int, part array<{kind}>")
    sums = lines.select("line", F.posexplode("part").alias("at", "value")).groupBy("line", "at").agg(F.sum("value").alias("value"))
    total = np.zeros((height, width), np.int64 if kind == "bigint" else float)
    for line, at, value in sums.collect():
        total[line, at] = value
    return total


def _partial(batches: Iterator[pa.RecordBatch], of: Callable, shape: tuple[int, int], kind: str) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(shape, np.int64 if kind == "bigint" else float), False
    for batch in batches:
        if batch.num_rows:
            total, seen = total + of(batch), True
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(shape[0]), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64() if kind == "bigint" else pa.float64()))],
            names=["line", "part"])


def fit(rows: DataFrame, vector: str = "embedding") -> dict | None:
    """Width, n, S, eigenvalues, components (columns) and trace over all usable rows; None where there are none.

    Vectors of another length than most rows have (of ties, the longest) are not usable.
    """
    lists = _lists(rows, vector)
    widths = lists.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("many"))
    most = widths.agg(F.max(F.struct("many", "width")).alias("most")).first()["most"]
    if most is None:
        return None
    n, width = int(most["many"]), int(most["width"])
    usable = lists.where(F.size("x") == width).select("x")

    def summed(batch: pa.RecordBatch) -> np.ndarray:
        return sum(x.sum(axis=0, keepdims=True) for _, x in _pieces(iter([batch]), width))

    sums = _folded(usable, summed, (1, width), "bigint")[0]

    def products(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((width, width))
        for _, x in _pieces(iter([batch]), width):
            centred = _centred(x, n, sums)
            total += centred.T @ centred
        return total

    covariance = _folded(usable, products, (width, width), "double") / n
    values, vectors = spectrum(covariance)
    return {"width": width, "n": n, "sums": sums, "values": values, "vectors": vectors, "trace": float(np.trace(covariance))}


def _scales(model: dict, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Components that carry variance, as columns divided by the root of it, and which of the first ones those are."""
    count = min(components, model["width"])
    floor = model["width"] * np.finfo(float).eps * max(model["values"][0], 0.0)
    live = np.flatnonzero(model["values"][:count] > floor)
    return model["vectors"][:, live] / np.sqrt(model["values"][live]), live


def identity_error(rows: DataFrame, model: dict, components: int = COMPONENTS, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    frame, live = _scales(model, components)
    if not len(live):
        return None
    width, n, sums = model["width"], model["n"], model["sums"]
    usable = _lists(rows, vector).where(F.size("x") == width).select("x")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((len(live) + 1, len(live)))
        for _, x in _pieces(iter([batch]), width):
            whitened = _centred(x, n, sums) @ frame
            total += np.vstack([whitened.T @ whitened, whitened.sum(axis=0)])
        return total

    total = _folded(usable, moments, (len(live) + 1, len(live)), "double") / n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(live))).max())


def transform(rows: DataFrame, model: dict, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened): one row per usable row, ``whitened`` an array by component.

    ``deviation`` is the exact sum of (n*x - S)^2, null where it leaves a long.
    A component without variance gives null.
    """
    width, n, sums = model["width"], model["n"], model["sums"]
    count = min(components, width)
    frame, live = _scales(model, components)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _pieces(batches, width):
            centred = _centred(x, n, sums)
            fits = ((n * centred) ** 2).sum(axis=1) < 9.2e18
            exact = (np.where(fits[:, None], n * (x - sums // n) - sums % n, 0) ** 2).sum(axis=1)
            out = np.full((len(x), count), np.nan)
            out[:, live] = centred @ frame
            listed = pa.array(out.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(exact, pa.int64(), mask=~fits),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) * count + 1, count), pa.int32()), listed)],
                names=["vec_id", "deviation", "whitened"])

    usable = _lists(rows, vector).where(F.size("x") == width)
    kind = usable.schema["vec_id"].dataType.simpleString()
    return usable.mapInArrow(convert, f"vec_id {kind}, deviation long, whitened array<double>")


def report(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Per usable row and component up to ``components``: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of an unusual length, or holds null or
    non-finite entries are left out. Repeated rows all count, null ids stay null,
    other columns are ignored, and an empty table gives no rows. Where all rows
    are alike nothing varies: ``whitened``, ``explained`` and the error are null.
    Entries beyond 2^30 in size count as 2^30.
    """
    model = fit(rows, vector)
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {schema}")
    error = identity_error(rows, model, components, vector)
    trace = model["trace"]
    shares = [float(max(e, 0.0) / trace) if trace > 0 else None for e in model["values"][:min(components, model["width"])]]
    wide = transform(rows, model, components, vector)
    return wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(shares).cast("array<double>") if all(s is not None for s in shares) else F.array_repeat(F.lit(None).cast("double"), len(shares)),
                     F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
