"""Whitening of embeddings: projections on the leading components, scaled to unit variance.

Method: mixed-precision refinement. Spark sums the covariance; its float32 eigenvectors are then
corrected by Ogita-Aishima iterations, matrix products in extended precision that about double the
right digits each time. Eigenvalues too close for the present accuracy form a cluster, whose
vectors are turned by solving the small problem of their own, shifted by their mean."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import input_columns, output_field

COMPONENTS = 8
# An entry c becomes the integer floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more have no place in the exact sums.
MOST = float(1 << 30)
_HALF_BITS = 21  # two halves of a difference; products of 2^11 rows of them stay exact in doubles
_EXACT_ROWS = 1 << 11
_LONG = (1 << 63) - 1
_WIDE = np.longdouble
_STEPS, _SMALL_STEP = 8, 1e-10
#: Eigenvalues closer than this share of the largest are left to the small problems at any
#: accuracy: between them a step would divide rounding by rounding.
_CLOSE = 2.0**-30
#: Below this share of the largest, an eigenvalue can not be told from zero.
_NO_VARIANCE = 1e-15


# --- eigenvectors of a small symmetric matrix -----------------------------------------------


def _clusters(values: np.ndarray, gap: float) -> np.ndarray:
    """A number per eigenvalue; neighbours within the gap share theirs."""
    order = np.argsort(values, kind="stable")
    numbers = np.empty(len(values), int)
    numbers[order] = np.concatenate([[0], np.cumsum(np.diff(values[order]) > gap)])
    return numbers


def _refine(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: better vectors, the cluster of each, and the size of the step.
    Eigenvalues that can not be told apart yet share a cluster, in which only angles are mended."""
    rest = np.eye(len(vectors), dtype=_WIDE) - vectors.T @ vectors
    inner = vectors.T @ (matrix @ vectors)
    values = np.diag(inner) / (1 - np.diag(rest))
    size = lambda m: np.sqrt((m * m).sum())
    gap = 2 * (size(inner - np.diag(values)) + size(matrix) * size(rest))
    clusters = _clusters(values, max(gap, _CLOSE * np.abs(values).max()))
    told = clusters[None, :] != clusters[:, None]
    apart = np.where(told, values[None, :] - values[:, None], 1)
    step = np.where(told, (inner + values[None, :] * rest) / apart, rest / 2)
    return vectors + vectors @ step, clusters, float(np.abs(step).max())


def _turn(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vectors of a cluster turned towards its own eigenvectors: the matrix in their span,
    less its mean, is small, so double precision tells apart what the whole matrix does not."""
    inner = vectors.T @ (matrix @ vectors)
    inner = inner - np.eye(len(inner), dtype=_WIDE) * (np.trace(inner) / len(inner))
    most = np.abs(inner).max()
    if most == 0:
        return vectors
    return vectors @ np.linalg.eigh((inner / most).astype(np.float64))[1].astype(_WIDE)


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, in extended precision. The entry of
    largest size in each is positive."""
    matrix = matrix.astype(_WIDE)
    most = np.abs(matrix).max() if matrix.size else 0
    if most == 0:
        return np.zeros(len(matrix), _WIDE), np.eye(len(matrix), dtype=_WIDE)
    scaled = matrix / most
    vectors = np.linalg.eigh(scaled.astype(np.float32))[1].astype(_WIDE)
    for _ in range(_STEPS):
        vectors, clusters, step = _refine(scaled, vectors)
        if step < _SMALL_STEP:  # its square is below rounding; vectors of equal eigenvalues never settle
            break
        for number in np.flatnonzero(np.bincount(clusters) > 1):
            group = clusters == number
            vectors[:, group] = _turn(scaled, vectors[:, group])
    for _ in range(2):  # a turn in double precision leaves the angles right to double precision only
        vectors = vectors + vectors @ (np.eye(len(vectors), dtype=_WIDE) - vectors.T @ vectors) / 2
    values = np.einsum("ij,ij->j", vectors, scaled @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(vectors))])
    return values[order] * most, vectors * signs


# --- distributed sums ------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The batch's vectors as integers x."""
    entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each dimension."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def work(batches):
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch, width)
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"dim": range(width), "n": [n] * width, "total": list(total)}, schema=schema)

    rows = fit.select("vector").mapInArrow(work, "dim int, n bigint, total decimal(38,0)")
    found = sorted(rows.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())  # one row per dimension
    return found[0].n, [int(r.total) for r in found]


def _products(y: np.ndarray) -> np.ndarray:
    """y^T y as Python integers. Halves of the entries are multiplied as doubles, few enough rows
    at a time to be exact."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), _EXACT_ROWS):
        part = y[start : start + _EXACT_ROWS]
        high, low = (part >> _HALF_BITS).astype(np.float64), (part & ((1 << _HALF_BITS) - 1)).astype(np.float64)
        cross = (high.T @ low).astype(np.int64).astype(object)
        hh, ll = ((m.T @ m).astype(np.int64).astype(object) for m in (high, low))
        total = total + (hh << (2 * _HALF_BITS)) + ((cross + cross.T) << _HALF_BITS) + ll
    return total


def _covariance(fit: DataFrame, n: int, centre: np.ndarray, rest: list[int]) -> np.ndarray:
    """Covariance with divisor n. Vectors are centred by the whole part of their mean before they
    are multiplied, in integers; what is left of the mean, below one, is then taken off exactly."""
    width = len(centre)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])
    upper = np.triu_indices(width)

    def work(batches):
        total = np.zeros((width, width), object)
        for batch in batches:
            total = total + _products(_matrix(batch, width) - centre)
        yield pa.RecordBatch.from_pydict({"i": upper[0], "j": upper[1], "total": list(total[upper])}, schema=schema)

    rows = fit.select("vector").mapInArrow(work, "i int, j int, total decimal(38,0)")
    out = np.zeros((width, width), _WIDE)
    for r in rows.groupBy("i", "j").agg(F.sum("total").alias("total")).toLocalIterator():  # bounded by dimensions, not rows
        exact = Fraction(n * int(r.total) - rest[r.i] * rest[r.j], n * n)
        near = float(exact)
        out[r.i, r.j] = out[r.j, r.i] = _WIDE(near) + _WIDE(float(exact - Fraction(near)))
    return out


def _whitened(x: np.ndarray, centre: np.ndarray, rest: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return ((x - centre) - rest) @ axes


def _identity_error(fit: DataFrame, n: int, centre: np.ndarray, rest: np.ndarray, axes: np.ndarray) -> float | None:
    """Largest entry, in size, of the whitened covariance less the identity. Whitened values are
    centred by how they are made; what rounding leaves of a mean is taken off."""
    width, count = len(centre), axes.shape[1]
    if count == 0:
        return None
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])
    pairs = [(i, j) for i in range(count) for j in range(i, count)]

    def work(batches):
        sums, products = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = _whitened(_matrix(batch, width), centre, rest, axes)
            sums += w.sum(axis=0)
            products += w.T @ w
        rows = [(i, -1, s) for i, s in enumerate(sums)] + [(i, j, products[i, j]) for i, j in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = fit.select("vector").mapInArrow(work, "i int, j int, total double")
    found = {(r.i, r.j): r.total / n for r in rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    return max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i, j in pairs)


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum of (n*x - S)^2 over the dimensions of each row, exact; null beyond the range of a long."""
    width, most = y.shape[1], (int(np.abs(y).max()) + 1) * n if len(y) else 0
    if most * most * width <= _LONG:
        off = n * y - np.array(rest, np.int64)
        return list((off * off).sum(axis=1))
    off = n * y.astype(object) - np.array(rest, object)
    return [d if d <= _LONG else None for d in (off * off).sum(axis=1)]


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    usable vector and each of the leading components.

    Entries become integers x = floor(1024 c) + 100000; covariance, mean and deviation are exact
    sums of these. Only the sums of dimensions and of their pairs reach the driver.

    Unusable and dropped: null vectors; null, NaN or infinite entries, or entries of 2^30 and more;
    vectors whose length is not that of most (of equally many, the longest). Vectors of fewer
    dimensions than `components` have as many components. Along a component without variance (as
    all are if all vectors are equal) `whitened` is null, and such components have no part in
    `identity_error`; with no variance at all that and `explained` are null too. A deviation beyond
    the range of a long is null. Ids may repeat or be null: each row counts. An empty table gives no
    rows; other columns are ignored."""
    rows = input_columns(embeddings, vec_id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    usable = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < MOST)))
    lengths = usable.groupBy(F.size("vector").alias("width")).count()
    kind = output_field(rows, "vec_id")
    ddl = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    most = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    if most is None or most.width == 0:
        return embeddings.sparkSession.createDataFrame([], ddl)
    width = most.width
    fit = usable.filter(F.size("vector") == width)
    n, sums = _sums(fit, width)
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    centre, part = np.array(whole, np.int64), np.array([float(Fraction(r, n)) for r in rest])
    covariance = _covariance(fit, n, centre, rest)
    values, vectors = eigenvectors(covariance)
    count = min(components, width)
    trace = np.trace(covariance)
    real = [bool(values[k] > _NO_VARIANCE * values[0]) for k in range(count)]
    explained = [float(values[k] / trace) if trace > 0 else None for k in range(count)]
    live = sum(real)  # eigenvalues fall, so these come first
    axes = (vectors[:, :live] / np.sqrt(values[:live])).astype(np.float64)
    error = _identity_error(fit, n, centre, part, axes)
    schema = pa.schema([
        ("vec_id", to_arrow_type(rows.schema["vec_id"].dataType)), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def work(batches):
        for batch in batches:
            x = _matrix(batch, width)
            own = len(x)
            w = np.full((own, count), np.nan)
            w[:, :live] = _whitened(x, centre, part, axes)
            missing = np.tile(np.arange(count) >= live, own)
            deviations = pa.array(_deviations(x - centre, n, rest), pa.int64())
            rows_of = np.repeat(np.arange(own), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows_of)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), own)),
                    pa.array(np.full(own * count, n)),
                    deviations.take(pa.array(rows_of)),
                    pa.array(w.ravel(), mask=missing),
                    pa.array(explained * own, pa.float64()),
                    pa.array([error] * (own * count), pa.float64()),
                ],
                schema=schema,
            )

    return fit.mapInArrow(work, ddl)
