"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, x = floor(64 c) + 1000000, packed into packed_rows of rows. A step
takes one distributed pass: every block computes u = Xw and adds its part of X'u, X being
the rows less their exact mean S/n. A left vector is never stored: it is Xw for a short w
that the driver keeps, so both sides are reorthogonalised against all earlier vectors with
arithmetic on vectors as long as one row. Where the recurrence breaks down, it goes on in a
random direction that is orthogonal to all earlier ones, so equal variances are found as
often as they occur. After as many steps as there are dimensions, the SVD of the small
bidiagonal matrix gives all components and deviations.

A row counts if its vector is not null, not empty, and has neither null nor non-finite
entries nor any beyond 2^46 in size (x would not be exact). If lengths differ, the most
frequent one counts, of several the greatest; rows of other lengths are left out. Rows that
repeat count as often as they occur, and a null id is a value like any other. Components
along which the rows do not vary have no whitened value (null), and explain 0. With no row
left the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplytic.llm.common import stored

COMPONENTS = 32
# How an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(2**46)
OUTPUT_ROWS = 2048
# A variance below this share of the largest is rounding, not variation.
NO_VARIATION = 1e-20


@dataclass(frozen=True)
class Moments:
    """Exact count and sums over the fit list, and the spread around its mean."""

    n: int
    sums: np.ndarray
    trace: float


@dataclass(frozen=True)
class Whitening:
    """``components`` (one per column), their variances, and what they were fitted on."""

    moments: Moments
    components: np.ndarray
    variances: np.ndarray
    identity_error: float


def _whole(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and those as rows of x."""
    sizes = np.diff(vectors.offsets.to_numpy())
    right = vectors.is_valid().to_numpy(zero_copy_only=False) & (sizes == width)
    rows = np.flatnonzero(right)
    chosen = vectors.take(pa.array(rows)).flatten()
    entries = chosen.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    good = (np.abs(entries) <= LARGEST).all(axis=1)  # false for NaN, which stands for null too
    x = np.floor(entries[good] * SCALE).astype(np.int64) + SHIFT
    return rows[good], x


def packed(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """``id`` and ``x`` (whole numbers, 8 bytes each) of every row that counts, and the length."""
    each = F.col(column)
    fits = F.forall(each, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    counts = F.coalesce(fits, F.lit(False))
    sizes = (
        vectors.filter(counts & (F.size(each) > 0))
        .groupBy(F.size(each).alias("width"))
        .agg(F.count("*").alias("rows"))
    )
    usual = sizes.orderBy(F.desc("rows"), F.desc("width")).first()
    width = usual["width"] if usual else 0
    kind = vectors.schema[id_column].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if width else ():
            lists = pa.concat_arrays([batch.column(1)]).cast(pa.list_(pa.float64()))
            rows, x = _whole(lists, width)
            row_bytes = pa.py_buffer(np.ascontiguousarray(x))
            fixed = pa.Array.from_buffers(pa.binary(8 * width), len(rows), [None, row_bytes])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), fixed.cast(pa.binary())],
                names=["id", "x"],
            )

    schema = T.StructType([T.StructField("id", kind), T.StructField("x", T.BinaryType())])
    return stored(vectors.select(id_column, column).mapInArrow(pack, schema), "vectors"), width


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """The packed vectors of a batch as a matrix, without a copy."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty((0, width), dtype=np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int64).reshape(-1, width)


def _sum_over_rows(packed_rows: DataFrame, width: int, length: int, part, wide: bool = False):
    """The sum of ``part(x)``, an array of ``length`` doubles, over all rows.

    A task adds up its batches; one row per task meets the others.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            total += part(_rows(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["part"])

    parts = packed_rows.select("x").mapInArrow(add, "part array<double>")
    if wide:
        rows = parts.select(F.posexplode("part")).groupBy("pos").agg(F.sum("col")).collect()
        sums = np.zeros(length)
        for at, value in rows:
            sums[at] = value
        return sums
    row = parts.agg(*[F.sum(F.get("part", F.lit(i))) for i in range(length)]).first()
    return np.array([v or 0.0 for v in row])


def moments(packed_rows: DataFrame, width: int) -> Moments:
    """One pass for the exact sums, in whole numbers, and one for the spread."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            rows = _rows(batch.column(0), width)
            n += len(rows)
            # Up to 2^52 each: a batch's sum may pass 2^63, that of the halves doesn't.
            high, low = rows >> 26, rows & ((1 << 26) - 1)
            both = zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)
            sums = [s + (h << 26) + v for s, (h, v) in zip(sums, both, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([[str(s) for s in (n, *sums)]])], names=["part"]
        )

    parts = packed_rows.select("x").mapInArrow(add, "part array<string>")
    row = parts.agg(
        *[F.sum(F.get("part", F.lit(i)).cast("decimal(28,0)")) for i in range(width + 1)]
    ).first()
    n, *sums = [int(v or 0) for v in row]
    exact = np.array(sums, dtype=object)
    if not n:
        return Moments(0, exact, 0.0)

    def spread(x: np.ndarray) -> np.ndarray:
        return np.array([np.square(centred(x, n, exact)).sum()])

    return Moments(n, exact, float(_sum_over_rows(packed_rows, width, 1, spread)[0]) / n)


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S as whole numbers, exact at any size."""
    top = max([n * (int(np.abs(x).max()) + 1), *(abs(s) for s in sums)]) if x.size else 0
    if top < 2**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return differences(x, n, sums).astype(np.float64) / n


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis``; the second round removes what rounding left."""
    for _ in range(2 if basis else 0):
        whole = np.array(basis)
        v = v - whole.T @ (whole @ v)
    return v


def bidiagonalise(packed_rows: DataFrame, width: int, at: Moments, seed: int = 7):
    """Right vectors (one per column) and the upper bidiagonal matrix, after ``width`` steps."""
    random = np.random.default_rng(seed)
    n, sums = at.n, at.sums

    def direction(basis: list[np.ndarray]) -> np.ndarray:
        v = _orthogonal(random.standard_normal(width), basis)
        return v / np.linalg.norm(v)

    scale = np.sqrt(at.trace * n)
    nothing = scale * 1e-13
    small = np.zeros((width, width))
    right, left, left_images = [direction([])], [], []
    beta, before = 0.0, None
    for step in range(width):
        v = right[step]
        w = v if before is None or beta == 0.0 else v - beta * before

        def product(x: np.ndarray, w=w) -> np.ndarray:
            rows = centred(x, n, sums)
            u = rows @ w
            return np.append(rows.T @ u, u @ u)

        whole = _sum_over_rows(packed_rows, width, width + 1, product)
        image, square = whole[:-1], whole[-1]
        # Left vectors are Xw: their inner products need w and X'u only.
        for _ in range(2):
            for other, other_image in zip(left, left_images, strict=True):
                along = other @ image
                w, image = w - along * other, image - along * other_image
                square -= along * along
        alpha = np.sqrt(max(square, 0.0, w @ image))
        following = step + 1 < width
        if alpha <= nothing:
            # The rows do not vary along v beyond what is known: go on elsewhere.
            before, beta = None, 0.0
            if following:
                right.append(direction(right))
            continue
        small[step, step] = alpha
        before, image = w / alpha, image / alpha
        left.append(before)
        left_images.append(image)
        if following:
            rest = _orthogonal(image, right)
            beta = np.linalg.norm(rest)
            if beta <= nothing:
                before, beta = None, 0.0
                right.append(direction(right))
            else:
                small[step, step + 1] = beta
                right.append(rest / beta)
    return np.array(right).T, small


def fit(packed_rows: DataFrame, width: int, most: int = COMPONENTS) -> Whitening | None:
    """Up to ``most`` components by falling variance; None if there are no rows."""
    at = moments(packed_rows, width) if width else None
    if at is None or not at.n:
        return None
    count = min(most, width)
    if at.trace <= 0.0:
        return Whitening(at, np.eye(width)[:, :count], np.zeros(count), 0.0)
    right, small = bidiagonalise(packed_rows, width, at)
    _, deviations, turned = np.linalg.svd(small)
    variances = np.square(deviations) / at.n
    variances[variances <= variances[0] * NO_VARIATION] = 0.0
    components = right @ turned.T
    components = components / np.linalg.norm(components, axis=0)
    kept, spread = components[:, :count], variances[:count]
    real = int((spread > 0).sum())
    return Whitening(at, kept, spread, _identity_error(packed_rows, width, at, kept, spread, real))


def _identity_error(packed_rows, width, at, components, variances, real) -> float:
    """How far the covariance of the whitened rows is from the identity, at most."""
    turned = components[:, :real] / np.sqrt(variances[:real])
    n, sums = at.n, at.sums

    def add(x: np.ndarray) -> np.ndarray:
        return (centred(x, n, sums) @ turned).sum(axis=0)

    mean = _sum_over_rows(packed_rows, width, real, add) / n

    def products(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums) @ turned - mean
        return (y.T @ y).ravel()

    found = _sum_over_rows(packed_rows, width, real * real, products, wide=True) / n
    return float(np.abs(found.reshape(real, real) - np.eye(real)).max())


def whiten(
    vectors: DataFrame,
    id_column: str = "vec_id",
    column: str = "embedding",
    most: int = COMPONENTS,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row.

    ``deviation`` is a long; a row for which the exact value needs more has null there.
    """
    kind = vectors.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField("vec_id", kind),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    packed_rows, width = packed(vectors, id_column, column)
    fitted = fit(packed_rows, width, most)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, trace = fitted.moments.n, fitted.moments.sums, fitted.moments.trace
    count = len(fitted.variances)
    varied = fitted.variances > 0
    scales = np.sqrt(np.where(varied, fitted.variances, 1.0))
    turned = fitted.components / scales
    explained = fitted.variances / trace if trace > 0 else np.zeros(count)
    error = fitted.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, OUTPUT_ROWS):
                part = batch.slice(begin, OUTPUT_ROWS)
                x = _rows(part.column(1), width)
                exact = differences(x, n, sums)
                largest = max(int(exact.max()), -int(exact.min()))
                if width * largest * largest >= 2**63:
                    exact = exact.astype(object)
                squares = (exact * exact).sum(axis=1).tolist()
                deviation = [s if s < 2**63 else None for s in squares]
                y = centred(x, n, sums) @ turned
                m = len(x)
                each = np.repeat(np.arange(m), count)
                blank = np.tile(~varied, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * count, n, dtype=np.int64)),
                        pa.array(deviation, pa.int64()).take(pa.array(each)),
                        pa.array(y.ravel(), mask=blank),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * count, error)),
                    ],
                    names=schema.names,
                )

    return packed_rows.mapInArrow(project, schema)
