"""Operator 12: embedding whitening by QDWH spectral divide-and-conquer.

Entries are put on a whole-number grid, ``x = floor(SCALE * c) + SHIFT``, so that counts,
sums and deviations are exact.

1. Moments. One scan gives the number of vectors and the exact sums of every dimension
   (high and low halves apart, so that no sum leaves 64 bits).
2. Covariance. A second scan centres the vectors by the mean - first by its nearest whole
   numbers, exactly, then by the fraction left - and multiplies. A task hands on one
   dim x dim matrix, by rows; the rows are added up in Spark. The driver receives one
   matrix, whose size is the dimension's and does not grow with the table.
3. Spectrum. ``spectrum`` splits the covariance: the polar factor U of ``A - s I``, by the
   QDWH iteration (dynamically weighted Halley steps, each a QR factorisation of stacked
   matrices), has the eigenvalues +1 and -1 for those of A above and below s, so
   ``(I + U) / 2`` is a spectral projector. A QR factorisation of it gives orthonormal bases
   of the two invariant subspaces; A is restricted to each and split again, until blocks
   are single components or multiples of the identity.
4. Whitening. The components (at most dim x 32 numbers) are broadcast, and a third scan
   projects every centred vector and divides by the root of the eigenvalue. The rows are
   written, and a scan over them measures how far their covariance is from the identity.

Defined cases: vectors that are null, hold null or non-finite entries, or entries of which
``SCALE * c`` passes 2^52 (no whole number of them is exact) are dropped; where lengths
differ, the most common one counts (ties: the longest) and vectors of another length are
dropped; an empty table, or one of empty vectors, gives no rows; repeated rows are kept;
a null id is kept. A component without variance (one vector, equal vectors, dependent
dimensions) has null ``whitened``, and no share in the identity error; ``explained`` is null
if there is no variance at all. A deviation beyond 64 bits is null. Eigenvectors of equal
eigenvalues are any orthonormal basis of their space. Further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, written

#: Grid of the entries.
SCALE, SHIFT = 64.0, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Largest magnitude of a scaled entry.
MAX_SCALED = 2.0**52
#: Vectors multiplied at a time.
BLOCK = 4096
#: An eigenvalue below this share of the largest, times the dimension, is no variance.
RANK_TOL = 2.0**-50


# -- spectral divide-and-conquer (dim x dim matrices) ---------------------------

def polar_unitary(a: np.ndarray, low: float = 1e-17, steps: int = 12) -> np.ndarray:
    """The orthogonal factor U of the polar decomposition ``a = U H`` of a square matrix.

    QDWH: with all singular values in [l, 1], a Halley step whose weights fit l maps them
    into an interval nearer to 1; l starts at ``low``, below any value that matters. The
    steps are inverse-free: each takes the QR factorisation of [sqrt(c) X; I].
    """
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    bound, eye = low, np.eye(n)
    for _ in range(steps):
        sq = bound * bound
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        weight = np.sqrt(1 + d) + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - sq) / (sq * np.sqrt(1 + d)), 0.0))
        weight = max(weight, 3.0)
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        bound = min(bound * (weight + b * sq) / (1 + c * sq), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if bound > 1 - 1e-15 and moved < 1e-9:  # third order: the next step changes nothing
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range and of the null space of a projector: two rounds of
    subspace iteration from its largest columns."""
    order = np.argsort(-np.diag(projector), kind="stable")
    q, _ = np.linalg.qr(projector[:, order])
    for _ in range(2):
        head, _ = np.linalg.qr(projector @ q[:, :rank])
        full, _ = np.linalg.qr(np.hstack([head, q]), mode="complete")
        q = full
    head = q[:, :rank]
    tail = q[:, rank:] - projector @ q[:, rank:]
    tail, _ = np.linalg.qr(tail)
    return head, tail


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to split: the median of the diagonal, then the mean (always inside the
    spectrum unless all eigenvalues are equal), then others beside them."""
    d = np.sort(np.diag(a))
    mean = float(d.mean())
    yield float((d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2)
    yield mean
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / np.sqrt(len(a))
    for k in range(1, 40):
        yield mean + spread * (0.5 - (k * 0.6180339887498949) % 1.0)


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; none if the
    matrix is a multiple of the identity, to working precision relative to ``scale``."""
    n = len(a)
    eye = np.eye(n)
    if np.linalg.norm(a - np.trace(a) / n * eye) <= 4 * n * np.finfo(float).eps * scale:
        return None
    best = None
    for shift in _shifts(a):
        u = polar_unitary(a - shift * eye)
        u = (u + u.T) / 2
        rank = int(round((np.trace(u) + n) / 2))
        if not 0 < rank < n:
            continue
        up, down = _bases((eye + u) / 2, rank)
        off = np.linalg.norm(up.T @ a @ down)
        if best is None or off < best[0]:
            best = (off, up, down)
        # a shift on an eigenvalue leaves no projector: the bases then couple, try another
        if off <= 8 * n * np.finfo(float).eps * scale:
            break
    return None if best is None else best[1:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    a = (np.asarray(a, dtype="f8") + np.asarray(a, dtype="f8").T) / 2
    n = len(a)
    scale = float(np.linalg.norm(a))
    done: list[np.ndarray] = []
    todo = [np.eye(n)] if n else []
    while todo:  # no recursion: a spectrum may split off one component at a time
        basis = todo.pop()
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        parts = split(block, scale) if len(block) > 1 else None
        if parts is None:
            done.append(basis)
        else:
            todo += [basis @ parts[1], basis @ parts[0]]
    if not n:
        return np.empty(0), np.empty((0, 0))
    v = _polished(a, np.hstack(done))
    v = v[:, np.argsort(-np.einsum("ij,ij->j", v, a @ v), kind="stable")]
    q, r = np.linalg.qr(v)  # takes from each vector what rounding left of those before it
    v = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _polished(a: np.ndarray, v: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Eigenvectors to working precision: first-order corrections (Ogita and Aishima) from the
    residuals ``V'V - I`` and ``V'AV``; pairs of eigenvalues closer than the residual are only
    made orthogonal."""
    for _ in range(rounds):
        r = np.eye(len(a)) - v.T @ v
        s = v.T @ (a @ v)
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        delta = 2 * (np.linalg.norm(off, 2) + np.linalg.norm(a, 2) * np.linalg.norm(r, 2))
        gap = e[None, :] - e[:, None]
        near = np.abs(gap) <= delta
        np.fill_diagonal(near, True)
        fix = np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1.0, gap))
        v = v + v @ fix
    return v


# -- Spark stages ----------------------------------------------------------------

def _matrix(column: pa.Array, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole-number vectors as int64) of a column of arrays, one pair for each length
    that occurs, or only for ``dim``; vectors that the operator drops are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.where(np.asarray(column.is_null()), -1, np.asarray(column.value_lengths().fill_null(-1)))
    values = column.flatten()  # without those of null vectors
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan), dtype="f8")
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    for d in ([dim] if dim is not None else np.unique(sizes[sizes >= 0]).tolist()):
        rows = np.flatnonzero(sizes == d)
        with np.errstate(invalid="ignore", over="ignore"):
            y = SCALE * flat[starts[rows][:, None] + np.arange(d)]
            good = (np.abs(y) < MAX_SCALED).all(axis=1)  # false for NaN as well
        yield rows[good], np.floor(y[good]).astype("i8") + SHIFT


def moments(vectors: DataFrame, column: str = "embedding") -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension) for the most common length."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in _matrix(batch.column(0)):
                if len(x):
                    d = x.shape[1]
                    h = held.setdefault(d, [0, np.zeros(d, "i8"), np.zeros(d, "i8")])
                    h[0] += len(x)
                    h[1] += (x >> 26).sum(axis=0)
                    h[2] += (x & ((1 << 26) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"dim": pa.array(list(held), pa.int32()), "n": pa.array([h[0] for h in held.values()], pa.int64()),
             "hi": pa.array([h[1] for h in held.values()], pa.list_(pa.int64())),
             "lo": pa.array([h[2] for h in held.values()], pa.list_(pa.int64()))})

    parts = written(vectors.select(column).mapInArrow(scan, "dim int, n long, hi array<long>, lo array<long>"), "moments")
    top = (parts.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).first())
    if top is None or not top.dim:
        return 0, []
    sums = (parts.where(F.col("dim") == top.dim)
            .select(F.posexplode(F.arrays_zip("hi", "lo")).alias("k", "s"))
            .groupBy("k").agg(F.sum("s.hi").alias("hi"), F.sum("s.lo").alias("lo")).collect())  # a row per dimension
    by = {r.k: (r.hi << 26) + r.lo for r in sums}
    return int(top.n), [by[k] for k in range(top.dim)]


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the fractions left, both exact to their precision."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    left = [(s - m * n) / n for s, m in zip(sums, whole)]
    return np.array(whole, dtype="i8"), np.array(left, dtype="f8")


def _added_up(parts: DataFrame, d: int) -> np.ndarray:
    """The sum of matrices that come as (row number, row as bytes), one matrix a task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column("k").to_pylist(), batch.column("row").to_pylist()):
                held[k] = held.get(k, 0.0) + np.frombuffer(row, dtype="<f8")
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(held), pa.int32()),
                                          "row": pa.array([r.tobytes() for r in held.values()], pa.binary())})

    out = np.zeros((d, d))
    by_row = parts.repartition(min(d, shuffle_parts(parts.sparkSession)), "k")
    for r in by_row.mapInArrow(add, "k int, row binary").collect():  # one dim x dim matrix
        out[r.k] = np.frombuffer(bytes(r.row), dtype="<f8")
    return out


def _products(batches: Iterator[np.ndarray], d: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((d, d))
    for y in batches:
        for at in range(0, len(y), BLOCK):
            total += y[at:at + BLOCK].T @ y[at:at + BLOCK]
    yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()),
                                      "row": pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())})


def covariance(vectors: DataFrame, n: int, sums: list[int], column: str = "embedding") -> np.ndarray:
    """The covariance matrix (divisor n) of the whole-number vectors, centred before multiplying."""
    d = len(sums)
    whole, left = _centre(n, sums)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _products(((x - whole) - left for b in batches for _, x in _matrix(b.column(0), d)), d)

    return _added_up(vectors.select(column).mapInArrow(scan, "k int, row binary"), d) / n


def deviations(x: np.ndarray, n: int, whole: np.ndarray, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of ``(n x - S)^2`` of every vector, exact; null beyond 64 bits."""
    y = x - whole
    rest = [s - n * int(m) for s, m in zip(sums, whole.tolist())]
    if not len(y):
        return []
    top = n * int(np.abs(y).max()) + max(map(abs, rest))
    if top * top * len(rest) < 2**63:
        t = n * y - np.array(rest, dtype="i8")
        return (t * t).sum(axis=1).tolist()
    out = []
    for row in y.tolist():
        total = sum((n * v - r) ** 2 for v, r in zip(row, rest))
        out.append(total if total < 2**63 else None)
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for every
    remaining vector and component."""
    spark, key_type = vectors.sparkSession, vectors.schema[key].dataType
    schema = f"`{key}` {key_type.simpleString()}, n long, deviation long, w array<double>"
    n, sums = moments(vectors, column)
    if not n:
        out = spark.createDataFrame([], schema)
        shares, error = [], None
    else:
        cov = covariance(vectors, n, sums, column)
        e, v = spectrum(cov)
        d = len(sums)
        count = min(components, d)
        trace = float(np.trace(cov))
        real = e[:count] > max(e[0], 0.0) * d * RANK_TOL
        scaled = np.where(real, v[:, :count] / np.sqrt(np.where(real, e[:count], 1.0)), np.nan)
        whole, left = _centre(n, sums)
        shared = spark.sparkContext.broadcast((scaled, whole, left, sums))  # dim x 32 numbers

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, m, f, s = shared.value
            for batch in batches:
                for rows, x in _matrix(batch.column(1), len(s)):
                    w = ((x - m) - f) @ matrix
                    flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w).ravel())
                    ends = np.arange(len(w) + 1, dtype="i4") * w.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(w), n, "i8")),
                         pa.array(deviations(x, n, m, s), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)],
                        names=[key, "n", "deviation", "w"])

        out = written(vectors.select(key, column).mapInArrow(project, schema), "whitened")
        shares = [float(x) / trace if trace > 0 else None for x in e[:count]]
        error = identity_error(out, n, np.flatnonzero(real))
    share = F.element_at(F.array(*[F.lit(x).cast("double") for x in shares or [None]]), F.col("_c") + 1)
    return (out.select(key, "n", "deviation", F.posexplode("w").alias("_c", "whitened"))
            .select(key, (F.col("_c") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                    share.alias("explained"), F.lit(error).cast("double").alias("identity_error")))


def identity_error(out: DataFrame, n: int, real: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows less the identity,
    measured on the rows; null if no component has variance."""
    if not len(real):
        return None
    names = [f"m{k}" for k in real.tolist()]
    means = out.agg(*[F.avg(F.col("w")[int(k)]).alias(m) for k, m in zip(real, names)]).first()
    mean = np.array([means[m] for m in names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for b in batches:
                col = b.column(0)
                w = np.asarray(col.flatten().fill_null(0.0), dtype="f8").reshape(len(col), -1)
                yield w[:, real] - mean

        yield from _products(blocks(), len(real))

    cov = _added_up(out.select("w").mapInArrow(scan, "k int, row binary"), len(real)) / n
    return float(np.abs(cov - np.eye(len(real))).max())
