"""Embedding whitening by LOBPCG on a covariance that is only ever multiplied with blocks of vectors.

The leading eigenvectors of the vectors' covariance are found by the locally optimal block preconditioned conjugate
gradient method: each round takes the iterate, its residuals and the previous directions as one basis, multiplies the
covariance with it in one pass over the centred rows, and takes the best combination (Rayleigh-Ritz).  The covariance
itself is never formed: a task adds up ``A'(A b)`` over its rows, and the driver sees matrices of the vectors' width by
the basis alone.  Rounds go on until the residuals, taken from products and not from recurrences, are certified small; a
last pass certifies the whitened rows by their own covariance.

Entries are whole numbers (``floor(1024 c) + 100000``), so the sums and each row's deviation are exact.

Defined results: rows whose vector is null, of another length than most (of equally frequent ones the shorter), or that
holds null or non-finite entries, or such as do not fit in a long, take no part; repeated rows count each time, null ids
included; a component whose variance is nothing but rounding does not exist, so fewer than ``components`` may come out,
and none of one row alone or of equal rows; a deviation beyond a long is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, tune

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Further vectors in the block, which speed up the last wanted one; rounds at most; residual and rounding, relative to the largest eigenvalue.
GUARDS, ROUNDS, RESIDUAL, ROUNDING = 8, 500, 1e-13, 1e-12
#: Entries of a batch that are held as doubles at once.
BATCH_ENTRIES = 1 << 20


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and x (longs) of the rows that take part, all of one length."""
    c = F.transform(F.col(column).cast("array<double>"), lambda v: F.floor(v * SCALE))
    fits = F.forall(F.col(column).cast("array<double>"), lambda v: F.coalesce(F.abs(v * SCALE) < float(1 << 62), F.lit(False)))
    rows = vectors.where(F.coalesce(fits, F.lit(False)) & (F.size(column) > 0))
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(c, lambda v: v.cast("long") + SHIFT).alias("x"))
    rows = durable(rows, "whitening-rows")
    width = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return rows if width is None else rows.where(F.size("x") == width["width"])


@dataclass
class Centre:
    """Number and sums of the vectors, and their variances' sum."""

    n: int
    sums: list[int]
    trace: float = 0.0

    def centred(self, batch: pa.RecordBatch) -> np.ndarray:
        """x - S/n, from whole numbers where those fit."""
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(self.sums))
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return (x - np.array(whole, np.int64)) - np.array([r / self.n for r in rest])

    def deviations(self, batch: pa.RecordBatch) -> pa.Array:
        """Sum of (n x - S) squared: in arithmetic modulo 2**64, which is exact where doubles show that the sum fits."""
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(self.sums))
        about = ((self.centred(batch) * float(self.n)) ** 2).sum(axis=1)
        wrapped = x.astype(np.uint64) * np.uint64(self.n) - np.array([s % (1 << 64) for s in self.sums], np.uint64)
        exact = (wrapped * wrapped).sum(axis=1).astype(np.int64)
        # Between the doubles' rounding and the largest long there is one bit to spare; what lies there is added up in whole numbers.
        for at in np.flatnonzero((about > 2.0**62) & (about < 2.0**64)):
            total = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[at], self.sums, strict=True))
            about[at], exact[at] = (np.inf, 0) if total >= 1 << 63 else (0, total)
        return pa.array(exact, mask=about >= 2.0**63)


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BATCH_ENTRIES // width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _summed(rows: DataFrame, size: int, columns: int, of: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of the ``size`` x ``columns`` matrix that ``of`` makes of a batch: a task adds up its own, Spark theirs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, columns))
        for part in _parts(batches, width):
            total += of(part)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * columns), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), lists], ["i", "v"])

    added = rows.mapInArrow(work, "i int, v array<double>").groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(columns))).alias("v"))
    out = np.zeros((size, columns))
    for row in added.collect():  # a row a dimension
        out[row["i"]] = row["v"]
    return out


def centre(rows: DataFrame) -> Centre | None:
    """Exact sums (None without rows), and the variances' sum."""
    first = rows.select(F.size("x").alias("width")).first()
    if first is None:
        return None
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[j].cast("decimal(20,0)")).alias(f"s{j}") for j in range(first["width"]))).first()
    found = Centre(sums["n"], [int(s) for s in sums[1:]])
    found.trace = float(_summed(rows, 1, 1, lambda part: np.array([[(found.centred(part) ** 2).sum()]]), first["width"])[0, 0]) / found.n
    return found


def product(rows: DataFrame, about: Centre, block: np.ndarray) -> np.ndarray:
    """The covariance times ``block``, in one pass over the centred rows."""

    def of(part: pa.RecordBatch) -> np.ndarray:
        a = about.centred(part)
        return a.T @ (a @ block)

    return _summed(rows, len(block), block.shape[1], of, len(block)) / about.n


def _orthonormal(basis: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of the columns, less what ``against`` spans; columns that add nothing but rounding go."""
    for _ in range(2):
        if against is not None and against.shape[1]:
            basis = basis - against @ (against.T @ basis)
        norms = np.linalg.norm(basis, axis=0)
        basis = basis[:, norms > 0] / norms[norms > 0]
        if not basis.shape[1]:
            return basis
        u, s, _ = np.linalg.svd(basis, full_matrices=False)
        basis = u[:, s > 1e-8 * max(s.max(initial=0), 1e-300)]
    return basis


def lobpcg(multiply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guards: int = GUARDS, rounds: int = ROUNDS, residual: float = RESIDUAL, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their eigenvectors (as columns), certified by their residuals."""
    size = min(width, wanted + guards)
    x = _orthonormal(np.random.default_rng(seed).standard_normal((width, size)))
    directions = np.zeros((width, 0))
    left = np.zeros((width, 0))
    for _ in range(rounds):
        rest = _orthonormal(np.hstack([left, directions]), x) if left.shape[1] else left
        basis = np.hstack([x, rest])
        times = multiply(basis)
        small = basis.T @ times
        values, mix = np.linalg.eigh((small + small.T) / 2)
        mix = mix[:, ::-1][:, :size]
        values = values[::-1][:size]
        directions = rest @ mix[x.shape[1] :] if rest.shape[1] else rest
        x, image = basis @ mix, times @ mix
        left = image - x * values
        if np.linalg.norm(left[:, :wanted], axis=0).max(initial=0) <= residual * max(values.max(initial=0), 0) or basis.shape[1] == width:
            break
    else:
        raise RuntimeError(f"residuals of {np.linalg.norm(left[:, :wanted], axis=0).max():.3g} after {rounds} rounds")
    return values[:wanted], x[:, :wanted]


def components(rows: DataFrame, about: Centre, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors that stand out from rounding; each vector's largest entry is positive."""
    width = len(about.sums)
    if about.trace <= 0:
        return np.zeros(0), np.zeros((width, 0))
    values, vectors = lobpcg(lambda block: product(rows, about, block), width, min(wanted, width))
    stand = values > ROUNDING * about.trace
    values, vectors = values[stand], vectors[:, stand]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * signs


def whitened(vectors: DataFrame, wanted: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component."""
    schema = "vec_id long, deviation long, whitened array<double>"
    tune(vectors.sparkSession)
    rows = whole_vectors(vectors, key, column)
    about = centre(rows)
    values, axes = (np.zeros(0), np.zeros((0, 0))) if about is None else components(rows, about, wanted)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    scaled, count, width = axes / np.sqrt(values), len(values), len(axes)

    def of(part: pa.RecordBatch) -> np.ndarray:
        w = about.centred(part) @ scaled
        return w.T @ w

    error = float(np.abs(_summed(rows, count, count, of, width) / about.n - np.eye(count)).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, width):
            w = about.centred(part) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * count), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), about.deviations(part), lists], ["vec_id", "deviation", "whitened"])

    explained = F.array(*(F.lit(float(v / about.trace)) for v in values))
    each = rows.mapInArrow(work, schema).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(about.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
