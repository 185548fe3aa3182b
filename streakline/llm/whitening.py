"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers x = floor(64 c) + 1000000. The distinct vectors, written once
to the shared folder, are what the covariance V is fitted on; with their number n and the
sums S of each dimension, n x - S is exact, so rows are centred without rounding. No
covariance matrix is made: a pass multiplies the centred rows with a thin block Q and adds
up XᵀXQ, in each task and then in Spark, so that a pass sends one dimension x block matrix
to the driver, whatever the number of rows.

Each iteration applies a Chebyshev polynomial of V to the block by such passes. The
polynomial is small on the unwanted part of the spectrum, from a bound below V's least
eigenvalue (a few Lanczos steps) to the least Ritz value of the block, and grows fast above
it. QR makes the block orthonormal, and one more pass gives the Rayleigh-Ritz pairs. The
components are certified when each wanted pair's residual |Vq - eq| is under ``TOLERANCE``
of the largest eigenvalue, or has stopped falling below ``FLOOR`` of it, in an iteration
whose block held a fresh random column: an eigenvector that the block had missed would have
grown in that column and changed the pairs. A block of all dimensions is exact at once.

Vectors that are null or hold null, NaN or infinite entries are dropped, and those whose
length is not the commonest (of equally common ones the longest). Components without
variance cannot be whitened and are left out, so vectors that are all alike, fewer
dimensions than components, and empty tables give fewer rows or none. Equal rows and null
ids are kept as they are. A deviation beyond a long ends the query with an overflow error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import stage, table

COMPONENTS = 16
#: Columns of the block beyond the wanted ones.
GUARDS = 16
DEGREE = 10
LANCZOS_STEPS = 8
TOLERANCE = 1e-14
FLOOR = 1e-11
MAX_ITERATIONS = 200
#: Share of the trace under which an eigenvalue is no variance but rounding.
NO_VARIANCE = 1e-13
SEED = 13
ROWS_AT_ONCE = 4096


def whole_numbers(embedding: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """The entries as long; null where the vector or an entry is null or not finite."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    x = F.transform(embedding, lambda c: F.floor(scale * c.cast("double")) + shift)
    return F.when(embedding.isNotNull() & finite, x)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.slice(begin, ROWS_AT_ONCE)
            yield rows, rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _slots(values: np.ndarray, kind) -> Iterator[pa.RecordBatch]:
    flat = values.reshape(-1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat, kind)], ["slot", "value"])


@dataclass
class FitList:
    """The distinct vectors (x) of one length, their number and sums."""

    vectors: DataFrame
    n: int
    sums: np.ndarray

    @property
    def d(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return self.n * x - self.sums

    def _summed(self, task, shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all tasks of the arrays that ``task`` makes of its rows."""
        parts = self.vectors.mapInArrow(lambda b: _slots(task(b), pa.float64()), "slot long, value double")
        rows = parts.groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
        found = np.zeros(int(np.prod(shape)))
        found[rows["slot"].to_numpy()] = rows["value"].to_numpy()
        return found.reshape(shape)

    def times(self, q: np.ndarray) -> np.ndarray:
        """VQ by one pass over the centred rows."""
        n, sums = self.n, self.sums

        def task(batches):
            total = np.zeros(q.shape)
            for _, x in _blocks(batches, len(sums)):
                y = (n * x - sums) / n
                total += y.T @ (y @ q)
            return total

        return self._summed(task, q.shape) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums

        def task(batches):
            return np.array([sum(float((((n * x - sums) / n) ** 2).sum()) for _, x in _blocks(batches, len(sums)))])

        return float(self._summed(task, (1,))[0]) / n


def fit_list(vectors: DataFrame) -> FitList | None:
    """The distinct rows of ``vectors`` (x) that have the commonest length."""
    distinct = stage(vectors.select("x").distinct(), "vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    commonest = sizes.where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if commonest is None:
        return None
    d = commonest["d"]
    own = distinct.where(F.size("x") == d)

    def task(batches):
        total = np.zeros(d, np.int64)
        for _, x in _blocks(batches, d):
            total += x.sum(axis=0)
        return total

    parts = own.mapInArrow(lambda b: _slots(task(b), pa.int64()), "slot long, value long")
    rows = parts.groupBy("slot").agg(F.sum("value").alias("value")).toPandas().sort_values("slot")
    return FitList(own, commonest["n"], rows["value"].to_numpy())


@dataclass
class Components:
    """Unit eigenvectors as columns, their eigenvalues, and V's trace."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    iterations: int = 0
    passes: int = 0


def _lower_bound(fit: FitList, rng: np.random.Generator) -> float:
    """A bound below the least eigenvalue: least Ritz value less the residual of a few
    Lanczos steps, and not under zero."""
    q, before, beta = rng.standard_normal(fit.d), np.zeros(fit.d), 0.0
    q /= np.linalg.norm(q)
    alphas, betas = [], []
    for _ in range(min(LANCZOS_STEPS, fit.d)):
        w = fit.times(q[:, None])[:, 0] - beta * before
        alphas.append(q @ w)
        w -= alphas[-1] * q
        beta = float(np.linalg.norm(w))
        betas.append(beta)
        if beta == 0:
            break
        before, q = q, w / beta
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, float(ritz[0]) - betas[-1])


def _filtered(fit: FitList, q: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of V that is small on [low, high] and one at ``top``, on q."""
    half, centre = (high - low) / 2, (high + low) / 2
    first = sigma = half / (top - centre)
    now = (fit.times(q) - centre * q) * (first / half)
    before = q
    for _ in range(DEGREE - 1):
        nxt = 1 / (2 / first - sigma)
        before, now = now, 2 * nxt / half * (fit.times(now) - centre * now) - sigma * nxt * before
        sigma = nxt
    return now


def _ritz(fit: FitList, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, Ritz vectors and the lengths of their residuals."""
    q, _ = np.linalg.qr(q)
    vq = fit.times(q)
    inner = q.T @ vq
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(vq @ turn - vectors * values, axis=0)


def components(fit: FitList, k: int = COMPONENTS, guards: int = GUARDS) -> Components:
    """The ``k`` leading components, certified as the module says."""
    rng = np.random.default_rng(SEED)
    trace = fit.trace()
    size = min(fit.d, k + guards)
    k = min(k, fit.d)
    values, vectors, residuals = _ritz(fit, rng.standard_normal((fit.d, size)))
    rounds, passes = 0, 2
    if size < fit.d and trace > 0:
        low, worst = _lower_bound(fit, rng), np.inf
        passes += LANCZOS_STEPS
        while rounds < MAX_ITERATIONS:
            # a guard column makes room for a fresh random one, which finds what was missed
            vectors[:, -1] = rng.standard_normal(fit.d)
            vectors[:, -1] /= np.linalg.norm(vectors[:, -1])
            high = values[-1] if values[-1] > low else (low + values[k - 1]) / 2
            if not low < high < values[0]:
                break
            values, vectors, residuals = _ritz(fit, _filtered(fit, vectors, low, high, values[0]))
            rounds, passes = rounds + 1, passes + DEGREE + 1
            last, worst = worst, float(residuals[:k].max()) / values[0]
            if worst <= TOLERANCE or (worst <= FLOOR and worst > last / 2):
                break
        else:
            raise ArithmeticError(f"residual {worst:.1e} after {MAX_ITERATIONS} iterations")
    found = int((values[:k] > NO_VARIANCE * trace).sum())
    return Components(vectors[:, :found], values[:found], trace, rounds, passes)


def identity_error(fit: FitList, found: Components) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    n, sums = fit.n, fit.sums
    project = found.vectors / np.sqrt(found.values)
    k = project.shape[1]

    def task(batches):
        total, squares = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, len(sums)):
            w = ((n * x - sums) / n) @ project
            total += w.sum(axis=0)
            squares += w.T @ w
        return np.vstack([total, squares])

    summed = fit._summed(task, (k + 1, k)) / n
    covariance = summed[1:] - np.outer(summed[0], summed[0])
    return float(np.abs(covariance - np.eye(k)).max())


def _exact_squares(deviations: np.ndarray) -> list[int]:
    """The sum of squares of each row, as whole numbers."""
    most = int(np.abs(deviations).max(initial=0))
    if most * most * deviations.shape[1] < 2**63:
        return (deviations * deviations).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in deviations.tolist()]


def whiten(vectors: DataFrame, keep: list[str], fit: FitList, found: Components) -> DataFrame:
    """The columns ``keep`` of ``vectors`` (x), the exact ``deviation`` of each row, and the
    row ``whitened`` as an array of one entry a component."""
    n, sums, d = fit.n, fit.sums, fit.d
    project = found.vectors / np.sqrt(found.values)
    k = project.shape[1]

    def task(batches):
        for rows, x in _blocks(batches, d):
            deviations = n * x - sums
            white = (deviations / n) @ project
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in keep),
                    pa.array(_exact_squares(deviations), pa.int64()),
                    pa.ListArray.from_arrays(np.arange(0, k * len(x) + 1, k, dtype=np.int32), white.reshape(-1)),
                ],
                [*keep, "deviation", "whitened"],
            )

    kept = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in keep)
    own = vectors.where(F.size("x") == d).select("x", *keep)
    return own.mapInArrow(task, f"{kept}deviation long, whitened array<double>")


EMPTY = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_components(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """A row of each vector of ``embeddings`` (vec_id, embedding) and component."""
    rows = embeddings.select("vec_id", whole_numbers(F.col("embedding")).alias("x")).where("x is not null")
    fit = fit_list(rows)
    found = components(fit, k) if fit else None
    if found is None or not len(found.values):
        return embeddings.sparkSession.createDataFrame([], EMPTY)
    explained = F.array(*(F.lit(float(v / found.trace)) for v in found.values))
    spread = whiten(rows, ["vec_id"], fit, found).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")
    )
    return spread.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(identity_error(fit, found)).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_components(table(spark, folder, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
