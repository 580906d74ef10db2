"""Operator 13: embedding whitening by shifted CholeskyQR.

Vectors are put on an integer grid (``x = floor(GRID * c) + OFFSET``), and the
statistics are those of the fit list, each distinct x once.  Its rows are read in
passes, none of which gathers rows anywhere:

1. number and exact sums, which centre the rows;
2. Gram passes: the Gram matrix of the centred rows, summed over the tasks, is
   factored as R'R (Cholesky, at first with a small shift on the diagonal that
   keeps it positive definite), and the next pass orthogonalises the rows by
   triangular solves with all factors so far.  It ends when the Gram matrix is
   the identity, as a rule after the third pass;
3. R, the product of the factors, has the singular values and right singular
   vectors of the centred rows.  Its singular value decomposition (dimensions
   squared, on the driver) gives components and eigenvalues without ever
   forming the covariance, whose condition is the square of the rows';
4. one pass measures the covariance of the whitened fit list.

A task sends one row for each entry of the upper half of a Gram matrix, so what
is shuffled and collected depends on dimensions and tasks, not on rows.  Up to
``MAX_DIMENSIONS`` dimensions are accepted (larger ones raise).

Defined results: rows whose vector is null, or has null or non-finite entries,
are left out, and so are vectors of another length than most (of equally
frequent lengths the larger one counts).  Null ids and repeated rows are kept;
copies count once in the fit list.  Directions without variance are no
components, so one distinct vector, or an empty table, gives no rows.  A squared
deviation beyond 64 bits raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import bounded_broadcast, named, released, stored

GRID, OFFSET, COMPONENTS, MAX_DIMENSIONS = 64, 1_000_000, 16, 1024
#: Gram passes at most, and the distance from the identity at which they end.
MAX_PASSES, NEAR = 8, 1e-12
#: The shift is 11 (ROWS d + d (d + 1)) u times the squared norm; eigenvalues below RANK times the largest are none.
ROWS, RANK, UNIT = 1 << 16, 1e-12, 2.0**-53


def on_grid(df: DataFrame, vector_col: str, grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """``df`` without unusable vectors, and the others as long arrays in ``x``."""
    v = named(vector_col).cast("array<double>")
    fine = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (df.withColumn("_v", v).where(F.col("_v").isNotNull() & fine)
            .withColumn("x", F.transform("_v", lambda c: F.floor(grid * c) + offset)).drop("_v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(fit: DataFrame, shape: tuple[int, ...], kind: str, part) -> np.ndarray:
    """The sum of ``part(rows)`` over all rows of the fit list."""
    d, dtype = shape[-1], np.int64 if kind == "long" else np.float64

    def task(batches):
        total = np.zeros(shape, dtype=dtype)
        for batch in batches:
            if batch.num_rows:
                total += part(batch.column(0))
        at = np.flatnonzero(np.triu(np.ones(shape)) if len(shape) == 2 else np.ones(shape))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "value"])

    rows = fit.select("x").mapInArrow(released(task), f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(shape, dtype=dtype)
    for r in rows.collect():
        out.ravel()[r["at"]] = r["value"]
    return out if len(shape) == 1 else np.triu(out) + np.triu(out, 1).T[:d, :d]


def _orthogonalised(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for r in factors:  # rows R^-1, one triangular solve for each factor
        rows = np.linalg.solve(r.T, rows.T).T
    return rows


def _cholesky(gram: np.ndarray, shifted: bool) -> np.ndarray:
    d = len(gram)
    shift = 11 * (ROWS * d + d * (d + 1)) * UNIT * np.trace(gram)
    while True:
        try:
            return np.linalg.cholesky(gram + (shift if shifted else 0.0) * np.eye(d)).T
        except np.linalg.LinAlgError:  # rows without full rank
            shift, shifted = shift * (10 if shifted else 1), True


class Whitening:
    """What the passes find: n and the sums of the fit list, components (as
    columns, by falling eigenvalue), eigenvalues and trace of the covariance."""

    def __init__(self, n: int, sums: np.ndarray, components: np.ndarray, eigenvalues: np.ndarray, trace: float, passes: int):
        self.n, self.sums, self.components, self.eigenvalues = n, sums, components, eigenvalues
        self.trace, self.passes, self.identity_error = trace, passes, 0.0

    def projection(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and the matrix that takes centred rows to whitened ones."""
        return self.sums / self.n, self.components / np.sqrt(self.eigenvalues)


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a list of distinct grid vectors (column ``x``) of d
    dimensions; None for an empty list."""
    spark = vectors.sparkSession
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions exceed {MAX_DIMENSIONS}")
    n = vectors.count()
    if not n or not d:
        return None
    sums = _summed(vectors, (d,), "long", lambda c: _matrix(c, d).sum(axis=0))
    mean = sums / n
    factors: list[np.ndarray] = []
    for passes in range(1, MAX_PASSES + 1):  # noqa: B007
        given = bounded_broadcast(spark, (mean, factors), 8 * d * d * (len(factors) + 1))

        def part(column, given=given):
            mean, factors = given.value
            rows = _orthogonalised(_matrix(column, d) - mean, factors)
            return rows.T @ rows

        gram = _summed(vectors, (d, d), "double", part)
        if not factors:
            trace = float(np.trace(gram)) / n
            if trace <= 0:
                return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, passes)
        factors.append(_cholesky(gram, shifted=not factors))
        if np.abs(gram - np.eye(d)).max() <= NEAR * d:
            break
    r = np.eye(d)
    for factor in factors:
        r = factor @ r
    _, singular, right = np.linalg.svd(r)
    e = singular**2 / n
    k = min(components, int((e > RANK * e[0]).sum()))
    found = Whitening(n, sums, right[:k].T.copy(), e[:k].copy(), trace, passes)
    if k:
        given = bounded_broadcast(spark, found.projection(), 8 * d * (k + 1))

        def whitened(column):
            mean, projection = given.value
            rows = (_matrix(column, d) - mean) @ projection
            return rows.T @ rows

        found.identity_error = float(np.abs(_summed(vectors, (k, k), "double", whitened) / n - np.eye(k)).max())
    return found


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """For each usable row and component: the id, component (from 1), n,
    deviation, whitened, explained and identity_error."""
    spark = df.sparkSession
    schema = (f"id {df.select(named(id_col)).schema[0].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    out = [F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = on_grid(df.select(named(id_col).alias("id"), named(vector_col).alias("v")), "v", grid, offset).select("id", "x")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    rows = rows.where(F.size("x") == d)
    found = fit(stored(rows.select("x").distinct(), "whitening-fit"), d, components) if d else None
    if found is None or not len(found.eigenvalues):
        return spark.createDataFrame([], schema).select(*out)
    n, sums, error = found.n, found.sums, found.identity_error
    explained = found.eigenvalues / found.trace
    given = bounded_broadcast(spark, found.projection(), found.components.nbytes + 8 * d)

    def task(batches):
        mean, projection = given.value
        k = projection.shape[1]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), d)
            apart = np.abs(x * n - sums)
            if float(apart.max()) ** 2 * d >= 2.0**63 or float(np.abs(x).max()) * n >= 2.0**63:
                raise OverflowError("a squared deviation exceeds 64 bits")
            values = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n, dtype=np.int64),
                      np.repeat((apart * apart).sum(axis=1), k), ((x - mean) @ projection).ravel(),
                      np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), *(pa.array(v) for v in values)],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(released(task), schema).select(*out)
