"""Whitening of embedding vectors along their leading components, found by Jacobi-Davidson.

The covariance is never formed: every product with it is a Spark job that centres the vectors, multiplies them in batches
and sums d x b numbers. Each outer round does Rayleigh-Ritz in the search space, locks the leading pairs whose residuals
are at rounding level, and widens the space by corrections: for every open pair the equation projected against all locked
and current vectors is solved by MINRES. The inner solvers of all pairs advance together, so a step of all is one job.
The driver holds the search space (d x SPACE numbers), never vectors of the corpus.

Entries become whole numbers (`lattice`), sums are exact, and vectors are centred as whole numbers plus a fraction, so no digits are
lost. Null vectors and vectors with null or non-finite entries go; so do empty vectors, vectors with an entry beyond 2^42 in
size, and those of another length than the commonest one (ties: the longest). Null ids stay; repeated rows count each.
Without vectors the result is empty. Directions without variance (equal vectors, a single vector) have no component. A
`deviation` beyond 64 bits is null. Kept columns come in one struct, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 42)

SPACE = 96  # widest search space
SPARE = 4  # vectors of the space beyond the wanted ones, at the start and after a restart
INNER_STEPS = 4
INNER_GAIN = 0.1
EPS = float(np.finfo(np.float64).eps)
RESIDUAL = 64 * EPS  # of the largest eigenvalue: double precision
WORST_RESIDUAL = 1e-11  # beyond it a search that no longer improves is an error

Product = Callable[[np.ndarray], np.ndarray]


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a * a).sum(axis=0))


def _without(basis: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The part of a orthogonal to the basis; twice is enough."""
    for _ in range(2):
        a = a - basis @ (basis.T @ a)
    return a


def _fresh(basis: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Orthonormal columns that add to the basis what a has beyond it."""
    kept = basis
    for j in range(a.shape[1]):
        size = np.linalg.norm(a[:, j])
        if size > 0:
            v = _without(kept, a[:, j : j + 1] / size)
            length = np.linalg.norm(v)
            if length > 1e-10:
                v = _without(kept, v / length)
                kept = np.hstack([kept, v / np.linalg.norm(v)])
    return kept[:, basis.shape[1] :]


def minres(operator: Product, right: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Solve one symmetric system per column; the columns' recurrences advance together."""
    beta = _norms(right)
    goal = gain * beta
    safe = lambda x: np.where(x > 0, x, 1.0)
    v_old, v = np.zeros_like(right), right / safe(beta)
    w_old, w, x = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta, cos_old, cos, sin_old, sin = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        z = operator(v)
        delta = (v * z).sum(axis=0)
        z = z - delta * v - beta * v_old
        beta_next = _norms(z)
        diagonal = cos * delta - cos_old * sin * beta
        pivot = np.hypot(diagonal, beta_next)
        w_old, w = w, (v - sin_old * beta * w_old - (sin * delta + cos_old * cos * beta) * w) / safe(pivot)
        cos_old, cos = cos, np.where(pivot > 0, diagonal / safe(pivot), 0.0)
        sin_old, sin = sin, np.where(pivot > 0, beta_next / safe(pivot), 0.0)
        x = x + cos * eta * w
        eta = -sin * eta
        v_old, v, beta = v, z / safe(beta_next), beta_next
        if (np.abs(eta) <= goal).all():
            break
    return x


def jacobi_davidson(product: Product, dims: int, wanted: int, seed: int = 13, max_rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the largest eigenvalues of a positive semidefinite operator, falling, and unit vectors as columns."""
    wanted = min(wanted, dims)
    draw = np.random.default_rng(seed)
    locked, locked_values = np.zeros((dims, 0)), np.zeros(0)
    space = _fresh(locked, draw.standard_normal((dims, min(dims, wanted + SPARE))))
    image = product(space)
    largest, best, idle = 0.0, np.inf, 0
    for _ in range(max_rounds):
        projected = space.T @ image
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        largest = max(largest, values[0] if len(values) else 0.0)
        open_ = min(wanted - len(locked_values), space.shape[1])
        residuals = _without(locked, image[:, :open_] - space[:, :open_] * values[:open_])
        sizes = _norms(residuals)
        full = locked.shape[1] + space.shape[1] >= dims
        idle = idle + 1 if sizes.max() > best / 2 else 0
        best = min(best, sizes.max())
        done = sizes <= RESIDUAL * largest
        # The space cannot widen, or rounding hides further gains.
        if full or (idle >= 3 and sizes.max() <= WORST_RESIDUAL * largest):
            done = sizes <= WORST_RESIDUAL * largest
        ready = open_ if done.all() else int(np.argmin(done))
        if ready:
            locked = np.hstack([locked, space[:, :ready]])
            locked_values = np.concatenate([locked_values, values[:ready]])
            space, image, values, residuals = space[:, ready:], image[:, ready:], values[ready:], residuals[:, ready:]
            best, idle = np.inf, 0
        if len(locked_values) == wanted:
            order = np.argsort(-locked_values, kind="stable")
            return locked_values[order], locked[:, order]
        if full and not ready:
            break
        open_ = wanted - len(locked_values)
        if space.shape[1] + open_ > max(SPACE, 2 * wanted + SPARE):
            space, image = space[:, : open_ + SPARE], image[:, : open_ + SPARE]
        known, shifts = np.hstack([locked, space[:, :open_]]), values[:open_]

        def corrected(v: np.ndarray, known=known, shifts=shifts) -> np.ndarray:
            v = _without(known, v)
            return _without(known, product(v) - v * shifts)

        steps = minres(corrected, -_without(known, residuals), INNER_STEPS, INNER_GAIN)
        more = _fresh(np.hstack([locked, space]), steps)
        if not more.shape[1]:
            more = _fresh(np.hstack([locked, space]), draw.standard_normal((dims, 1)))
        if more.shape[1]:
            space, image = np.hstack([space, more]), np.hstack([image, product(more)])
    raise RuntimeError("residuals did not reach double precision")


def lattice(vectors: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """row (the kept columns) and x (bigint entries) of the usable vectors."""
    entries = F.transform(F.col(column), lambda c: c.cast("double") * SCALE)
    usable = F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))  # not a number is larger than any number
    rows = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(usable)
    x = F.transform(entries, lambda c: F.floor(c).cast("bigint") + SHIFT)
    return rows.select((F.struct(*keep) if keep else F.struct(F.lit(True).alias("present"))).alias("row"), x.alias("x"))


class Fit(NamedTuple):
    """The fit list: a written table (row, x), its size, and its sums per dimension."""

    rows: DataFrame
    n: int
    sums: list[int]


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dims)


def fit_list(vectors: DataFrame, column: str, keep: list[str]) -> Fit:
    rows = cut_lineage(lattice(vectors, column, keep), "lattice")
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return Fit(rows, 0, [])
    dims = common["dims"]
    rows = rows.filter(F.size("x") == dims)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = _whole(batch.column(0), dims).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(totals)], names=["i", "s"])

    sums = rows.select("x").mapInArrow(add, "i bigint, s bigint").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by_dim = {r["i"]: int(r["s"]) for r in sums.collect()}
    return Fit(rows, common["n"], [by_dim[i] for i in range(dims)])


def _centred(n: int, sums: list[int]) -> Callable[[pa.Array], np.ndarray]:
    """Vectors less their mean: the mean's whole part goes first, without rounding."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    return lambda column: (_whole(column, len(sums)) - whole).astype(np.float64) - rest


def _sum_over(fit: Fit, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of `part` of the centred vectors."""
    size, centre = int(np.prod(shape)), _centred(fit.n, fit.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(centre(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.reshape(-1))], names=["i", "v"])

    sums = fit.rows.select("x").mapInArrow(add, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[sums["i"].to_numpy()] = sums["v"].to_numpy()
    return out.reshape(shape)


def covariance_product(fit: Fit) -> Product:
    return lambda v: _sum_over(fit, lambda c: c.T @ (c @ v), v.shape) / fit.n


class Whitening(NamedTuple):
    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(vectors: DataFrame, column: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> Whitening:
    fit = fit_list(vectors, column, keep or [])
    dims = len(fit.sums)
    trace = float(_sum_over(fit, lambda c: np.array([(c * c).sum()]), (1,))[0] / fit.n) if fit.n else 0.0
    if trace == 0:
        return Whitening(fit, np.zeros(0), np.zeros((dims, 0)), trace, 0.0)
    values, directions = jacobi_davidson(covariance_product(fit), dims, components)
    varied = values > RESIDUAL * dims * values[0]
    values, directions = values[varied], directions[:, varied]
    k, scaled = len(values), directions / np.sqrt(values)
    mean = _sum_over(fit, lambda c: (c @ scaled).sum(axis=0), (k,)) / fit.n

    def spread(c: np.ndarray) -> np.ndarray:
        z = c @ scaled - mean
        return z.T @ z

    error = np.abs(_sum_over(fit, spread, (k, k)) / fit.n - np.eye(k)).max()
    return Whitening(fit, values, directions, trace, float(error))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums over dimensions of (n * x - S)^2, exact."""
    roughly = ((n * x.astype(np.float64) - np.array(sums, dtype=np.float64)) ** 2).sum(axis=1)
    # Rounding of `roughly` is far below the margin to 2^63; each entry is then below 2^32.
    if n * float(np.abs(x).max(initial=0)) < 2.0**62 and roughly.max(initial=0.0) < 2.0**62:
        gaps = n * x - np.array(sums, dtype=np.int64)
        return pa.array((gaps * gaps).sum(axis=1), pa.int64())
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def whitened(model: Whitening) -> DataFrame:
    """row, component (from 1), n, deviation, whitened, explained and identity_error of each vector of the fit list."""
    fit, k = model.fit, len(model.values)
    n, sums, error = fit.n, fit.sums, model.identity_error
    schema = T.StructType([fit.rows.schema["row"]] + T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double").fields)
    if not k:
        return fit.rows.sparkSession.createDataFrame([], schema)
    centre, scaled, share = _centred(n, sums), model.vectors / np.sqrt(model.values), model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = len(batch), _whole(batch.column(1), len(sums))
            at = pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column(0).take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, dtype=np.int64)),
                _deviations(x, n, sums).take(at),
                pa.array((centre(batch.column(1)) @ scaled).reshape(-1)),
                pa.array(np.tile(share, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return fit.rows.select("row", "x").mapInArrow(project, schema)


@query("op13_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(fit_whitening(table(spark, sf_dir, "embeddings"), keep=["vec_id"]))
    return rows.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
