"""Whitening of embeddings by a Jacobi-Davidson method on the matrix-free covariance.

The covariance is never formed. A product with a block of vectors is one pass over the
stored fit list: every task centres its rows, sums rows' (row . block) and sends one
row per dimension; the sums meet by dimension. Rayleigh-Ritz in a small subspace gives
the leading pairs; for those not yet converged the projected correction equations

    (I - UU') (V - theta I) (I - UU') t = -r

are solved by some steps of MINRES, all columns sharing each product, and extend the
subspace. Converged pairs are locked: they stay in the projector and in the subspace, but
cost no further correction. It ends when all residuals, taken from a fresh
product, are at double precision.

The driver holds dims x (a few times the components) numbers, whatever the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm.common import table
from reviewmill.session import materialize

SCALE, OFFSET = 64, 1_000_000
CHUNK = 8_192  # rows centred and multiplied at once
GUARD = 4  # pairs beyond the wanted ones that are iterated along
INNER = 8  # MINRES steps of one correction
SUBSPACE = 4  # the subspace restarts beyond so many blocks
RANK = 1e-12  # a smaller share of the largest eigenvalue is no variance
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

Product = Callable[[np.ndarray], np.ndarray]


def integer_vector(vector: str, dims: int) -> Column:
    """x = floor(64 c) + 1000000 of every entry as double; missing last entries count as zero."""
    made = F.transform(F.col(f"`{vector}`"), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return F.concat(made, F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(dims) - F.size(made)))


def usable(vector: str) -> Column:
    """Not null, not empty, no null and no non-finite entry."""
    value = F.col(f"`{vector}`")
    finite = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(value.isNotNull() & (F.size(value) > 0) & finite, F.lit(False))


def _centred(batch: pa.RecordBatch, centre: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
    """x - S/n in double precision: whole part first, exactly, then the rest below one."""
    whole, rest = centre
    flat = np.asarray(batch.column("x").flatten())
    x = flat.reshape(-1, len(whole))
    for at in range(0, len(x), CHUNK):
        yield (x[at : at + CHUNK] - whole).astype(np.float64) - rest


def _summed(fit: DataFrame, centre: tuple[np.ndarray, np.ndarray], measure: Callable[[np.ndarray], np.ndarray], rows: int, cols: int) -> np.ndarray:
    """Sum over all chunks of ``measure(centred rows)``, a rows x cols matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, cols))
        for batch in batches:
            for centred in _centred(batch, centre):
                total += measure(centred)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), *[pa.array(total[:, j]) for j in range(cols)]], ["line", *[f"c{j}" for j in range(cols)]])

    schema = "line int, " + ", ".join(f"c{j} double" for j in range(cols))
    parts = fit.select("x").mapInArrow(partial, schema)
    out = np.zeros((rows, cols))
    for row in parts.groupBy("line").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(cols)]).collect():  # rows x cols numbers
        out[row[0]] = row[1:]
    return out


def minres(product: Product, right: np.ndarray, steps: int, drop: float) -> np.ndarray:
    """Column by column x with product(x) = right for a symmetric product, all columns sharing each call.

    Ends after ``steps``, or once every residual is under ``drop`` of its start.
    """
    start = np.linalg.norm(right, axis=0)
    beta, eta = start.copy(), start.copy()
    v_old, v = np.zeros_like(right), right / np.where(beta > 0, beta, 1)
    x, w_old, w = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c_old = c = np.ones(len(start))
    s_old = s = np.zeros(len(start))
    beta = np.zeros(len(start))
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta, above = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta
        length = np.hypot(delta, after)
        going = (length > 0) & (np.abs(eta) > drop * start)
        safe = np.where(length > 0, length, 1)
        w_old, w = w, (v - s_old * beta * w_old - above * w) / safe
        c_old, c, s_old, s = c, delta / safe, s, after / safe
        x = x + np.where(going, c * eta, 0) * w
        eta = np.where(going, -s * eta, 0)
        v_old, v, beta = v, p / np.where(after > 0, after, 1), after
        if (np.abs(eta) <= drop * start).all():
            break
    return x


def _ritz(basis: np.ndarray, image: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n largest Ritz values in the span of ``basis``, their vectors and images."""
    inner = basis.T @ image
    value, turn = np.linalg.eigh((inner + inner.T) / 2)
    turn = turn[:, ::-1][:, :n]
    return value[::-1][:n], basis @ turn, image @ turn


def leading_pairs(product: Product, dims: int, wanted: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenvalues, residuals at double precision.

    Where residuals no longer fall, those under 1e-12 of the largest value are accepted, since rounding in
    the distributed sums may stop them short of dims * eps.
    """
    wanted = min(wanted, dims)
    block = min(dims, wanted + GUARD)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, block)))[0]
    image, fresh, best, idle = product(basis), True, np.inf, 0
    while True:
        value, vector, moved = _ritz(basis, image, block)
        residual = moved - vector * value
        size = np.linalg.norm(residual, axis=0)[:wanted]
        scale = max(abs(value[0]), np.finfo(float).tiny)
        worst = size.max() / scale
        idle = idle + 1 if worst > best / 2 else 0
        best = min(best, worst)
        done = worst <= dims * np.finfo(float).eps or (idle >= 2 and worst <= 1e-12)
        if done and fresh:
            return value[:wanted], vector[:, :wanted]
        if done or basis.shape[1] == dims:
            # A subspace of all dimensions holds every pair; what is left is the rounding of older products.
            basis = np.linalg.qr(vector)[0] if done else np.linalg.qr(basis)[0]
            image, fresh = product(basis), True
            if not done:
                idle += 1
            if idle > 20:
                raise ArithmeticError(f"residuals stay at {worst} of the largest eigenvalue")
            continue
        open_ = np.flatnonzero(size > dims * np.finfo(float).eps * scale)
        outside = lambda y: y - vector @ (vector.T @ y)
        shift = value[open_]
        step = minres(lambda y: outside(product(y := outside(y)) - y * shift), -outside(residual[:, open_]), INNER, 0.02)
        if basis.shape[1] + len(open_) > SUBSPACE * block:
            basis, image = vector, moved
        for _ in range(2):
            step = step - basis @ (basis.T @ step)
        left, length, _ = np.linalg.svd(step, full_matrices=False)
        step = left[:, length > 1e-10 * max(length[0], np.finfo(float).tiny)][:, : dims - basis.shape[1]]
        step = np.linalg.qr(step - basis @ (basis.T @ step))[0]
        basis, image, fresh = np.hstack([basis, step]), np.hstack([image, product(step)]), False


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out. Vectors
    shorter than the longest one count as ending in zeros. Repeated rows stay rows, and count once
    in the fit; null ids are kept. A direction without variance (an eigenvalue under 1e-12 of
    the largest) is no component, so equal vectors only, one row or an empty table give no rows. Of equal
    eigenvalues any orthonormal vectors stand. Other columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    chosen = rows.filter(usable(vector_col)).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    dims = chosen.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], OUT)
    ready = chosen.select("vec_id", integer_vector("vector", dims).alias("x"))
    fit = materialize(ready.select("x").distinct(), "fit_list")
    n = fit.count()
    sums = [0] * dims
    for at, total in fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)"))).collect():  # a row per dimension
        sums[at] = int(total)
    centre = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n / n for s in sums])

    trace = float(_summed(fit, centre, lambda y: np.array([[(y * y).sum()]]), 1, 1)[0, 0]) / n
    if trace == 0:
        return spark.createDataFrame([], OUT)
    value, vector = leading_pairs(lambda block: _summed(fit, centre, lambda y: y.T @ (y @ block), dims, block.shape[1]) / n, dims, components)
    kept = value > RANK * value[0]
    value, vector = value[kept], vector[:, kept]
    k, turn = len(value), vector / np.sqrt(value)

    mean = _summed(fit, centre, lambda y: (y @ turn).sum(axis=0, keepdims=True), 1, k)[0] / n
    spread = lambda z: z.T @ z
    covariance = _summed(fit, centre, lambda y: spread(y @ turn - mean), k, k) / n
    identity_error = float(np.abs(covariance - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for centred in _centred(batch, centre):
                z = centred @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, len(z)) for c in ("vec_id", "deviation")] + [lists], ["vec_id", "deviation", "z"])
                at += len(z)

    total = F.array(*[F.lit(s).cast("long") for s in sums])
    apart = F.zip_with("x", total, lambda x, s: (x * F.lit(n) - s).cast("decimal(19,0)"))
    deviation = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d * d).cast("decimal(38,0)"))
    id_type = ready.schema["vec_id"].dataType.simpleString()
    out = ready.withColumn("deviation", deviation).mapInArrow(project, f"vec_id {id_type}, deviation decimal(38,0), z array<double>")
    explained = F.array(*[F.lit(float(v / trace)) for v in value])
    return out.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(identity_error).alias("identity_error"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
