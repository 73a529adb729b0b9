"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become integers, so that equal vectors are told exactly and sums are
exact. The covariance is never formed: a block Q of a few columns goes out to
the tasks and each pass gives XᵀXQ of the centred vectors, as sums per task
that Spark adds up. A polynomial of the covariance, applied by the three-term
Chebyshev recurrence (one pass a degree), damps the part of the spectrum below
the block's smallest Ritz value; QR and Rayleigh-Ritz (one pass) follow. That
repeats until the residuals of the wanted components certify them: they are at
rounding level, or don't get smaller any more and are below ``SURE`` of the
largest eigenvalue. If the spectrum is too flat for that, the block grows; one
as wide as the space is exact.

The driver holds blocks of dimensions x columns, never vectors. A pass reads
the list of distinct vectors, written once, column by column.

Defined results: vectors that are null, empty, hold null or a non-finite entry
are dropped, and so are those whose length isn't the commonest (of equally
common ones the longest); entries beyond 64 bits saturate; a component whose
eigenvalue is 0 (to rounding) isn't returned, so identical vectors or a single
one give no rows; a deviation beyond 64 bits is null; rows with a null or
repeated id are returned each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import scratch, written

SCALE = 256
#: Extra columns of the block, which speed up convergence.
EXTRA = 20
#: Residuals over the largest eigenvalue: at rounding level, and what is enough where they stagnate.
ROUNDING, SURE = 3e-15, 1e-11
#: Rounds before the block doubles, and the highest degree of a round.
ROUNDS, DEGREE = 12, 16
#: How much more a round may amplify the first component than the last wanted one; beyond, QR would lose the latter.
SPREAD = 1e6
#: Eigenvalues below this part of the largest count as 0.
NOTHING = 1e-12

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, x): the usable vectors with entries floor(SCALE * c) as longs."""
    doubles = F.transform(vector_col, lambda c: c.cast("double"))
    usable = F.coalesce((F.size(vector_col) > 0) & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    return rows.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(doubles, lambda c: F.floor(c * float(SCALE))).alias("x"))


@dataclass(frozen=True)
class Whitening:
    """A fitted basis: ``basis`` has a unit eigenvector a column, ``values`` their eigenvalues, falling."""

    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, one a row; all have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _added(vectors: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all vectors of ``of(matrix)``, ``size`` doubles: added up in each task, then by slot."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["slot", "v"])

    out = np.zeros(size)
    for slot, v in vectors.select("x").mapInArrow(run, "slot int, v double").groupBy("slot").agg(F.sum("v")).collect():  # a row an entry of the block
        out[slot] = v
    return out


def _sums(vectors: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """How many vectors there are and their exact sums; halves of 32 bits keep a task's sums within 64."""

    def run(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], ["slot", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    rows = vectors.select("x").mapInArrow(run, "slot int, high long, low long").groupBy("slot").agg(exact("high"), exact("low")).collect()  # a row a dimension
    found = {slot: (int(high) << 32) + int(low) for slot, high, low in rows}
    return found.get(dims, 0), tuple(found.get(i, 0) for i in range(dims))


def _filtered(apply, block: np.ndarray, below: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times ``block``, scaled to 1 at ``top``: it is small on [0, below]."""
    half = below / 2
    first = sigma = half / (top - half)
    old, new = block, (apply(block) - half * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        old, new = new, (apply(new) - half * new) * (2 * following / half) - old * (sigma * following)
        sigma = following
    return new


def _degree(wanted: float, below: float, top: float, needed: float) -> int:
    """The degree that should shrink residuals by ``needed``, within DEGREE and SPREAD."""
    rate = lambda value: np.arccosh(max(1.0, 2 * value / below - 1))
    own, most = rate(wanted), rate(top)
    best = int(np.ceil(np.log(2 * needed) / own)) if own > 0 else DEGREE
    limit = int(np.log(SPREAD) / (most - own)) if most - own > 1e-9 else DEGREE
    return max(1, min(best, limit, DEGREE))


def fit_whitening(vectors: DataFrame, components: int = 4, seed: int = 7) -> Whitening | None:
    """The leading components of the distinct vectors in column ``x`` (all of one length); None without any variance."""
    with scratch():
        fit = written(vectors.select("x").distinct(), "whitening-vectors")
        head = fit.first()
        if head is None:
            return None
        dims = len(head.x)
        n, sums = _sums(fit, dims)
        mean, passes = np.array([s / n for s in sums]), 0

        def product(block: np.ndarray) -> np.ndarray:
            nonlocal passes
            passes += 1
            width = block.shape[1]

            def of(x):
                centred = x - mean
                return (centred.T @ (centred @ block)).ravel()

            return _added(fit, dims * width, of).reshape(dims, width) / n

        trace = float(_added(fit, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
        if not trace > 0:
            return None
        random, width = np.random.default_rng(seed), min(dims, components + EXTRA)
        block, before, rounds = np.linalg.qr(random.standard_normal((dims, width)))[0], np.inf, 0
        while True:
            image = product(block)
            values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            block, image = block @ turn, image @ turn
            some = min(components, int((values > NOTHING * values[0]).sum()))
            residual = float(np.linalg.norm(image[:, :some] - block[:, :some] * values[:some], axis=0).max()) / values[0]
            if residual <= ROUNDING or (residual > before / 2 and residual <= SURE) or (width == dims and rounds >= 1):
                break
            before, rounds = residual, rounds + 1
            if rounds % ROUNDS == 0 and width < dims:
                more = min(dims, 2 * width)
                block = np.linalg.qr(np.hstack([block, random.standard_normal((dims, more - width))]))[0]
                width, before = more, np.inf
                continue
            below = float(values[-1]) if width < dims else 0.0
            if below > NOTHING * values[0]:
                block = _filtered(product, block, below, float(values[0]), _degree(float(values[some - 1]), below, float(values[0]), residual / ROUNDING))
            else:  # the block holds all of the spectrum that isn't 0
                block = image
            block = np.linalg.qr(block)[0]
        basis = block[:, :some]
        basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(some)] < 0, -1.0, 1.0)
        values = values[:some]
        white = basis / np.sqrt(values)

        def of(x):
            z = (x - mean) @ white
            return np.append(z.sum(0), (z.T @ z).ravel())

        moments = _added(fit, some + some * some, of) / n
        covariance = moments[some:].reshape(some, some) - np.outer(moments[:some], moments[:some])
        return Whitening(n, sums, basis, values, trace, float(np.abs(covariance - np.eye(some)).max()), residual, passes)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n*x - S)**2, exactly; None beyond 64 bits."""
    size = (np.abs(x.astype(np.float64)) * n + np.abs(sums.astype(np.float64))).max(initial=0.0)
    if size * size * x.shape[1] < 2.0**62:
        apart = n * x - sums.astype(np.int64)
        return (apart * apart).sum(1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each vector of (vec_id, x) and component; ``deviation`` tells how far a vector is from the mean, exactly."""
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    sums, mean, white = np.array(model.sums, dtype=object), model.mean, model.basis / np.sqrt(model.values)
    n, some, explained, error = model.n, len(model.values), model.values / model.trace, model.identity_error

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if rows:
                x = _matrix(batch.column(1))
                each = np.repeat(np.arange(rows), some)
                component = np.tile(np.arange(some), rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(each)), pa.array((component + 1).astype(np.int32)), pa.array(np.full(rows * some, n)), pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                        pa.array(((x - mean) @ white).ravel()), pa.array(explained[component]), pa.array(np.full(rows * some, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select("vec_id", "x").mapInArrow(run, OUT)


def whitened_embeddings(rows: DataFrame, components: int = 4, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Whiten a table of embeddings by its own distinct vectors."""
    vectors = integer_vectors(rows, vector_col, id_col)
    lengths = vectors.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return whiten(vectors, None)
    vectors = vectors.where(F.size("x") == lengths.dims)
    return whiten(vectors, fit_whitening(vectors, components))
