"""Operator 12: whitening of embeddings by a randomised range finder and Rayleigh-Ritz.

Entries become integers, x = floor(64 c) + 1,000,000.  The fit list has every distinct x-vector once.  A random
orthonormal basis of the wanted number of directions and some more is multiplied by the covariance of all centred rows
of the list, in one pass over it, and made orthonormal again; Rayleigh-Ritz on the small projected matrix gives
eigenpairs and their residuals.  If residuals are still above the tolerance after ``passes`` such passes, as they are
for spectra without a gap, the basis is filled up to the full dimension, where one more pass leaves rounding errors only.
A task holds one batch of rows and a matrix of dimension times directions; one such matrix a task reaches the sum.

Cases: rows with a null or empty vector, or one that holds null or non-finite entries, are dropped, as are vectors of
another length than the commonest (the shorter on a tie); a null vec_id is kept; repeated rows get rows of their own and
count once in the fit; extra columns are not read, whatever their names; x is held within 2^53 either way; a deviation
that no long can hold is null; directions without variance (below rounding) are no components, so one row, or equal rows,
give no rows, like an empty table; of equal eigenvalues any orthonormal eigenvectors are components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import materialize
from playmill.llm.vectors import matrix

LIMIT = 2**53


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x): rows that take part, with their entries as longs."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vec_col), lambda c: c.cast("double")).alias("c")).where("c is not null and size(c) > 0")
    rows = rows.where(~F.coalesce(F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True)))
    lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("c") == (lengths["d"] if lengths else 0))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long") + F.lit(shift)
    return rows.select("vec_id", F.transform("c", whole).alias("x"))


def summed(rows: DataFrame, make: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """Sum over all batches of x-vectors of the flat array that ``make`` gives for one, each task adding its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                one = make(matrix(batch.column(0).slice(at, 4096), np.int64))
                held = one if held is None else held + one
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(held)], names=["i", "v"])

    found = rows.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = [0] * len(found)
    for r in found:
        out[r["i"]] = r["v"]
    return out


@dataclass(frozen=True)
class Whitening:
    """What the fit found; ``components`` has a unit eigenvector in each column, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int
    directions: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; the whole part of the mean is taken off as integers."""
        return _centred(x, *_means(self.n, self.sums))


def _means(n: int, sums) -> tuple[np.ndarray, np.ndarray]:
    whole = [s // n for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest


def fit_whitening(vectors: DataFrame, components: int = 16, oversample: int = 8, passes: int = 4, tolerance: float = 1e-13, seed: int = 7) -> Whitening | None:
    """Eigenpairs of the covariance of the distinct x-vectors; None where no row is left.  ``tolerance`` is relative to the largest eigenvalue."""
    distinct = materialize(vectors.select("x").distinct(), "fit-list")
    n = distinct.count()
    if not n:
        return None
    # sums of longs that may be near 2^53 are kept exact in two parts of 26 bits and more
    both = summed(distinct, lambda x: np.concatenate([(x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)]), "long")
    d = len(both) // 2
    sums = tuple((h << 26) + low for h, low in zip(both[:d], both[d:]))
    means = _means(n, sums)

    def multiplied(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times ``basis``, and its trace."""

        def make(x: np.ndarray) -> np.ndarray:
            c = _centred(x, *means)
            return np.append((c.T @ (c @ basis)).ravel(), (c * c).sum())

        flat = np.array(summed(distinct, make, "double"))
        return flat[:-1].reshape(basis.shape) / n, flat[-1] / n

    rng, done = np.random.default_rng(seed), 0
    wanted = min(components, d)
    basis = np.linalg.qr(rng.standard_normal((d, min(d, components + oversample))))[0]
    while True:
        image, trace = multiplied(basis)
        done += 1
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        ritz = basis @ inner
        residual = np.linalg.norm(image @ inner[:, :wanted] - ritz[:, :wanted] * values[:wanted], axis=0)
        if basis.shape[1] == d or residual.max() <= tolerance * max(values[0], 0.0):
            break
        if done < passes:
            basis = np.linalg.qr(image)[0]
        else:
            basis = np.linalg.qr(np.concatenate([ritz, rng.standard_normal((d, d - ritz.shape[1]))], axis=1))[0]
    held = int((values[:wanted] > max(d, 1) * np.finfo(float).eps * max(trace, 0.0)).sum())
    axes, values = ritz[:, :held], values[:held]
    scaled = axes / np.sqrt(values)

    def products(x: np.ndarray) -> np.ndarray:
        w = _centred(x, *means) @ scaled
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    error = 0.0
    if held:
        flat = np.array(summed(distinct, products, "double")) / n
        error = float(np.abs(flat[: held * held].reshape(held, held) - np.outer(flat[held * held :], flat[held * held :]) - np.eye(held)).max())
    return Whitening(n, sums, axes, values, float(trace), error, done, basis.shape[1])


def deviations(x: np.ndarray, n: int, sums) -> list[int | None]:
    """Of each row the sum over dimensions of (n x - S)^2, exact; None where no long holds it."""
    whole = [s // n for s in sums]
    rest = [s - w * n for s, w in zip(sums, whole)]
    off = x - np.array(whole, dtype=np.int64)
    widest = n * (int(np.abs(off).max(initial=0)) + 1)
    if len(whole) * widest * widest < 2**63:
        far = off * n - np.array(rest, dtype=np.int64)
        return (far * far).sum(axis=1).tolist()
    exact = ((off.astype(object) * n - np.array(rest, dtype=object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of (vec_id, x) and component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    scaled, k = model.components / np.sqrt(model.eigenvalues), len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, rows = matrix(part.column(1), np.int64), np.repeat(np.arange(part.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(rows), model.n, dtype=np.int64)),
                        pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(rows)),
                        pa.array((model.centred(x) @ scaled).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(rows), model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten_embeddings(df: DataFrame, components: int = 16, **options) -> DataFrame:
    """``whiten`` with a model fitted to the rows themselves; ``options`` go to ``fit_whitening``."""
    vectors = integer_vectors(df)
    model = fit_whitening(vectors, components, **options)
    if model is None:
        model = Whitening(1, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0, 0)
        vectors = vectors.limit(0)
    return whiten(vectors, model)
