"""Operator 4: approximate nearest neighbours by randomly rotated one-bit codes.

Centroids fitted on a bounded sample cut the data into about sqrt(n) lists, and every row is indexed: its offset from the
centroid is rotated at random and kept as one bit a dimension, with its length and the inner product of code and offset
as the correction scalar.  A query probes the lists of its nearest centroids; how many that are is measured on the
sample, so that at least ``aim`` of its true neighbours lie in them.  There, the rotated query is rounded to ``depth``
bits a dimension; populations of the packed codes under its bit planes and the corrections estimate all distances with
error bounds, and rows whose lower bound is at most the k-th smallest upper bound are measured exactly on the original
vectors.

Cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
part, nor do rows without an id; repeated rows count once; ties go to the smaller vec_id; fewer candidates than k give
fewer rows; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import drop_scratch, materialize, scratch_scope
from playmill.llm.vectors import best, blocked, choose, classes_of, matrix, usable_vectors


def _order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, but for the row's own square."""
    return (centres**2).sum(1) - 2 * x @ centres.T


def _centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from the first rows of a sample in hash order."""
    c = sample[:lists].copy()
    for _ in range(rounds):
        near = _order(sample, c).argmin(axis=1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def choose_probes(sample: np.ndarray, centres: np.ndarray, k: int, aim: float, asked: int = 256) -> int:
    """The least number of probes whose lists hold ``aim`` of the k nearest sample rows of the last ``asked`` rows.

    In the whole data neighbours are nearer than in the sample, so this errs on the safe side.
    """
    q = sample[-asked:]
    cell, rank_of = _order(sample, centres).argmin(axis=1), np.empty((len(q), len(centres)), dtype=int)
    np.put_along_axis(rank_of, np.argsort(_order(q, centres), axis=1), np.arange(len(centres))[None, :], axis=1)
    square = (sample**2).sum(1) - 2 * q @ sample.T
    square[np.arange(len(q)), np.arange(len(sample) - len(q), len(sample))] = np.inf
    take = min(k, len(sample) - 1)
    if take < 1:
        return len(centres)
    near = np.argpartition(square, take - 1, axis=1)[:, :take]
    needed = np.sort(np.take_along_axis(rank_of, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))) - 1)]) + 1


def bit_planes(turned: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes, low, step): rows rounded to whole steps above their smallest component, as ``depth`` packed bit planes."""
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**depth - 1), 1e-30)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint32)
    return np.stack([packed(level >> b & 1) for b in range(depth)], axis=1), low, step


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def inner_products(codes: np.ndarray, ones: np.ndarray, planes: np.ndarray, low: float, step: float, dims: int) -> np.ndarray:
    """Inner products of codes (bit 1 for +1, 0 for -1, times 1 / sqrt(dims)) with one rounded query.

    With u the query's levels, sum(sign * (low + step * u)) = 2 * (low * ones + step * sum over the code's ones of u) -
    low * dims - step * sum(u); the sums over ones are populations under the bit planes.
    """
    under = np.zeros(len(codes))
    for b, plane in enumerate(planes):
        under += float(1 << b) * np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64)
    total = sum(float(1 << b) * int(np.bitwise_count(plane).sum()) for b, plane in enumerate(planes))
    return (2 * (low * ones + step * under) - low * dims - step * total) / np.sqrt(dims)


def one_bit_neighbours(vectors: DataFrame, k: int, every: int, aim: float = 0.95, max_lists: int = 1024, rows_a_list: int = 32, confidence: float = 2.5, depth: int = 6, query_rows: int = 1024, data_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with vec_id divisible by ``every``; score is the Euclidean distance.

    ``confidence`` is the number of standard deviations the bounds of an estimate are apart from it.  The sample has at
    most ``max_lists * rows_a_list`` rows.  ``report`` gets the numbers of lists and probes.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, id_col, vec_col, lambda x: x, zero=False)
    with scratch_scope() as done:
        classes = materialize(classes_of(rows, k + 1), "classes")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    query_ids = materialize(asked.join(classes.select("vec", F.col("class_id").alias("query_class")), "vec"), "queries")
    lists = int(min(max_lists, max(8, round(np.sqrt(classes.count())))))
    picked = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(lists * rows_a_list).select("vec").toArrow()
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix(picked.column("vec"))
    centres = _centroids(sample, min(lists, len(sample)))
    probes = choose_probes(sample, centres, k, aim)
    if report is not None:
        report.update(lists=len(centres), probes=probes)
    dims = centres.shape[1]
    turn = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))[0]
    root = np.sqrt(dims)

    def index(batches):
        for b in batches:
            x = matrix(b.column("vec"))
            cell = _order(x, centres).argmin(axis=1)
            off = x - centres[cell]
            length = np.sqrt((off**2).sum(axis=1))
            turned = off @ turn / np.where(length > 0, length, 1)[:, None]
            fit = np.where(length > 0, np.abs(turned).sum(axis=1) / root, 1.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec"), b.column("ids"), b.column("class_id"), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in packed(turned >= 0)], pa.binary()), pa.array(length), pa.array(fit)],
                ["vec", "ids", "class_id", "cell", "bits", "length", "fit"],
            )

    def probe(batches):
        for b in batches:
            order = np.argsort(_order(matrix(b.column("vec")), centres), axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("vec").take(at), b.column("class_id").take(at), pa.array(order.ravel().astype(np.int32))], ["vec", "class_id", "cell"])

    indexed = materialize(classes.select("vec", "ids", "class_id").mapInArrow(index, "vec array<double>, ids array<long>, class_id long, cell int, bits binary, length double, fit double"), "index")
    asking = query_ids.select("vec", F.col("query_class").alias("class_id")).dropDuplicates(["class_id"])
    probing = materialize(asking.mapInArrow(probe, "vec array<double>, class_id long, cell int"), "probes")
    drop_scratch(spark, done)
    left, right = blocked(probing, indexed, query_rows, data_rows)

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        names_out, found, scores = [], [], []
        if q.num_rows and x.num_rows:
            centre = centres[q.column("cell")[0].as_py()]
            data, ids = matrix(x.column("vec")), x.column("ids").to_pylist()
            codes = np.frombuffer(b"".join(x.column("bits").to_pylist()), dtype=np.uint64).reshape(len(data), -1)
            ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
            length, fit = x.column("length").to_numpy(), x.column("fit").to_numpy()
            names, asked_for = q.column("class_id").to_pylist(), matrix(q.column("vec"))
            off = asked_for - centre
            far = np.sqrt((off**2).sum(axis=1))
            planes, low_of, step_of = bit_planes(off @ turn / np.where(far > 0, far, 1)[:, None], depth)
            deviation = np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(1, dims - 1))
            for i, name in enumerate(names):
                cosine = inner_products(codes, ones, planes[i], low_of[i], step_of[i], dims) / fit
                # rounding moves each component by half a step at most, evenly
                spread = confidence * np.sqrt(deviation**2 + step_of[i] ** 2 / 12 / fit**2)
                square, twice = length**2 + far[i] ** 2, 2 * length * far[i]
                low, high = square - twice * np.minimum(cosine + spread, 1), square - twice * np.maximum(cosine - spread, -1)
                limit = np.partition(high, k)[k] if len(high) > k + 1 else np.inf
                near = np.flatnonzero(low <= limit + 1e-9)
                exact = np.sqrt(((data[near] - asked_for[i]) ** 2).sum(axis=1))
                got, score = choose(exact, [ids[j] for j in near], k + 1, False)
                names_out += [name] * len(got)
                found += got
                scores += [float(s) for s in score]
        return pa.table({"query_class": pa.array(names_out, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    keys = ["cell", "block", "chunk"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "query_class long, vec_id long, score double")
    return best(hits, query_ids.select("query_id", "query_class"), k, False)
