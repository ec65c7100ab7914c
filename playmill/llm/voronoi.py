"""Operator 2: exact top-k search by inner product as a Voronoi kNN join.

Equal vectors form one class.  Pivots, a bounded sample of the data, cut the space into cells; queries and data go to the
cell of their nearest pivot.  A first pass solves each query against the data of its own cell (and a bounded sample of
all data), which gives it a score that at least k + 1 rows reach.  From summaries of the query cells, with p the pivot of
the query cell, c that of the data cell, t the score a query has reached and R the largest |q - p|, a data vector x can
only serve a query q of a cell if one of these may exceed 0, and is sent there only then:

    p.x + R |x| - min t
    max(q.c - t) + max|q| |x - c|
    p.x + max((q - p).c - t) + R |x - c|

A second pass solves the query cells against what was sent to them.  How many pivots are taken is decided on the sample:
each candidate number is charged with the rows it would send and the products it would take.  Where the data has no
clusters and many dimensions no bound holds much back, and few pivots are cheapest.

Cases: vectors that are null, empty, of another length than most, or hold null or non-finite components take no part,
nor do rows without an id; repeated rows count once; ties go to the smaller vec_id; fewer candidates than k give fewer
rows; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.llm.common import drop_scratch, materialize, scratch_scope
from playmill.llm.vectors import best, blocked, choose, classes_of, matrix, usable_vectors

CANDIDATES = (4, 16, 64, 256)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest pivot of each row, and the distance to it."""
    square = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
    cell = square.argmin(axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where they stay below 2^53, else in 64-bit integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1] if q.ndim > 1 else 1) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


@dataclass
class CellBounds:
    """Summaries of the query cells that hold queries; all arrays have a row for each."""

    cells: np.ndarray  # numbers of their pivots
    least: np.ndarray  # smallest reached score
    reach: np.ndarray  # largest distance of a query from its pivot
    length: np.ndarray  # largest norm of a query
    gap: np.ndarray  # x data cell: max of q.c - t
    shift: np.ndarray  # x data cell: max of (q - p).c - t

    @classmethod
    def of(cls, q: np.ndarray, cell: np.ndarray, reached: np.ndarray, pivots: np.ndarray) -> CellBounds:
        """The summaries of queries with their cells and reached scores."""
        cells = np.unique(cell)
        rows = []
        for c in cells:
            own, t = q[cell == c], reached[cell == c]
            products = own @ pivots.T - t[:, None]
            rows.append((t.min(), np.sqrt(((own - pivots[c]) ** 2).sum(1)).max(), np.sqrt((own**2).sum(1)).max(), products.max(0), (products - pivots[c] @ pivots.T).max(0)))
        least, reach, length, gap, shift = ([r[i] for r in rows] for i in range(5))
        return cls(cells, np.array(least), np.array(reach), np.array(length), np.array(gap).reshape(len(cells), -1), np.array(shift).reshape(len(cells), -1))

    def wanted(self, x: np.ndarray, cell: np.ndarray, off: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Data rows x query cells: whether the row may serve a query there."""
        norm = np.sqrt((x**2).sum(1))[:, None]
        across = x @ pivots[self.cells].T
        slack = 1e-9 * (1.0 + norm * (self.length + np.abs(pivots).max(initial=0) * x.shape[1]))
        ok = across + self.reach * norm - self.least >= -slack
        ok &= self.gap[:, cell].T + off[:, None] * self.length >= -slack
        return ok & (across + self.shift[:, cell].T + off[:, None] * self.reach >= -slack)


def choose_pivots(sample: np.ndarray, queries: np.ndarray, n_queries: int, k: int, query_rows: int, most: int) -> np.ndarray:
    """The first rows of ``sample``, as many as are cheapest: a row sent costs as much as 400 products."""
    reached = np.array([np.partition(s, len(s) - 1 - k)[len(s) - 1 - k] if len(s) > k else -np.inf for s in (queries @ sample.T).astype(float)])
    best_cost, best_pivots = np.inf, sample[: min(CANDIDATES[0], most)]
    for n in CANDIDATES:
        if n > most or n > len(sample) or (n > CANDIDATES[0] and n * 4 > n_queries):
            break
        pivots = sample[:n]
        cell, _ = _nearest(queries, pivots)
        bounds = CellBounds.of(queries, cell, reached, pivots)
        at, off = _nearest(sample, pivots)
        share = bounds.wanted(sample, at, off, pivots).mean(axis=0)
        held = np.array([(cell == c).mean() * n_queries for c in bounds.cells])
        cost = float((share * (np.ceil(held / query_rows) + held / 400)).sum())
        if cost < 0.9 * best_cost:
            best_cost, best_pivots = cost, pivots
    return best_pivots


def voronoi_top_k(vectors: DataFrame, k: int, every: int, scale: int = 256, max_pivots: int = 256, sample_rows: int = 4096, query_rows: int = 4096, data_rows: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with vec_id divisible by ``every``; components are floor(scale * x).

    ``report`` gets the number of pivots, of data classes, and of data rows sent to another cell than their own.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, id_col, vec_col, lambda x: F.floor(F.lit(float(scale)) * x), zero=True)
    with scratch_scope() as done:
        classes = materialize(classes_of(rows, k + 1), "classes")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    query_ids = materialize(asked.join(classes.select("vec", F.col("class_id").alias("query_class")), "vec"), "queries")
    queries = query_ids.select("vec", F.col("query_class").alias("class_id")).dropDuplicates(["class_id"])
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # samples bounded by sample_rows
    of = lambda df, n: matrix(df.orderBy(F.xxhash64("class_id"), "class_id").limit(n).select("vec").toArrow().column("vec"))
    sample = of(classes, sample_rows)
    pivots = choose_pivots(sample, of(queries, sample_rows // 8), n_queries, k, query_rows, max_pivots)

    def place(batches):
        for b in batches:
            cell, off = _nearest(matrix(b.column("vec")), pivots)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(off)], [*b.schema.names, "cell", "off"])

    with scratch_scope() as cells:
        placed = materialize(queries.select("vec", "class_id").mapInArrow(place, "vec array<long>, class_id long, cell int, off double"), "placed")
        data = materialize(classes.select("vec", "ids", "class_id").mapInArrow(place, "vec array<long>, ids array<long>, class_id long, cell int, off double"), "data")
    keys = ["cell", "block", "chunk"]

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        """The k + 1 best of each query among the rows at hand, without those below the score it has reached."""
        out = {"query_class": [], "vec_id": [], "score": []}
        if q.num_rows and x.num_rows:
            data, ids, names = matrix(x.column("vec")), x.column("ids").to_pylist(), q.column("class_id").to_pylist()
            asked_for, reached = matrix(q.column("vec")), q.column("reached").to_numpy() if "reached" in q.column_names else np.full(len(names), -np.inf)
            for at in range(0, len(names), 64):
                for name, s, t in zip(names[at:], _products(asked_for[at : at + 64], data), reached[at:]):
                    some = np.flatnonzero(s >= t)
                    got, score = choose(s[some], [ids[i] for i in some] if len(some) < len(ids) else ids, k + 1, True)
                    out["query_class"] += [name] * len(got)
                    out["vec_id"] += got
                    out["score"] += [int(v) for v in score]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = blocked(left, right, query_rows, data_rows)
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(solve, "query_class long, vec_id long, score long")

    own = materialize(joined(placed.select("vec", "class_id", "cell"), data.select("vec", "ids", "class_id", "cell")), "own")
    # k + 1 rows of the own cell, or of the sample, reach this score
    in_cell = own.groupBy("query_class").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.col("n") > k).select("query_class", F.element_at("s", k + 1).alias("t"))

    def sampled(batches):
        for b in batches:
            s = matrix(b.column("vec")) @ sample.T
            least = np.partition(s, s.shape[1] - 1 - k, axis=1)[:, s.shape[1] - 1 - k] if s.shape[1] > k else np.full(len(s), -np.inf)
            t = np.fmax(least, b.column("t").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("vec"), b.column("class_id"), b.column("cell"), pa.array(t)], ["vec", "class_id", "cell", "reached"])

    known = placed.join(in_cell, placed.class_id == in_cell.query_class, "left").select("vec", "class_id", "cell", "t")
    known = materialize(known.mapInArrow(sampled, "vec array<long>, class_id long, cell int, reached double"), "known")

    def summarise(batches):
        for b in batches:
            s = CellBounds.of(matrix(b.column("vec")), b.column("cell").to_numpy(), b.column("reached").to_numpy(), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(s.cells.astype(np.int32)), pa.array(s.least), pa.array(s.reach), pa.array(s.length), pa.array(list(s.gap)), pa.array(list(s.shift))], ["cell", "least", "reach", "length", "gap", "shift"])

    parts = known.mapInArrow(summarise, "cell int, least double, reach double, length double, gap array<double>, shift array<double>")
    figures = parts.groupBy("cell").agg(F.min("least").alias("least"), F.max("reach").alias("reach"), F.max("length").alias("length")).orderBy("cell").toArrow()
    pairs = parts.select("cell", F.posexplode(F.arrays_zip("gap", "shift")).alias("pos", "z")).groupBy("cell", "pos").agg(F.max("z.gap").alias("gap"), F.max("z.shift").alias("shift"))
    pairs = pairs.orderBy("cell", "pos").toArrow()  # at most max_pivots x max_pivots rows
    of_pairs = lambda c: pairs.column(c).to_numpy().reshape(figures.num_rows, -1)
    bounds = CellBounds(figures.column("cell").to_numpy(), *[figures.column(c).to_numpy() for c in ("least", "reach", "length")], of_pairs("gap"), of_pairs("shift"))

    def replicate(batches):
        for b in batches:
            x, cell = matrix(b.column("vec")), b.column("cell").to_numpy()
            wanted = bounds.wanted(x, cell, b.column("off").to_numpy(), pivots) & (bounds.cells != cell[:, None])
            row, to = np.nonzero(wanted)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("vec").take(at), b.column("ids").take(at), b.column("class_id").take(at), pa.array(bounds.cells[to].astype(np.int32))], ["vec", "ids", "class_id", "cell"])

    sent = materialize(data.mapInArrow(replicate, "vec array<long>, ids array<long>, class_id long, cell int"), "sent")
    if report is not None:
        report.update(pivots=len(pivots), classes=classes.count(), sent=sent.count())
    drop_scratch(spark, done + cells)
    found = own.unionByName(joined(known, sent))
    return best(found, query_ids.select("query_id", "query_class"), k, True)
