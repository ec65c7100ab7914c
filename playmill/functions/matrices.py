"""Small symmetric matrices as arrays of doubles, row by row, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def eigen(matrix: Column, k: int, sweeps: int = 12) -> Column:
    """(values, vectors) of a symmetric k x k matrix by cyclic Jacobi rotations; vector j is column j of ``vectors``.

    Each rotation is one step of an aggregate over the pairs of all sweeps.  Convergence is quadratic: a dozen sweeps
    reach double precision for k up to some dozens.  The order of the values is that of the diagonal.
    """
    cells = F.sequence(F.lit(0), F.lit(k * k - 1))
    row = lambda x: F.floor(x / k).cast("int")
    col = lambda x: x % k
    at = lambda m, i, j: F.get(m, i * k + j)

    def rotated(held: Column, pair: Column) -> Column:
        p, q = pair["p"], pair["q"]
        off = at(held["a"], p, q)
        theta = (at(held["a"], q, q) - at(held["a"], p, p)) / (off * 2)
        tangent = F.when(off == 0, 0.0).otherwise(F.when(theta < 0, -1.0).otherwise(1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))

        def turn(t: Column) -> Column:
            cosine = F.lit(1.0) / F.sqrt(t * t + 1)
            return _let(F.struct(cosine.alias("c"), (t * cosine).alias("s")), lambda r: _let(F.struct(right(held["a"], r).alias("a"), right(held["v"], r).alias("v")), lambda b: F.struct(left(b["a"], r).alias("a"), b["v"].alias("v"))))

        def right(m: Column, r: Column) -> Column:
            first = lambda x: r["c"] * at(m, row(x), p) - r["s"] * at(m, row(x), q)
            second = lambda x: r["s"] * at(m, row(x), p) + r["c"] * at(m, row(x), q)
            return F.transform(cells, lambda x: F.when(col(x) == p, first(x)).when(col(x) == q, second(x)).otherwise(F.get(m, x)))

        def left(m: Column, r: Column) -> Column:
            first = lambda x: r["c"] * at(m, p, col(x)) - r["s"] * at(m, q, col(x))
            second = lambda x: r["s"] * at(m, p, col(x)) + r["c"] * at(m, q, col(x))
            return F.transform(cells, lambda x: F.when(row(x) == p, first(x)).when(row(x) == q, second(x)).otherwise(F.get(m, x)))

        return _let(tangent, turn)

    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(k) for q in range(p + 1, k)]) if k > 1 else F.expr("cast(array() as array<struct<p:int,q:int>>)")
    unit = F.array(*[F.lit(float(i == j)) for i in range(k) for j in range(k)])
    done = F.aggregate(F.flatten(F.array_repeat(pairs, sweeps)), F.struct(matrix.alias("a"), unit.alias("v")), rotated)
    return _let(done, lambda d: F.struct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: at(d["a"], i, i)).alias("values"), d["v"].alias("vectors")))


def top_component(matrix: Column, k: int) -> Column:
    """The unit eigenvector of the largest eigenvalue, its entry of largest size positive."""

    def leading(found: Column) -> Column:
        place = (F.array_position(found["values"], F.array_max(found["values"])) - 1).cast("int")
        vector = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(found["vectors"], i * k + place))
        return _let(vector, lambda v: F.transform(v, lambda x: x * F.when(F.array_max(v) >= -F.array_min(v), 1.0).otherwise(-1.0)))

    return _let(eigen(matrix, k), leading)
