"""Jacobi rotations, exact medians of large groups and name indexes against plain versions."""

import itertools
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from playmill.functions.matrices import eigen, top_component
from playmill.operators import names, quantiles


def test_jacobi(spark):
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 6):
        made = [m + m.T for m in rng.normal(size=(8, k, k))] + [np.zeros((k, k)), np.eye(k), np.full((k, k), 1e-200), np.diag(np.arange(k) * 1e8)]
        rows = [(i, m.ravel().tolist()) for i, m in enumerate(made)]
        df = spark.createDataFrame(rows, "i int, m array<double>").select("i", eigen(F.col("m"), k).alias("e"), top_component(F.col("m"), k).alias("t"))
        for r in df.collect():
            m, v = made[r.i], np.array(r.e.vectors).reshape(k, k)
            size = max(1e-300, np.abs(m).max())
            assert np.abs(v.T @ v - np.eye(k)).max() < 1e-12
            assert np.abs(v @ np.diag(r.e["values"]) @ v.T - m).max() < 1e-12 * size
            assert abs(np.array(r.t) @ m @ np.array(r.t) - np.linalg.eigvalsh(m)[-1]) < 1e-11 * size
            assert max(r.t) >= -min(r.t)


def test_no_python_in_profiles(spark):
    from playmill.plans import registry

    from .conftest import SF

    plan = registry.QUERIES["a30_profiles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("limit", [20, 100_000])
def test_medians(spark, limit):
    rows = [("a", float(v % 500) - 250) for v in range(3001)] + [("b", 7.0)] * 2000 + [("c", None), (None, 1.0), (None, 4.0)]
    rows += [("d", 10.0**e * s) for e in range(-150, 150) for s in (1, -1)] + [("e", v / 7) for v in range(999)] + [("e", 5.0)] * 4000
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r["median"] for r in quantiles.exact_medians(df, ["k"], "v", limit, edges=8).collect()}
    want = {k: statistics.median(v for n, v in rows if n == k and v is not None) for k in ("a", "b", "d", "e", None)}
    assert got == want
    assert quantiles.exact_medians(df.where("k = 'c'"), ["k"], "v", limit).count() == 0


def test_median_of_a_million_values(spark):
    df = spark.range(1_000_001).select(F.when(F.col("id") % 2 == 0, F.col("id") * 3.0).otherwise(-F.exp(F.col("id") / 1e5)).alias("v"))
    # 500,001 values are 0 or more and 500,000 below 0, so the middle one is 0
    assert quantiles.exact_medians(df, [], "v", limit=20_000).collect()[0][0] == 0.0


def test_spread_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.spread(empty, [[]], "v").collect()[0]["median"] is None
    assert quantiles.spread(empty, [[], ["g"]], "v").count() <= 1


NAMES = ["Red Hawks", "the Red Hawks of the North", "Hawks", "RED  hawks", "North", "of the", "", None, "Blue Jays", "blue jays East", "East"]


def test_similar_names(spark):
    rng = np.random.default_rng(5)
    made = NAMES + [" ".join(rng.choice(["a1", "b1", "c1", "d1", "e1", "f1", "g1"], size=rng.integers(1, 6))) for _ in range(150)]
    sets = {n: set(n.lower().split()) - set(names.COMMON_WORDS) for n in set(made) if n is not None}
    for percent in (34, 60, 80, 100):
        got = {tuple(r) for r in names.similar(spark.createDataFrame([(n,) for n in made * 2], "n string"), "n", percent).collect()}
        want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert got == want


def test_contained(spark):
    texts, needles = [*NAMES, "banana", "bandana"], ["an", "ana", "a", "Hawks", "anab", "", None, "East", "blue jays East!", "é"]
    got = {tuple(r) for r in names.contained(spark.createDataFrame([(n,) for n in texts], "t string"), "t", spark.createDataFrame([(n,) for n in needles * 2], "n string"), "n").collect()}
    assert got == {(t, n) for t in texts for n in needles if t and n and n in t}


def test_ladder_has_no_product(spark):
    known = spark.createDataFrame([("RHK", "Red Hawks"), ("BLJ", "Blue Jays")], "code string, full string")
    left = spark.createDataFrame([(i, n) for i, n in enumerate(["RHK", "Red Hawks", "the hawks", "BLJ", "none", None])], "l int, name string")
    right = spark.createDataFrame([(0, "Red Hawks"), (1, "BLJ"), (2, None)], "r int, other string")
    df = names.ladder(left, right, "l", "r", "name", "other", known)
    assert {tuple(r) for r in df.collect()} == {(0, 0, "full"), (1, 0, "name"), (2, 0, "word"), (3, 1, "name")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
