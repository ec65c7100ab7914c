"""Exact medians of groups of any size: no task ever holds all values of a large group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmill.session import scratch_path


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def exact_medians(df: DataFrame, keys: list[str], value: str, limit: int = 100_000, edges: int = 32, weight: str | None = None) -> DataFrame:
    """(keys, median) of the known values of each group.

    Equal values of a group are counted first.  While a group has more than ``limit`` distinct values, edges that cut
    them into ``edges`` about equal parts are estimated, the rows in each part counted exactly, and only the parts that
    hold the middle rows kept: a handful of passes over a quickly shrinking rest, whatever the values.  What is left of
    a group is at most ``limit`` values and is ranked by a running sum.  Groups without a known value have no row.
    """
    if not keys:
        whole = exact_medians(df.withColumn("__one", F.lit(1)), ["__one"], value, limit, edges, weight)
        return whole.drop("__one")
    known = df.where(F.col(value).isNotNull())
    rows = known.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    rank = lambda n, up: F.floor((n - (0 if up else 1)) / 2).cast("long")
    total = F.sum("__n")
    asked = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"), rank(total, False).alias("__r1"), rank(total, True).alias("__r2"))
    if (asked.agg(F.max("__d")).first()[0] or 0) <= limit:
        return _ranked(rows, asked, keys)
    rows, asked = _kept(rows), _kept(asked)
    small = _ranked(*_part(rows, asked, keys, F.col("__d") <= limit, many=True), keys)
    rows, asked = _part(rows, asked, keys, F.col("__d") > limit)
    done = [small]
    # a plain sum of comparisons is compiled, where a filter over the array would be walked row by row
    below = reduce(lambda a, b: a + b, [(F.col("__e")[i] <= F.col("__v")).cast("int") for i in range(edges - 1)])
    while True:
        cuts = rows.groupBy(*keys).agg(F.percentile_approx("__v", [i / edges for i in range(1, edges)], 100 * edges).alias("__e"))
        placed = rows.alias("r").join(cuts.alias("c"), _same("r", "c", keys)).select("r.*", below.alias("__b"))
        sums = placed.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__d"))
        upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b"))  # no more rows than edges
        spans = sums.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__n"))
        met = spans.alias("s").join(asked.alias("a"), _same("s", "a", keys)).where("__to > __r1 and __from <= __r2")
        chosen = met.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(F.sum("s.__d").alias("__d"), F.min("__from").alias("__base"), F.first("__r1").alias("__r1"), F.first("__r2").alias("__r2"), F.min("__b").alias("__low"), F.max("__b").alias("__high"))
        narrowed = _kept(chosen.select(*keys, "__d", (F.col("__r1") - F.col("__base")).alias("__r1"), (F.col("__r2") - F.col("__base")).alias("__r2"), "__low", "__high"))
        inside = placed.alias("p").join(narrowed.alias("w"), _same("p", "w", keys)).where("__b between __low and __high")
        rows, asked = _kept(inside.select(*[f"p.{k}" for k in keys], "p.__v", "p.__n")), narrowed.drop("__low", "__high")
        done.append(_ranked(*_part(rows, asked, keys, F.col("__d") <= limit, many=True), keys))
        rows, asked = _part(rows, asked, keys, F.col("__d") > limit)
        if asked.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _kept(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, where they survive lost executors."""
    path = scratch_path(df.sparkSession, "medians")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _part(rows: DataFrame, asked: DataFrame, keys: list[str], which: Column, many: bool = False) -> tuple[DataFrame, DataFrame]:
    """The groups that fit, with their rows; ``many`` where there may be more groups than a driver can hold, none of them large."""
    wanted = asked.where(which)
    return rows.alias("r").join((wanted.hint("merge") if many else wanted).select(*keys).alias("w"), _same("r", "w", keys), "left_semi"), wanted


def _ranked(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__v"))
    spans = rows.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__n"))
    met = spans.alias("s").join(asked.alias("a").hint("merge"), _same("s", "a", keys))
    value = lambda r: F.max(F.when((F.col(r) >= F.col("__from")) & (F.col(r) < F.col("__to")), F.col("__v")))
    return met.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(((value("__r1") + value("__r2")) / 2).alias("median"))


def spread(df: DataFrame, sets: list[list[str]], value: str, limit: int = 100_000) -> DataFrame:
    """Mean, exact median, sample deviation, least and largest for each set of grouping columns, null where not grouped by."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    plain = [F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"), F.min(value).alias("least"), F.max(value).alias("most")]
    if not names:
        figures = df.agg(*plain)
        return figures.join(exact_medians(df, [], value, limit), how="left").select("mean", F.round("median", 4).alias("median"), "std", "least", "most")
    cols = [F.col(c) for c in names]
    figures = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id(*cols).alias("__set"), *plain)
    counted = df.where(F.col(value).isNotNull()).groupingSets([[F.col(c) for c in [*s, value]] for s in sets], *cols, F.col(value)).agg(F.shiftright(F.grouping_id(*cols, F.col(value)), 1).alias("__set"), F.count(F.lit(1)).alias("__rows"))
    medians = exact_medians(counted, ["__set", *names], value, limit, weight="__rows")
    joined = figures.alias("f").join(medians.alias("m"), _same("f", "m", ["__set", *names]), "left")
    return joined.select(*[f"f.{c}" for c in names], "mean", F.round("median", 4).alias("median"), "std", "least", "most")
