"""Exact medians at every asked day: order statistics of growing prefixes, in one pass over each group's days."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructType

from playmill.operators.asof import day_number
from playmill.operators.sequence import global_place
from playmill.session import scratch_path


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _met(left: DataFrame, a: str, right: DataFrame, b: str, keys: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """A join of two sides that both grow with the table, always sorted and merged.

    Written numbers and days take a few bits a row, so a planner that goes by the size of files would send millions of
    rows through the driver.
    """
    on = _same(a, b, keys)
    return left.alias(a).join(right.alias(b).hint("merge"), on if also is None else on & also, how)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as written to the shared folder, where they survive lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_medians(facts: DataFrame, asked: DataFrame | None, keys: list[str], day: str, measures: list[str], bits: int = 4, limit: int = 500_000) -> DataFrame:
    """(keys, as_of_day, measures, games, last_day, rest_days) of each asked (keys, day) over strictly earlier facts.

    Without ``asked``, every day of the facts is asked for, and they are read as they stand.

    Facts move once: to ranges of whole groups, in order of their days, where two heaps a measure follow the medians (see
    ``_folded``).  A group of more than ``limit`` facts would make one long task; such groups, at most one in ``limit``
    facts, walk down a tree of their values instead (see ``_by_tree``), which needs more room but no task holds one.

    Cases: null measures take no part in medians but count as games; a measure without a known value before the day is
    null; asked days without earlier facts, and null days, have no row; null keys are a group; days asked twice count
    once; NaN is the largest value; empty tables give an empty result.
    """
    known = facts.where(F.col(day).isNotNull()).select(*keys, F.col(day).cast("date").alias("__day"), *[F.col(m).cast("double").alias(m) for m in measures])
    points = None if asked is None else asked.where(F.col(day).isNotNull()).select(*keys, F.col(day).cast("date").alias("__day"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    rows, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
    if (most or 0) <= limit:
        return _folded(known, points, keys, day, measures, rows or 0)
    large = _kept(sizes.where(F.col("__n") > limit).select(*keys), "large")
    of = lambda df, how: df.alias("f").join(F.broadcast(large).alias("l"), _same("f", "l", keys), how)
    asking = known if points is None else points
    rest = _folded(of(known, "left_anti"), None if points is None else of(points, "left_anti"), keys, day, measures, rows)
    return rest.unionByName(_by_tree(of(known, "left_semi"), of(asking.select(*keys, "__day"), "left_semi"), keys, day, measures, bits))


def _folded(known: DataFrame, points: DataFrame | None, keys: list[str], day: str, measures: list[str], rows: int) -> DataFrame:
    """The medians by one pass over whole groups in order of days; a task holds the values of one group at a time."""
    names, ms = [f"__k{i}" for i in range(len(keys))], [f"__m{i}" for i in range(len(measures))]
    named = [F.col(k).alias(n) for k, n in zip(keys, names)]
    both, order = known.select(*named, "__day", *[F.col(m).alias(n) for m, n in zip(measures, ms)]), [*names, "__day"]
    if points is not None:  # an asked day stands before the facts of that day
        both = both.withColumn("__fact", F.lit(True)).unionByName(points.distinct().select(*named, "__day", F.lit(False).alias("__fact")), allowMissingColumns=True)
        order = [*order, "__fact"]
    spread = both.repartition(max(32, -(-rows // 500_000)), *names)
    first = F.row_number().over(Window.partitionBy(*names).orderBy(*order[len(names) :])) == 1
    kinds = StructType([*spread.select(*names, "__day").schema.fields])
    for m in ms:
        kinds = kinds.add(m, DoubleType())
    kinds = kinds.add("games", LongType()).add("last_day", DateType())
    found = spread.withColumn("__first", first).sortWithinPartitions(*order).mapInArrow(_medians_in_order(names, ms, points is None), kinds)
    back = [F.col(n).alias(c) for n, c in zip([*names, "__day", *ms], [*keys, f"as_of_{day}", *measures])]
    return found.select(*back, "games", "last_day", F.datediff("__day", "last_day").alias("rest_days"))


class _Middle:
    """The median of the values so far, between a heap of the lower half and one of the upper; NaNs are above all."""

    def __init__(self):
        self.low, self.high, self.n = [], [], 0

    def add(self, value: float) -> None:
        self.n += 1
        if self.low and value < -self.low[0]:
            heappush(self.low, -value)
        elif value == value:
            heappush(self.high, value)

    def median(self) -> float | None:
        low, high, half = self.low, self.high, (self.n + 1) // 2
        while len(low) > half:
            heappush(high, -heappop(low))
        while len(low) < half and high:
            heappush(low, -heappop(high))
        if not self.n:
            return None
        if len(low) < half or self.n % 2 == 0 and not high:
            return float("nan")
        return -low[0] if self.n % 2 else (-low[0] + high[0]) / 2


def _plain_values(column: pa.Array) -> list[float | None]:
    """The doubles of a column, without negative zeros."""
    values = (column.to_numpy(zero_copy_only=False) + 0.0).tolist()
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
            values[i] = None
    return values


def _medians_in_order(names: list[str], measures: list[str], every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A fold over rows in order of group and day: the medians, number and last day of the facts before each asked day."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middles, games, last = [], 0, None
        for b in batches:
            days = b.column("__day").cast(pa.int32()).to_numpy().tolist()
            new = b.column("__first").to_numpy(zero_copy_only=False).tolist()
            facts = [True] * b.num_rows if every else b.column("__fact").to_numpy(zero_copy_only=False).tolist()
            at, found, played, lasts = [], [], [], []
            for i, (begins, today, fact, *values) in enumerate(zip(new, days, facts, *[_plain_values(b.column(m)) for m in measures])):
                if begins:
                    middles, games, last = [_Middle() for _ in measures], 0, None
                if games and (last != today if every else not fact):
                    at.append(i)
                    found.append([m.median() for m in middles])
                    played.append(games)
                    lasts.append(last)
                if fact:
                    games, last = games + 1, today
                    for m, v in zip(middles, values):
                        if v is not None:
                            m.add(v)
            columns = [*b.select([*names, "__day"]).take(pa.array(at, pa.int64())).columns]
            columns += [pa.array(list(c), pa.float64()) for c in (zip(*found) if found else [()] * len(measures))]
            columns += [pa.array(played, pa.int64()), pa.array(lasts, pa.int32()).cast(pa.date32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "__day", *measures, "games", "last_day"])

    return run


def _by_tree(known: DataFrame, points: DataFrame, keys: list[str], day: str, measures: list[str], bits: int) -> DataFrame:
    """The medians of groups of any size.

    The values of a group are numbered in order, and the numbers are the leaves of a tree of 2 ** ``bits`` branches a
    node.  All asked days walk down that tree together, a level a job: at each node the facts are counted by branch and
    day, the counts summed over earlier days, and each middle row goes to the branch that holds it.  So a fact is
    counted once a level and never sorted again for another day, and nodes that no asked day reaches drop out.

    No task holds a group: rows are counted by value and day before they move, and a window holds a row a calendar day,
    however many rows a group has.  Values are numbered over ranges of the whole table.
    """
    group, points = [*keys, "__m"], points.distinct()
    stacked = known.select(*keys, "__day", F.posexplode(F.array(*measures)).alias("__m", "__v")).where("__v is not null")
    daily = _kept(stacked.groupBy(*group, "__v", "__day").agg(F.count(F.lit(1)).alias("__n")), "daily")
    placed = global_place(daily.select(*group, "__v").distinct(), [*group, "__v"])
    least = placed.groupBy(*group).agg(F.min("place").alias("__least"))
    codes = _kept(_met(placed, "p", least, "l", group).select(*[f"p.{g}" for g in group], "__v", (F.col("place") - F.col("__least")).alias("__code")), "codes")
    coded = _kept(_met(daily, "d", codes, "c", [*group, "__v"]).select(*[f"d.{g}" for g in group], "__day", "__n", "__code"), "coded")
    most = codes.agg(F.max("__code")).first()[0] or 0
    depth = max(1, -(-most.bit_length() // bits))
    walkers = points.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(len(measures) - 1)))).select(*group, "__day", F.lit(0).cast("long").alias("__node"), F.lit(None).cast("long").alias("__rank"))
    for level in range(depth):
        walkers = _kept(_descended(coded, walkers, group, bits, bits * (depth - 1 - level), first=level == 0), "walkers")
    found = _met(walkers, "w", codes, "c", group, also=F.col("w.__node") == F.col("c.__code"))
    mids = found.groupBy(*[F.col(f"w.{k}").alias(k) for k in keys], "__day").agg(*[F.avg(F.when(F.col("w.__m") == i, F.col("__v"))).alias(m) for i, m in enumerate(measures)])
    counted = known.groupBy(*keys, "__day").agg(F.count(F.lit(1)).alias("__n")).unionByName(points.withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy(day_number(F.col("__day"))).rangeBetween(Window.unboundedPreceding, -1)
    played = F.max(F.when(F.col("__n").isNotNull(), F.col("__day"))).over(earlier)
    games = counted.select(*keys, "__day", "__asked", F.sum("__n").over(earlier).alias("games"), played.alias("last_day")).where("__asked and games > 0")
    joined = _met(games, "g", mids, "m", [*keys, "__day"], "left")
    return joined.select(*[f"g.{k}" for k in keys], F.col("g.__day").alias(f"as_of_{day}"), *measures, "games", "last_day", F.datediff("g.__day", "last_day").alias("rest_days"))


def _descended(coded: DataFrame, walkers: DataFrame, group: list[str], bits: int, shift: int, first: bool) -> DataFrame:
    """The walkers one level further down; at the root each is first given the ranks of its middle rows."""
    width, at = 2**bits, [*group, "__node"]
    facts = coded.withColumn("__node", F.shiftright("__code", bits + shift)).withColumn("__branch", F.shiftright("__code", shift).bitwiseAND(F.lit(width - 1)))
    if not first:
        facts = _met(facts, "f", walkers.select(*at).distinct(), "w", at, "left_semi")
    by_day = facts.groupBy(*at, "__day").agg(*[F.sum(F.when(F.col("__branch") == i, F.col("__n"))).alias(f"__b{i}") for i in range(width)])
    both = by_day.unionByName(walkers.withColumn("__walker", F.lit(True)), allowMissingColumns=True)
    earlier = Window.partitionBy(*at).orderBy(day_number(F.col("__day"))).rangeBetween(Window.unboundedPreceding, -1)
    running = both.select(*at, "__day", "__rank", "__walker", *[F.coalesce(F.sum(f"__b{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(width)]).where("__walker")
    upto = running
    for i in range(1, width):
        upto = upto.withColumn(f"__b{i}", F.col(f"__b{i - 1}") + F.col(f"__b{i}"))
    if first:
        total = F.col(f"__b{width - 1}")
        ranks = F.array_distinct(F.array(F.floor((total - 1) / 2).cast("long"), F.floor(total / 2).cast("long")))
        upto = upto.where(total > 0).withColumn("__rank", F.explode(ranks))
    passed = [F.col(f"__b{i}") <= F.col("__rank") for i in range(width - 1)]
    branch = reduce(lambda a, b: a + b, [p.cast("long") for p in passed])
    below = F.greatest(F.lit(0).cast("long"), *[F.when(p, F.col(f"__b{i}")).otherwise(0) for i, p in enumerate(passed)])
    return upto.select(*group, "__day", (F.col("__node") * width + branch).alias("__node"), (F.col("__rank") - below).alias("__rank"))
