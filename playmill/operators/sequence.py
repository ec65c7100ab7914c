"""Ordered-sequence operators: sliding contexts, labels, islands, dictionary codes and first scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmill.session import shared_folder


def ordered(keys: list[str], order: list[str]):
    """The window every operator of this module runs over: the order is part of the data."""
    return Window.partitionBy(*keys).orderBy(*order)


def sliding(value: Column, keys: list[str], order: list[str], n: int, inclusive: bool = True) -> Column:
    """The last n values up to the current row, or before it."""
    frame = ordered(keys, order)
    return F.collect_list(value).over(frame.rowsBetween(-(n - 1), 0) if inclusive else frame.rowsBetween(-n, -1))


def skip_first(df: DataFrame, keys: list[str], order: list[str], n: int, value: Column, out: str) -> DataFrame:
    """``value`` from the (n + 1)-th row of each key on, and '{}' before."""
    rn = F.row_number().over(ordered(keys, order))
    return df.withColumn(out, F.when(rn > n, value).otherwise(F.lit("{}")))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int, value: Column, out: str) -> DataFrame:
    """One row per key with its first n values; only those leave each task's sort."""
    top = df.withColumn("__rn", F.row_number().over(ordered(keys, order))).where(F.col("__rn") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", value.alias("v")))), lambda x: x["v"]).alias(out))


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n rows of each key that come first in ``order``."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def points_added(keys: list[str], order: list[str], away: str, home: str) -> tuple[Column, Column]:
    """(points, side): what a row added to either score, the away side first."""
    w = ordered(keys, order)
    da, dh = (F.col(c) - F.lag(c, 1, 0).over(w) for c in (away, home))
    return F.when(da > 0, da).when(dh > 0, dh).otherwise(0), F.when(da > 0, "A").when(dh > 0, "H")


def islands(df: DataFrame, keys: list[str], order: list[str], same: Column) -> DataFrame:
    """Adds ``island``: a number that grows wherever ``same`` (may look at lag columns) is not true."""
    w = ordered(keys, order)
    return df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("__new").over(w)).drop("__new")


def collapse_runs(df: DataFrame, keys: list[str], order: str, text: str, clock: str, actor: str, in_run: Column, label: str) -> DataFrame:
    """Runs of neighbouring rows that satisfy ``in_run`` at one clock become one row with joined texts and no actor."""
    w = ordered(keys, [order])
    flagged = df.withColumn("__in", in_run)
    same = F.col("__in") & F.lag("__in").over(w) & (F.col(clock) == F.lag(clock).over(w))
    grouped = islands(flagged, keys, [order], same).groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_list(F.struct(order, text, actor))).alias("__r"), F.first(clock).alias(clock))
    joined = F.concat(F.lit(f"{label}: "), F.array_join(F.transform("__r", lambda r: r[text]), ", "))
    one = F.col("__r")[0]
    return grouped.select(*keys, one[order].alias(order), clock, F.when(F.col("rows") > 1, joined).otherwise(one[text]).alias(text), F.when(F.col("rows") == 1, one[actor]).alias(actor), "rows")


def run_length(keys: list[str], order: list[str], value: str, df: DataFrame) -> DataFrame:
    """Adds ``run``: how many rows in a row have had this value."""
    w = ordered(keys, order)
    marked = islands(df, keys, order, F.col(value) == F.lag(value).over(w))
    return marked.withColumn("run", F.row_number().over(Window.partitionBy(*keys, "island").orderBy(*order))).drop("island")


def first_appearance_codes(values: Column) -> tuple[Column, Column]:
    """(dictionary, codes) of an array: distinct values in order of first appearance, and each value's place from 0."""
    words = F.array_distinct(values)
    return words, F.transform(values, lambda v: F.array_position(words, v).cast("int") - 1)


def deltas_within(values: Column) -> Column:
    """Differences of neighbouring array elements, the first against 0."""
    return F.transform(values, lambda x, i: x - F.when(i == 0, 0).otherwise(F.element_at(values, F.greatest(i, F.lit(1)))))


def first_scorers(df: DataFrame, keys: list[str], order: str, team: str, away: str, home: str) -> DataFrame:
    """The teams that first raise the away and the home score, else Unknown."""
    w = ordered(keys, [order])
    rose = lambda c: F.when((F.col(c) > F.lag(c, 1, 0).over(w)) & (F.coalesce(F.col(team), F.lit("")) != ""), F.col(order))
    marked = df.withColumn("__a", rose(away)).withColumn("__h", rose(home))
    return marked.groupBy(*keys).agg(F.coalesce(F.min_by(team, "__a"), F.lit("Unknown")).alias("away_team"), F.coalesce(F.min_by(team, "__h"), F.lit("Unknown")).alias("home_team"))


def _parts(df: DataFrame, parts: int | None, rows: int = 500_000) -> int:
    """``parts``, or how many ranges of about ``rows`` rows there are, at least 32."""
    return parts or max(32, -(-df.count() // rows))


def chunk_of(df: DataFrame, order: list[str], chunks: int, parts: int | None = None) -> DataFrame:
    """Adds ``chunk``: contiguous pieces of ceil(n / chunks) rows in ``order``, numbered from 0.

    Rows are dealt to ranges of the order first, so numbering needs no single task.  The deal is checkpointed: it is
    counted and numbered, and both must see the same one.
    """
    shared_folder(df.sparkSession)
    spread = df.repartitionByRange(_parts(df, parts), *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    rn = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    numbered = spread.withColumn("__rn", rn).join(F.broadcast(before), "__part")
    return numbered.withColumn("chunk", F.floor((F.col("__before") + F.col("__rn") - 1) / F.ceil(F.col("__all") / F.lit(chunks)))).drop("__part", "__rn", "__before", "__all", "__n")


def global_place(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Adds ``place``: the number of each row in ``order`` over the whole table, from 1, without a single task."""
    shared_folder(df.sparkSession)
    spread = df.repartitionByRange(_parts(df, parts), *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each part
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rn = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return spread.withColumn("__rn", rn).join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + F.col("__rn")).drop("__part", "__rn", "__before")
