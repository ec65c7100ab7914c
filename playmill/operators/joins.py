"""Join shapes: text keys, first matches and repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_text_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join on a key that both sides hold as text or number."""
    return left.withColumn(key, F.col(key).cast("string")).join(right.withColumn(key, F.col(key).cast("string")), key, how)


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column], how: str = "inner") -> DataFrame:
    """Each left row with the first right row of its key."""
    first = right.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
    return left.join(first, keys, how)


def lookup(left: DataFrame, dim: DataFrame, key: str, dim_key: str, value: str, out: str) -> DataFrame:
    """A dimension value, or the key itself where the dimension lacks it."""
    side = dim.select(F.col(dim_key).alias(key), F.col(value).alias("__v"))
    return left.join(side, key, "left").withColumn(out, F.coalesce("__v", F.col(key))).drop("__v")


def repeat_rows(left: DataFrame, times: int, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1: a product without a join."""
    return left.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(times).cast("long"))))
