"""Analytics over repeated simulation runs: filters, summaries, failures and orchestration figures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmill.functions.text import score_pair, score_sides

SUCCESS = ("completed", "game_ended")


def success(col: str = "status", names: tuple[str, ...] = SUCCESS) -> Column:
    """Whether a run ended well."""
    return F.col(col).isin(*names)


def with_scores(runs: DataFrame, col: str = "final_score") -> DataFrame:
    """Adds away and home, null where the score text cannot be read."""
    return runs.withColumn("__s", score_pair(F.col(col))).withColumn("away", F.col("__s.away")).withColumn("home", F.col("__s.home")).drop("__s")


def realistic(runs: DataFrame, least: int = 325, most: int = 550, cap: int = 175, statuses: tuple[str, ...] = SUCCESS) -> DataFrame:
    """Successful runs of a plausible length whose scores can be read and stay below ``cap``."""
    away, home = score_sides(F.col("final_score"))  # both are asked for, so neither need look at the other
    played = runs.where(success(names=statuses) & F.col("successful_predictions").between(least, most))
    return played.withColumn("away", away).withColumn("home", home).where((F.col("away") < cap) & (F.col("home") < cap))


def run_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: counts, prediction and duration figures, score list, medians and the home win share."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("successful_predictions"), 4).alias("mean_predictions"),
        F.min("successful_predictions").alias("min_predictions"),
        F.max("successful_predictions").alias("max_predictions"),
        F.round(F.avg("duration_seconds"), 4).alias("mean_duration"),
        F.array_join(F.sort_array(F.collect_list("final_score")), ",").alias("scores"),
        F.array_join(F.sort_array(F.collect_set("platform")), "|").alias("sources"),
        F.median(F.col("away") - F.col("home")).alias("median_diff"),
        F.median("away").alias("median_away"),
        F.median("home").alias("median_home"),
        F.round(F.avg((F.col("home") > F.col("away")).cast("double")), 4).alias("home_win_share"),
    )


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key: upsert by primary key as a rank."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_counts(df: DataFrame, col: Column, name: str, n: int) -> DataFrame:
    """The n commonest values, ties by value."""
    return df.where(col.isNotNull()).groupBy(col.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def right_closed_bins(col: Column, edges: list[int]) -> Column:
    """Labels of (0, e1], (e1, e2], ... and above the last edge; null for values not above 0."""
    out, low = F.when(col <= 0, F.lit(None).cast("string")), 0
    for edge in edges:
        out = out.when(col <= edge, F.lit(f"{low + 1}-{edge}"))
        low = edge
    return out.when(col > low, F.lit(f"{low}+"))


def flat_aggregates(df: DataFrame, keys: list[str], wanted: dict[str, list[str]], renames: dict[str, str] | None = None) -> DataFrame:
    """Several aggregates of several columns under flat names: column_aggregate, then the patterns of ``renames`` in turn."""
    out = []
    for column, kinds in wanted.items():
        for kind in kinds:
            name = f"{column}_{kind}"
            for pattern, by in (renames or {}).items():
                name = re.sub(pattern, by, name)
            out.append(getattr(F, kind)(column).alias(name))
    return df.groupBy(*keys).agg(*out)
