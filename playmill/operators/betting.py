"""Win shares, spread cover, recommendations and their outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmill.functions.maths import implied_probability, kelly_fraction, moneyline


def within(x: Column, limit: float) -> Column:
    """Whether a number is known and at most ``limit`` from 0; a limit of 0 allows all."""
    return F.coalesce(F.abs(x) <= limit, F.lit(False)) if limit else x.isNotNull()


def margins(runs: DataFrame, key: str) -> DataFrame:
    """(key, runs, margins): how often each difference away - home came, a row for each game.

    Runs are counted by difference first, so a game's row has as many entries as there are differences, whatever its runs.
    """
    counted = runs.groupBy(key, (F.col("away") - F.col("home")).alias("diff")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.sum("n").alias("runs"), F.collect_list(F.struct("diff", "n")).alias("margins"))


def share_where(test) -> Column:
    """The share of a game's runs whose difference passes a test; an unknown outcome does not."""
    passed = F.filter("margins", lambda m: test(m["diff"]))
    return F.aggregate(passed, F.lit(0).cast("long"), lambda total, m: total + m["n"]) / F.col("runs")


def win_and_cover(runs: DataFrame, results: DataFrame, key: str, edge: float) -> DataFrame:
    """Away win share and shares of runs covering the spread by more than ``edge`` on either side; results meet one row a game."""
    spread = F.col("final_spread")
    share = lambda test: F.round(share_where(test), 4)
    return margins(runs, key).join(results.select(key, "final_spread"), key).select(
        key, "runs",
        share(lambda d: d > 0).alias("away_win"),
        share(lambda d: d > -(spread - edge)).alias("away_cover"),
        share(lambda d: d < -(spread + edge)).alias("home_cover"),
    )


def recommendations(runs: DataFrame, results: DataFrame, least_runs: int = 5, sure: float = 0.6, value: float = 0.1, least_stake: float = 0.01) -> DataFrame:
    """One row per game with enough runs: spread and moneyline bets, stakes, outcome and profit per unit of bankroll."""
    spread = F.col("final_spread")
    wanted = results.select("game_id", "final_spread", "away_score", "home_score", "away_moneyline", "home_moneyline")
    bets = margins(runs, "game_id").where(F.col("runs") >= least_runs).join(wanted, "game_id")
    tests = {"away_win": lambda d: d > 0, "home_win": lambda d: d < 0, "away_cover": lambda d: d > -spread, "home_cover": lambda d: d < -spread}
    bets = bets.select("*", *[share_where(t).alias(n) for n, t in tests.items()]).drop("margins")
    gain = lambda line: F.when(moneyline(line) > 0, moneyline(line) / 100).when(moneyline(line) < 0, F.lit(100.0) / -moneyline(line))
    for side in ("away", "home"):
        line = F.col(f"{side}_moneyline")
        bets = bets.withColumn(f"{side}_kelly", kelly_fraction(F.col(f"{side}_win"), line)).withColumn(f"{side}_gain", gain(line)).withColumn(f"{side}_edge", F.col(f"{side}_win") - implied_probability(line))
    ladder = lambda test: F.when(test("away"), "away").when(test("home"), "home").otherwise("none")
    bets = bets.withColumn("spread_bet", F.when(F.col("final_spread").isNull(), "none").otherwise(ladder(lambda s: F.col(f"{s}_cover") >= sure)))
    bets = bets.withColumn("money_bet", ladder(lambda s: (F.col(f"{s}_edge") > value) & (F.col(f"{s}_kelly") >= least_stake)))
    actual = F.col("away_score") - F.col("home_score")
    won = (F.col("spread_bet") == "away") == (actual > -F.col("final_spread"))
    pick = lambda kind: F.when(F.col("money_bet") == "away", F.col(f"away_{kind}")).when(F.col("money_bet") == "home", F.col(f"home_{kind}"))
    hit = (F.col("money_bet") == "away") == (actual > 0)
    return (
        bets.withColumn("confidence", F.greatest("away_cover", "home_cover"))
        .withColumn("spread_outcome", F.when(F.col("spread_bet") != "none", F.when(actual == -F.col("final_spread"), "push").when(won, "won").otherwise("lost")))
        .withColumn("stake", F.coalesce(pick("kelly"), F.lit(0.0)))
        .withColumn("profit", F.coalesce(F.when(hit, pick("kelly") * pick("gain")).otherwise(-pick("kelly")), F.lit(0.0)))
    )
