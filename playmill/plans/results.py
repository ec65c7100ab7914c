"""Result analytics: run summaries, failures, lookups and betting evaluation, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmill.functions import maths
from playmill.operators import betting, joins, quantiles, runs as ops, sequence
from playmill.plans.registry import query

#: Score texts read and gated as the operators do.
SCORED = r"""scored AS (
  SELECT *, CASE WHEN len(string_split(final_score, ' - ')) = 2 AND regexp_matches(regexp_extract(string_split(final_score, ' - ')[1], '(\S+)\s*$', 1), '^[+-]?\d+$')
                  AND regexp_matches(regexp_extract(string_split(final_score, ' - ')[2], '(\S+)\s*$', 1), '^[+-]?\d+$')
    THEN TRUE ELSE FALSE END AS ok,
    TRY_CAST(regexp_extract(string_split(final_score, ' - ')[1], '(\S+)\s*$', 1) AS INT) AS a0,
    TRY_CAST(regexp_extract(string_split(final_score, ' - ')[2], '(\S+)\s*$', 1) AS INT) AS h0 FROM runs),
good AS (SELECT *, CASE WHEN ok THEN a0 END AS away, CASE WHEN ok THEN h0 END AS home FROM scored)"""
KEPT = f"{SCORED}, kept AS (SELECT * FROM good WHERE status IN ('completed', 'game_ended') AND successful_predictions BETWEEN 325 AND 550 AND away < 175 AND home < 175)"

SUMMARY_SQL = """count(*) AS runs, round(avg(successful_predictions), 4) AS mean_predictions, min(successful_predictions) AS min_predictions, max(successful_predictions) AS max_predictions,
 round(avg(duration_seconds), 4) AS mean_duration, string_agg(final_score, ',' ORDER BY final_score) AS scores,
 array_to_string(list_sort(list(DISTINCT platform)), '|') AS sources, CAST(median(away - home) AS DOUBLE) AS median_diff, CAST(median(away) AS DOUBLE) AS median_away, CAST(median(home) AS DOUBLE) AS median_home,
 round(avg(CASE WHEN home > away THEN 1.0 ELSE 0.0 END), 4) AS home_win_share"""


@query("a07_run_summary", f"WITH {KEPT} SELECT game_id, {SUMMARY_SQL} FROM kept GROUP BY game_id", "runs")
def run_summary(runs: DataFrame) -> DataFrame:
    """Realistic runs per game with medians and the home win share."""
    return ops.run_summary(ops.realistic(runs), ["game_id"])


@query("p07_realistic_runs", f"WITH {KEPT} SELECT run_id, away, home FROM kept", "runs")
def realistic_runs(runs: DataFrame) -> DataFrame:
    """P7, F-S3: status, length and score filters."""
    return ops.realistic(runs).select("run_id", "away", "home")


@query("p09_minimum_runs", f"WITH {KEPT} SELECT game_id, count(*) AS runs FROM kept GROUP BY game_id HAVING count(*) >= 5", "runs")
def minimum_runs(runs: DataFrame) -> DataFrame:
    """Games with at least five runs."""
    return ops.realistic(runs).groupBy("game_id").agg(F.count(F.lit(1)).alias("runs")).where("runs >= 5")


@query("p14_derived_columns", "SELECT game_id, away_score + home_score AS total, home_score - away_score AS difference, CAST(home_score > away_score AS INT) AS home_win, CASE WHEN away_score + home_score > final_ou THEN 'over' WHEN away_score + home_score < final_ou THEN 'under' WHEN final_ou IS NOT NULL THEN 'push' END AS over_under FROM results", "results")
def derived(results: DataFrame) -> DataFrame:
    """Derived result columns."""
    total = F.col("away_score") + F.col("home_score")
    ou = F.when(total > F.col("final_ou"), "over").when(total < F.col("final_ou"), "under").when(F.col("final_ou").isNotNull(), "push")
    return results.select("game_id", total.alias("total"), (F.col("home_score") - F.col("away_score")).alias("difference"), (F.col("home_score") > F.col("away_score")).cast("int").alias("home_win"), ou.alias("over_under"))


@query("p20_scoring_labels", "SELECT game_id, count(*) FILTER (scoring_rate > 25) AS high, count(*) FILTER (scoring_rate < 15) AS low FROM runs GROUP BY game_id", "runs")
def scoring_labels(runs: DataFrame) -> DataFrame:
    """P20: runs above and below the scoring-rate cuts."""
    return runs.groupBy("game_id").agg(F.count_if(F.col("scoring_rate") > 25).alias("high"), F.count_if(F.col("scoring_rate") < 15).alias("low"))


@query("a08_display_summary", "SELECT game_id, count(*) AS runs, count(*) FILTER (status IN ('completed', 'game_ended')) AS ok, round(avg(successful_predictions), 1) AS mean_predictions, string_agg(final_score, ', ' ORDER BY final_score) AS scores, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM runs GROUP BY game_id", "runs")
def display_summary(runs: DataFrame) -> DataFrame:
    """Conditional counts and joined texts per game."""
    return runs.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(ops.success()).alias("ok"),
        F.round(F.avg("successful_predictions"), 1).alias("mean_predictions"),
        F.nullif(F.array_join(F.sort_array(F.collect_list("final_score")), ", "), F.lit("")).alias("scores"),
        F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"),
    )


@query("a10_status_counts", "SELECT count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS errors, round(avg(duration_seconds), 4) AS mean_duration, count(DISTINCT game_id) AS games FROM runs", "runs")
def status_counts(runs: DataFrame) -> DataFrame:
    """Global counts and averages."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.avg("duration_seconds"), 4).alias("mean_duration"), F.count_distinct("game_id").alias("games"))


@query("a11_runs_per_game", "SELECT game_id, count(*) AS runs, round(avg(successful_predictions), 4) AS mean_predictions, round(avg(duration_seconds), 4) AS mean_duration FROM runs GROUP BY game_id", "runs")
def runs_per_game(runs: DataFrame) -> DataFrame:
    """Runs and means per game."""
    return runs.groupBy("game_id").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("successful_predictions"), 4).alias("mean_predictions"), F.round(F.avg("duration_seconds"), 4).alias("mean_duration"))


@query("a12_successful_averages", "SELECT game_id, count(*) FILTER (status IN ('completed', 'game_ended')) AS ok, round(avg(CASE WHEN status IN ('completed', 'game_ended') THEN successful_predictions END), 4) AS mean_ok FROM runs GROUP BY game_id", "runs")
def successful_averages(runs: DataFrame) -> DataFrame:
    """Averages over successful runs only."""
    return runs.groupBy("game_id").agg(F.count_if(ops.success()).alias("ok"), F.round(F.avg(F.when(ops.success(), F.col("successful_predictions"))), 4).alias("mean_ok"))


@query("a13_game_deviation", "SELECT game_id, round(avg(successful_predictions), 4) AS mean, round(stddev_samp(successful_predictions), 4) AS std, count(*) FILTER (status = 'completed') AS completed, round(count(*) FILTER (status = 'completed') / count(*), 4) AS success_rate FROM runs GROUP BY game_id", "runs")
def game_deviation(runs: DataFrame) -> DataFrame:
    """Mean, sample deviation and success rate per game."""
    done = F.count_if(F.col("status") == "completed")
    return runs.groupBy("game_id").agg(F.round(F.avg("successful_predictions"), 4).alias("mean"), F.round(F.stddev_samp("successful_predictions"), 4).alias("std"), done.alias("completed"), F.round(done / F.count(F.lit(1)), 4).alias("success_rate"))


@query("a14_platform_comparison", "SELECT platform, count(*) AS runs, round(avg(scoring_rate), 4) AS mean_rate, round(avg(duration_seconds), 4) AS mean_duration FROM runs WHERE (SELECT count(DISTINCT platform) FROM runs) > 1 GROUP BY platform", "runs")
def platforms(runs: DataFrame) -> DataFrame:
    """Figures per platform, nothing where there is only one."""
    several = runs.agg(F.count_distinct("platform").alias("__n")).where("__n > 1")
    return runs.groupBy("platform").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("scoring_rate"), 4).alias("mean_rate"), F.round(F.avg("duration_seconds"), 4).alias("mean_duration")).join(F.broadcast(several)).drop("__n")


@query("a15_scoring_patterns", "SELECT coalesce(game_id, 'all') AS game, round(avg(scoring_rate), 4) AS mean, round(CAST(median(scoring_rate) AS DOUBLE), 4) AS median, round(stddev_samp(scoring_rate), 4) AS std, min(scoring_rate) AS least, max(scoring_rate) AS most FROM runs GROUP BY GROUPING SETS ((), (game_id))", "runs")
def scoring_patterns(runs: DataFrame) -> DataFrame:
    """Spread of the scoring rate overall and per game by grouping sets, medians without one task for all values."""
    return quantiles.spread(runs, [[], ["game_id"]], "scoring_rate").select(F.coalesce("game_id", F.lit("all")).alias("game"), "mean", "median", "std", "least", "most")


@query("a16_duration_analysis", "SELECT coalesce(status, '-') AS status, coalesce(game_id, '-') AS game, round(avg(duration_seconds), 4) AS mean, round(CAST(median(duration_seconds) AS DOUBLE), 4) AS median, round(stddev_samp(duration_seconds), 4) AS std, min(duration_seconds) AS least, max(duration_seconds) AS most FROM runs GROUP BY GROUPING SETS ((), (status), (game_id))", "runs")
def durations(runs: DataFrame) -> DataFrame:
    """Durations overall, by status and by game."""
    found = quantiles.spread(runs, [[], ["status"], ["game_id"]], "duration_seconds")
    return found.select(F.coalesce("status", F.lit("-")).alias("status"), F.coalesce("game_id", F.lit("-")).alias("game"), "mean", "median", "std", "least", "most")


@query("a17_failure_analysis", "SELECT error_message, count(*) AS n FROM runs WHERE error_message IS NOT NULL GROUP BY 1 ORDER BY n DESC, error_message LIMIT 5", "runs")
def failures(runs: DataFrame) -> DataFrame:
    """The five commonest errors."""
    return ops.top_counts(runs, F.col("error_message"), "error_message", 5)


@query("a17_failure_rates", "SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM runs GROUP BY status", "runs")
def failure_rates(runs: DataFrame) -> DataFrame:
    """Runs by status and their share."""
    counts = runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select("status", "n", F.round(F.col("n") / F.col("__all"), 6).alias("share"))


@query("a18_terminations", "SELECT CASE WHEN starts_with(termination_reason, 'Game ended') THEN 'natural_end' ELSE coalesce(termination_reason, 'normal_completion') END AS reason, count(*) AS n FROM runs GROUP BY 1", "runs")
def terminations(runs: DataFrame) -> DataFrame:
    """Reasons, natural endings by their common beginning."""
    reason = F.when(F.col("termination_reason").startswith("Game ended"), "natural_end").otherwise(F.coalesce("termination_reason", F.lit("normal_completion")))
    return runs.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a25_daily_means", "SELECT day, round(avg(away_score + home_score), 4) AS mean_total, round(avg(home_score - away_score), 4) AS mean_margin FROM results GROUP BY day", "results")
def daily_means(results: DataFrame) -> DataFrame:
    """Means per day."""
    return results.groupBy("day").agg(F.round(F.avg(F.col("away_score") + F.col("home_score")), 4).alias("mean_total"), F.round(F.avg(F.col("home_score") - F.col("away_score")), 4).alias("mean_margin"))


@query("a26_season_stats", "SELECT round(avg(away_score + home_score), 4) AS mean_total, round(avg(CAST(home_score > away_score AS DOUBLE)), 4) AS home_win_rate, round(avg(CAST(away_score + home_score > final_ou AS DOUBLE)), 4) AS over_rate, round(avg(CAST(away_score - home_score > -final_spread AS DOUBLE)), 4) AS away_cover_rate, count(final_spread) AS with_spread FROM results", "results")
def season_stats(results: DataFrame) -> DataFrame:
    """Season figures."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    total = F.col("away_score") + F.col("home_score")
    return results.agg(F.round(F.avg(total), 4).alias("mean_total"), rate(F.col("home_score") > F.col("away_score")).alias("home_win_rate"), rate(total > F.col("final_ou")).alias("over_rate"), rate(F.col("away_score") - F.col("home_score") > -F.col("final_spread")).alias("away_cover_rate"), F.count("final_spread").alias("with_spread"))


@query("a27_status_crosstab", "SELECT CAST(start_time AS DATE) AS day, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'game_ended') AS game_ended FROM runs GROUP BY 1", "runs")
def crosstab(runs: DataFrame) -> DataFrame:
    """Days by status, 0 where there is none."""
    return runs.groupBy(F.to_date("start_time").alias("day")).pivot("status", ["completed", "error", "game_ended"]).count().na.fill(0)


@query("a28_prediction_bins", "SELECT CASE WHEN successful_predictions <= 0 THEN NULL WHEN successful_predictions <= 100 THEN '1-100' WHEN successful_predictions <= 200 THEN '101-200' WHEN successful_predictions <= 300 THEN '201-300' WHEN successful_predictions <= 400 THEN '301-400' WHEN successful_predictions <= 500 THEN '401-500' WHEN successful_predictions <= 600 THEN '501-600' ELSE '600+' END AS bin, count(*) AS n FROM runs GROUP BY 1", "runs")
def bins(runs: DataFrame) -> DataFrame:
    """Histogram over right-closed bins."""
    return runs.groupBy(ops.right_closed_bins(F.col("successful_predictions"), [100, 200, 300, 400, 500, 600]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("a29_descriptive", "SELECT round(avg(duration_seconds), 4) AS mean, round(CAST(median(duration_seconds) AS DOUBLE), 4) AS median, round(stddev_samp(duration_seconds), 4) AS std, min(duration_seconds) AS least, max(duration_seconds) AS most FROM runs", "runs")
def descriptive(runs: DataFrame) -> DataFrame:
    """Mean, median, deviation and range."""
    return quantiles.spread(runs, [[]], "duration_seconds")


@query("a34_failure_patterns", "SELECT status, arg_min(run_id, CAST(run_id AS INT)) AS first_run, arg_max(run_id, CAST(run_id AS INT)) AS last_run, count(DISTINCT error_message) AS kinds, count(error_message) AS n FROM runs GROUP BY status", "runs")
def failure_patterns(runs: DataFrame) -> DataFrame:
    """Kinds of failure with the first and last example."""
    order = F.col("run_id").cast("int")
    return runs.groupBy("status").agg(F.min_by("run_id", order).alias("first_run"), F.max_by("run_id", order).alias("last_run"), F.count_distinct("error_message").alias("kinds"), F.count("error_message").alias("n"))


@query("a35_error_groups", "SELECT substring(error_message, 1, 50) AS error, count(*) AS n, count(DISTINCT game_id) AS games FROM runs WHERE error_message IS NOT NULL GROUP BY 1", "runs")
def error_groups(runs: DataFrame) -> DataFrame:
    """A35, F-S17: errors grouped by their first 50 characters."""
    return runs.where("error_message is not null").groupBy(F.substring("error_message", 1, 50).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("game_id").alias("games"))


@query("a36_recent_errors", "SELECT game_id, count(*) AS n FROM runs WHERE start_time >= TIMESTAMP '2001-07-01' - INTERVAL 720 HOUR AND start_time <= TIMESTAMP '2001-07-01' AND status = 'error' GROUP BY game_id ORDER BY n DESC, game_id LIMIT 10", "runs")
def recent_errors(runs: DataFrame) -> DataFrame:
    """Games with most errors in a time window that ends at a given instant."""
    now = F.lit("2001-07-01").cast("timestamp_ntz")
    recent = runs.where((F.col("start_time") >= now - F.expr("interval 720 hours")) & (F.col("start_time") <= now) & (F.col("status") == "error"))
    return ops.top_counts(recent, F.col("game_id"), "game_id", 10)


@query("j01_runs_with_results", f"WITH {KEPT} SELECT run_id, game_id, away, home, away_score, home_score FROM kept JOIN results USING (game_id)", "runs", "results")
def runs_with_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Simulations with actual results on the text key."""
    return joins.by_text_key(ops.realistic(runs), results, "game_id").select("run_id", "game_id", "away", "home", "away_score", "home_score")


@query("j02_first_match", "WITH firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY home_team ORDER BY CAST(game_id AS INT)) AS rn FROM results) WHERE rn = 1) SELECT r.game_id, r.away_team, f.game_id AS first_game FROM results r JOIN firsts f ON r.away_team = f.home_team", "results")
def first_match(results: DataFrame) -> DataFrame:
    """Lookup in which the first match wins."""
    side = results.select(F.col("home_team").alias("away_team"), F.col("game_id").alias("first_game"))
    return joins.first_match(results.select("game_id", "away_team"), side, ["away_team"], [F.col("first_game").cast("int")])


@query("j03_left_display", "SELECT run_id, coalesce(away_team, 'Unknown') AS away_team, coalesce(CAST(final_spread AS STRING), 'N/A') AS spread FROM runs LEFT JOIN results USING (game_id)", "runs", "results")
def left_display(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Left lookup with words for what is missing."""
    return runs.join(results, "game_id", "left").select("run_id", F.coalesce("away_team", F.lit("Unknown")).alias("away_team"), F.coalesce(F.col("final_spread").cast("string"), F.lit("N/A")).alias("spread"))


@query("j10_task_list", "SELECT game_id, CAST(run AS BIGINT) AS run FROM results, range(1, 6) t(run)", "results")
def task_list(results: DataFrame) -> DataFrame:
    """All games by runs."""
    return joins.repeat_rows(results.select("game_id"), 5, "run")


@query("j16_semi_join", "SELECT run_id FROM runs WHERE game_id IN (SELECT game_id FROM results WHERE final_spread > 5)", "runs", "results")
def semi(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs of requested games."""
    return runs.join(results.where("final_spread > 5"), "game_id", "left_semi").select("run_id")


@query("j17_mismatch", "SELECT run_id FROM runs WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.game_id = runs.game_id AND r.day < 90)", "runs", "results")
def mismatch(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs whose game is not among the expected ones."""
    return runs.join(results.where("day < 90"), "game_id", "left_anti").select("run_id")


@query("o04_top_games", "SELECT game_id, count(*) FILTER (status <> 'error') AS ok FROM runs GROUP BY game_id ORDER BY ok DESC, game_id LIMIT 10", "runs")
def top_games(runs: DataFrame) -> DataFrame:
    """The ten games with most successful runs."""
    return runs.groupBy("game_id").agg(F.count_if(F.col("status") != "error").alias("ok")).orderBy(F.desc("ok"), "game_id").limit(10)


@query("o06_numeric_order", "SELECT game_id, row_number() OVER (ORDER BY CAST(game_id AS INT)) AS place FROM (SELECT DISTINCT game_id FROM runs)", "runs")
def numeric_order(runs: DataFrame) -> DataFrame:
    """Distinct ids numbered in numeric order."""
    ids = runs.select("game_id").distinct().withColumn("number", F.expr("try_cast(game_id as int)"))
    return sequence.global_place(ids, ["number", "game_id"]).select("game_id", "place")


@query("w12_latest_success", "SELECT game_id, arg_max(run_id, (start_time, CAST(run_id AS INT))) AS run_id FROM runs WHERE status <> 'error' GROUP BY game_id", "runs")
def latest_success(runs: DataFrame) -> DataFrame:
    """The most recent successful run of each game."""
    return runs.where("status <> 'error'").groupBy("game_id").agg(F.max_by("run_id", F.struct("start_time", F.col("run_id").cast("int"))).alias("run_id"))


@query("a21_win_and_cover", f"WITH {KEPT} SELECT game_id, count(*) AS runs, round(avg(CAST(away > home AS DOUBLE)), 4) AS away_win, round(avg(CASE WHEN away - home > -(final_spread - 1.0) THEN 1.0 ELSE 0.0 END), 4) AS away_cover, round(avg(CASE WHEN away - home < -(final_spread + 1.0) THEN 1.0 ELSE 0.0 END), 4) AS home_cover FROM kept JOIN results USING (game_id) GROUP BY game_id", "runs", "results")
def win_and_cover(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Win probability and the share of runs that cover the spread with an edge."""
    return betting.win_and_cover(ops.realistic(runs), results, "game_id", edge=1.0)


BETS_SQL = f"""WITH {KEPT}, odds AS (SELECT game_id, day, away_score, home_score, final_spread,
    CASE WHEN regexp_matches(away_moneyline, '^[+-]?\\d+(\\.\\d+)?$') THEN CAST(away_moneyline AS DOUBLE) END AS ma,
    CASE WHEN regexp_matches(home_moneyline, '^[+-]?\\d+(\\.\\d+)?$') THEN CAST(home_moneyline AS DOUBLE) END AS mh FROM results),
shares AS (SELECT game_id, count(*) AS runs, avg(CAST(away > home AS DOUBLE)) AS away_win, avg(CAST(home > away AS DOUBLE)) AS home_win,
    avg(CASE WHEN away - home > -final_spread THEN 1.0 ELSE 0.0 END) AS away_cover, avg(CASE WHEN away - home < -final_spread THEN 1.0 ELSE 0.0 END) AS home_cover
    FROM kept JOIN odds USING (game_id) GROUP BY game_id HAVING count(*) >= 3),
priced AS (SELECT *, CASE WHEN ma > 0 THEN 100 / (ma + 100) WHEN ma < 0 THEN -ma / (-ma + 100) END AS pa, CASE WHEN mh > 0 THEN 100 / (mh + 100) WHEN mh < 0 THEN -mh / (-mh + 100) END AS ph,
    CASE WHEN ma > 0 THEN ma / 100 WHEN ma < 0 THEN 100 / -ma END AS ba, CASE WHEN mh > 0 THEN mh / 100 WHEN mh < 0 THEN 100 / -mh END AS bh FROM shares JOIN odds USING (game_id)),
kelly AS (SELECT *, coalesce(least(0.25, greatest(0.0, (ba * away_win - (1 - away_win)) / ba)), 0.0) AS ka, coalesce(least(0.25, greatest(0.0, (bh * home_win - (1 - home_win)) / bh)), 0.0) AS kh FROM priced),
bets AS (SELECT game_id, CASE WHEN final_spread IS NULL THEN 'none' WHEN away_cover >= 0.6 THEN 'away' WHEN home_cover >= 0.6 THEN 'home' ELSE 'none' END AS spread_bet,
    CASE WHEN away_win - pa > 0.1 AND ka >= 0.01 THEN 'away' WHEN home_win - ph > 0.1 AND kh >= 0.01 THEN 'home' ELSE 'none' END AS money_bet, greatest(away_cover, home_cover) AS confidence,
    ka, kh, ba, bh, away_score - home_score AS diff, final_spread FROM kelly),
outcomes AS (SELECT *, CASE WHEN spread_bet = 'none' THEN NULL WHEN diff = -final_spread THEN 'push' WHEN (spread_bet = 'away') = (diff > -final_spread) THEN 'won' ELSE 'lost' END AS spread_outcome,
    CASE WHEN money_bet = 'none' THEN 0.0 WHEN (money_bet = 'away') = (diff > 0) THEN CASE money_bet WHEN 'away' THEN ka * ba ELSE kh * bh END ELSE -(CASE money_bet WHEN 'away' THEN ka ELSE kh END) END AS profit,
    CASE money_bet WHEN 'away' THEN ka WHEN 'home' THEN kh ELSE 0.0 END AS stake FROM bets)"""


@query("a22_recommendations", BETS_SQL + " SELECT game_id, spread_bet, money_bet, round(confidence, 4) AS confidence, spread_outcome, round(stake, 6) AS stake, round(profit, 6) AS profit FROM outcomes", "runs", "results")
def recommendations(runs: DataFrame, results: DataFrame) -> DataFrame:
    """A22, F-M5 to F-M8: spread and moneyline recommendations with their outcome."""
    return betting.recommendations(ops.realistic(runs), results, least_runs=3).select("game_id", "spread_bet", "money_bet", F.round("confidence", 4).alias("confidence"), "spread_outcome", F.round("stake", 6).alias("stake"), F.round("profit", 6).alias("profit"))


@query("a23_betting_performance", BETS_SQL + " SELECT coalesce(spread_bet, 'all') AS side, count(*) AS bets, count(*) FILTER (spread_outcome = 'won') AS won, round(avg(confidence), 4) AS confidence, round(sum(profit), 4) AS profit FROM outcomes WHERE spread_bet <> 'none' GROUP BY ROLLUP (spread_bet)", "runs", "results")
def performance(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Performance by side with a total, by rollup."""
    bets = betting.recommendations(ops.realistic(runs), results, least_runs=3).where("spread_bet <> 'none'")
    out = bets.rollup("spread_bet").agg(F.count(F.lit(1)).alias("bets"), F.count_if(F.col("spread_outcome") == "won").alias("won"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.sum("profit"), 4).alias("profit"))
    return out.select(F.coalesce("spread_bet", F.lit("all")).alias("side"), "bets", "won", "confidence", "profit")


@query("a24_simple_hits", f"WITH {KEPT} SELECT count(*) AS games, count(*) FILTER ((p > 0.6) = (home_score > away_score)) AS hits FROM (SELECT game_id, avg(CAST(home > away AS DOUBLE)) AS p FROM kept GROUP BY game_id) JOIN results USING (game_id) WHERE p > 0.6", "runs", "results")
def simple_hits(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Hit rate of a single cut."""
    share = ops.realistic(runs).groupBy("game_id").agg(F.avg((F.col("home") > F.col("away")).cast("double")).alias("p")).where("p > 0.6")
    return share.join(results, "game_id").agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("home_score") > F.col("away_score")).alias("hits"))


@query("fm05_odds", "SELECT game_id, round(CASE WHEN m > 0 THEN 100 / (m + 100) WHEN m < 0 THEN -m / (-m + 100) END, 6) AS implied, round(coalesce(least(0.25, greatest(0.0, (b * 0.6 - 0.4) / b)), 0.0), 6) AS kelly FROM (SELECT *, CASE WHEN m > 0 THEN m / 100 WHEN m < 0 THEN 100 / -m END AS b FROM (SELECT game_id, CASE WHEN regexp_matches(home_moneyline, '^[+-]?\\d+(\\.\\d+)?$') THEN CAST(home_moneyline AS DOUBLE) END AS m FROM results))".replace("\\\\", "\\"), "results")
def odds(results: DataFrame) -> DataFrame:
    """F-M5, F-M6: implied probability and Kelly share."""
    line = F.col("home_moneyline")
    return results.select("game_id", F.round(maths.implied_probability(line), 6).alias("implied"), F.round(maths.kelly_fraction(F.lit(0.6), line), 6).alias("kelly"))


@query("fm07_limits", "SELECT game_id, final_spread IS NOT NULL AND abs(final_spread) <= 8 AS spread_ok, CASE WHEN regexp_matches(away_moneyline, '^[+-]?\\d+(\\.\\d+)?$') THEN abs(CAST(away_moneyline AS DOUBLE)) <= 150 ELSE FALSE END AS money_ok FROM results".replace("\\\\", "\\"), "results")
def limits(results: DataFrame) -> DataFrame:
    """F-M7: spread and moneyline limits, 0 for none."""
    return results.select("game_id", betting.within(F.col("final_spread"), 8.0).alias("spread_ok"), betting.within(maths.moneyline(F.col("away_moneyline")), 150.0).alias("money_ok"))


@query("u04_distinct_teams", "SELECT team FROM (SELECT away_team AS team FROM results UNION SELECT home_team FROM results)", "results")
def teams(results: DataFrame) -> DataFrame:
    """Teams on either side."""
    return results.select(F.col("away_team").alias("team")).unionByName(results.select(F.col("home_team").alias("team"))).distinct()


@query("u05_difference_intersection", "SELECT 'only_away' AS kind, team FROM (SELECT away_team AS team FROM results WHERE day < 30 EXCEPT SELECT home_team FROM results WHERE day < 20) UNION ALL SELECT 'both', team FROM (SELECT away_team AS team FROM results WHERE day < 30 INTERSECT SELECT home_team FROM results WHERE day < 20)", "results")
def difference(results: DataFrame) -> DataFrame:
    """Set difference and intersection."""
    away = results.where("day < 30").select(F.col("away_team").alias("team"))
    home = results.where("day < 20").select(F.col("home_team").alias("team"))
    return away.exceptAll(home).distinct().join(home, "team", "left_anti").select(F.lit("only_away").alias("kind"), "team").unionByName(away.intersect(home).select(F.lit("both").alias("kind"), "team"))


@query("k01_upsert", "SELECT game_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY start_time DESC, CAST(run_id AS INT) DESC) AS rn FROM runs) WHERE rn = 1", "runs")
def upsert(runs: DataFrame) -> DataFrame:
    """K1, U8: the newest row of each key."""
    return ops.latest_per_key(runs, ["game_id"], [F.desc("start_time"), F.col("run_id").cast("int").desc()]).select("game_id", "run_id", "status")


@query("a19_run_fold", "SELECT user_id AS run_id, count(*) AS iterations, count(*) FILTER (event_type = 'purchase') AS scoring, round(100.0 * count(*) FILTER (event_type = 'purchase') / count(*), 4) AS scoring_rate, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id", "t:events")
def run_fold(events: DataFrame) -> DataFrame:
    """A run folded over its iterations."""
    scoring = F.count_if(F.col("event_type") == "purchase")
    return events.groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("iterations"), scoring.alias("scoring"), F.round(F.lit(100.0) * scoring / F.count(F.lit(1)), 4).alias("scoring_rate"), F.max_by("event_type", "event_id").alias("last_type"))
